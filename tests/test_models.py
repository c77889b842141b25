"""Fits over weighted tables, the text model, the trees and the scorers against plain forms."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.operators import learning as M
from duelframe.operators import scorers as S
from duelframe.operators import splits, tfidf, vectors
from duelframe.operators import text_model as X
from duelframe.session import cut_lineage

WORDS = "truth secret reason why this that watch amazing simple quick real story moment change proof answer".split()


@pytest.fixture(scope="module")
def pairs(spark):
    """Labelled pairs of few texts, many of them repeated, with folds and a holdout."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, rng.integers(2, 6))) + ("?" if i % 3 == 0 else "") for i in range(14)]
    strength = {t: -0.08 * len(t) + 0.9 * t.endswith("?") for t in texts}
    rows = []
    for test in range(150):
        for _ in range(12):
            a, b = sorted(rng.choice(14, 2, replace=False))
            p = 1 / (1 + math.exp(-(strength[texts[a]] - strength[texts[b]])))
            rows.append((test, "i", texts[a], texts[b], int(rng.random() < p), test >= 120))
    df = spark.createDataFrame(rows, "test_id long, image_id string, headline_a string, headline_b string, label long, holdout boolean")
    return cut_lineage(splits.with_fold(df))


@pytest.fixture(scope="module")
def tables(pairs):
    table = cut_lineage(M.pair_table(pairs))
    diffs = cut_lineage(vectors.difference_vectors(table))
    names = vectors.kept_features(vectors.feature_support(diffs, weight="n"))
    return table, cut_lineage(M.difference_table(diffs, names)), names


def _newton(x, y, w, penalty=1.0):
    """Minimises penalty / 2 |b|^2 + sum of w times the loss."""
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        g = penalty * b + x.T @ (w * (p - y))
        b -= np.linalg.solve(penalty * np.eye(len(b)) + (x * (w * p * (1 - p))[:, None]).T @ x, g)
    return b


def test_counts_of_the_table(pairs, tables):
    table = tables[0]
    total = table.agg(F.sum("n"), *[F.sum(F.get("test", F.lit(r))) for r in M.RUNS]).first()
    want = [pairs.filter(F.col("fold") == k).count() for k in range(5)] + [pairs.filter("holdout").count()]
    assert list(total) == [pairs.count(), *want] and table.count() < pairs.count() / 4


@pytest.mark.parametrize("run", [0, M.PAST])
def test_weighted_fit_equals_newton_on_single_rows(pairs, tables, run):
    _, table, names = tables
    model = M.fit_baseline(table, names, weight=M.train_weight(run), both=False)
    kept = pairs.filter(~F.col("holdout") if run == M.PAST else F.col("fold") != run)
    rows = M.select_features(vectors.difference_vectors(kept), names).select("d", "label").collect()
    x, y = np.array([r["d"] for r in rows]), np.array([r["label"] for r in rows], float)
    x, y = np.concatenate([x, -x]), np.concatenate([y, 1 - y])
    scale = x.std(0)
    scale[scale == 0] = 1
    assert np.allclose(model.scale, scale, atol=1e-9)
    assert np.allclose(model.coef, _newton(x / scale, y, np.ones(len(y))), atol=1e-7)


def test_a_fit_short_of_its_optimum_is_an_error(tables, monkeypatch):
    _, table, names = tables
    monkeypatch.setattr(M, "FLAT", 0.0)
    with pytest.raises(M.ConvergenceError):
        M.fit_baseline(table, names, weight=M.train_weight(0), both=False)


def _terms(text):
    import re

    words = re.findall(r"\w{2,}", text.lower())
    chars = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            if n == 3 or n - 1 < len(w):
                chars += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))]
    return {"word": Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]), "char": Counter(chars)}


@pytest.mark.parametrize("run", [2, M.PAST])
def test_text_model_equals_plain_form(spark, pairs, tables, run):
    space = X.text_space(tables[0])
    got = {r["headline"]: r["strength"] for r in X.text_strengths(spark, space, X.fit_text_model(spark, space, run), run).collect()}
    rows = pairs.filter(~F.col("holdout") if run == M.PAST else F.col("fold") != run).collect()
    documents = [t for r in rows for t in (r["headline_a"], r["headline_b"])]
    df = Counter()
    for t in documents:
        df.update((kind, term) for kind, found in _terms(t).items() for term in found)
    vocabulary = {k: i for i, k in enumerate(k for k, n in df.items() if n >= tfidf.MIN_DF)}
    assert space.sizes[run] == len(vocabulary)

    def vector(text):
        out = np.zeros(len(vocabulary))
        for kind, found in _terms(text).items():
            part = {vocabulary[kind, t]: (1 + math.log(n)) * (math.log((1 + len(documents)) / (1 + df[kind, t])) + 1) for t, n in found.items() if (kind, t) in vocabulary}
            norm = math.sqrt(sum(v * v for v in part.values())) or 1
            for i, v in part.items():
                out[i] = v / norm
        return out

    known = {t: vector(t) for t in got}
    x = np.array([known[r["headline_a"]] - known[r["headline_b"]] for r in rows])
    y = np.array([r["label"] for r in rows], float)
    coef = _newton(np.concatenate([x, -x]), np.concatenate([y, 1 - y]), np.ones(2 * len(y)))
    assert all(abs(got[t] - known[t] @ coef) < 2e-3 for t in got)


class _Tree:
    """A regression tree by plain search over midpoints."""

    def __init__(self, x, r, w, depth, least):
        self.value, self.at = np.average(r, weights=w), None
        if not depth:
            return
        best = 1e-12
        for j in range(x.shape[1]):
            seen = np.unique(x[:, j])
            for cut in (seen[1:] + seen[:-1]) / 2:
                left = x[:, j] <= cut
                if min(w[left].sum(), w[~left].sum()) < least:
                    continue
                gain = sum(w[s].sum() * (np.average(r[s], weights=w[s]) - self.value) ** 2 for s in (left, ~left)) / w.sum()
                if gain > best + 1e-12:
                    best, self.at, self.sides = gain, (j, cut), (left, ~left)
        if self.at:
            self.kids = [_Tree(x[s], r[s], w[s], depth - 1, least) for s in self.sides]

    def __call__(self, x):
        if not self.at:
            return np.full(len(x), self.value)
        left = x[:, self.at[0]] <= self.at[1]
        return np.where(left, self.kids[0](x), self.kids[1](x))


def test_trees_equal_plain_boosting(spark):
    rng = np.random.default_rng(3)
    x = rng.choice(np.round(rng.normal(size=14), 3), (300, 4))
    w = rng.integers(1, 9, 300).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.7 * x[:, 1] * x[:, 2])))).astype(int)
    rows = [([float(v) for v in r], int(t), float(n)) for r, t, n in zip(x, y, w)]
    df = spark.createDataFrame(rows, "d array<double>, label long, n double")
    model = M.fit_trees(df, F.col("n"), trees=6, subsamplingRate=1.0, featureSubsetStrategy="all", maxDepth=3, stepSize=0.3, maxBins=32)
    got = {tuple(r["d"]): r["p"] for r in M.predict_trees(df, model).collect()}
    sign, least = 2.0 * y - 1, M.MIN_LEAF
    score = _Tree(x, sign, w, 3, least)(x)
    for _ in range(5):
        score = score + 0.3 * _Tree(x, 4 * sign / (1 + np.exp(2 * sign * score)), w, 3, least)(x)
    want = 1 / (1 + np.exp(-2 * score))
    assert max(abs(got[tuple(r)] - p) for r, p in zip(x, want)) < 1e-6


@pytest.fixture(scope="module")
def arms(spark, pairs):
    texts = sorted({t for r in pairs.collect() for t in (r["headline_a"], r["headline_b"])})
    rows = [(g, "i", t, (7 * k + 3 * g) % 11 / 11) for g, n in enumerate((1, 2, 5, 14)) for k, t in enumerate(texts[:n])]
    return cut_lineage(spark.createDataFrame(rows, "test_id long, image_id string, headline string, ctr double"))


def test_tree_choices_equal_all_pairs(tables, arms, monkeypatch):
    _, table, names = tables
    model = M.fit_trees(M.both_ways(table), M.train_weight(M.PAST), trees=8)
    scorer = S.TreeScorer("trees", model, names)
    a, b = arms.select("test_id", F.col("headline").alias("headline_a")), arms.select("test_id", F.col("headline").alias("headline_b"))
    every = scorer.pairs(a.join(b, "test_id").filter("headline_a <> headline_b"))
    means = {}
    for r in every.groupBy("test_id", "headline_a").agg(F.round(F.avg("p"), 12).alias("s")).collect():
        means.setdefault(r["test_id"], []).append((-r["s"], r["headline_a"]))
    want = {g: min(rows)[1] for g, rows in means.items()}
    for block in (2, 32):
        monkeypatch.setattr(S, "BLOCK", block)
        assert {r["test_id"]: r["pick"]["headline"] for r in scorer.choices(arms).collect()} == want


def test_reports_of_all_models(spark, tables, arms):
    table, differences, names = tables
    tests = table.withColumn("n", F.get("test", F.lit(M.PAST))).filter("n > 0")
    space = X.text_space(table)
    scorers = [
        S.StrengthScorer("tfidf", X.text_strengths(spark, space, X.fit_text_model(spark, space, M.PAST), M.PAST)),
        S.TreeScorer("trees", M.fit_trees(M.both_ways(differences), M.train_weight(M.PAST), trees=8), names),
    ]
    for scorer in scorers:
        row = S.holdout_report(scorer, tests, arms).first()
        assert row["n_pairs"] == 2 * 30 * 12 and row["n_groups"] == 3 and row["accuracy"] > 0.55
        assert (row["max_violation"] < 1e-12) == (scorer.name == "tfidf")
        scored = scorer.pairs(S.both_ways(tests)).collect()
        n = sum(r["n"] for r in scored)
        assert abs(row["brier"] - sum(r["n"] * (r["p"] - r["label"]) ** 2 for r in scored) / n) < 1e-9
        assert 0 <= row["max_calibration_gap"] <= 1
    folds = M.cross_validate_trees(differences, trees=3).unionByName(M.cross_validate(differences, names))
    assert {(r["model"], r["fold"]) for r in folds.collect()} == {(m, k) for m in ("trees", "baseline") for k in range(5)}
