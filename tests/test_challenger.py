"""What the challenger's report works out once."""

import functools
import math

import numpy as np
from pyspark.sql import functions as F

from duelframe.functions.stats import logistic
from duelframe.operators import learning as M
from duelframe.operators import pairs as P
from duelframe.operators import scorers as S
from duelframe.plans import queries_learning as Q
from duelframe.plans import queries_pairs
from duelframe.session import cut_lineage
from duelframe.sources import tables

TEXTS = [f"{a} {b}" for a in ("red", "amazing", "why this", "8") for b in ("apple?", "real story", "proof")]


def test_a_pair_of_texts_is_scored_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {g: sorted(rng.choice(len(TEXTS), n, replace=False).tolist()) for g, n in enumerate((1, 2, 12, *rng.integers(2, 12, 20)))}
    rows = [(g, "i", TEXTS[k], (7 * k + 3 * g) % 11 / 11) for g, members in groups.items() for k in members]
    arms = spark.createDataFrame(rows, "test_id long, image_id string, headline string, ctr double")
    lean = lambda v: 0.3 * v - 0.01 * v * v
    scored = []

    def predict(rows, model):
        scored.append(rows.count())
        return rows.withColumn("p", logistic(lean(F.get("d", F.lit(0)))))

    monkeypatch.setattr(S, "predict_trees", predict)
    scorer = S.TreeScorer("trees", None, ["char_count"])
    p = {(a, b): 1 / (1 + math.exp(-lean(len(a) - len(b)))) for a in TEXTS for b in TEXTS}
    want = {
        (g, TEXTS[k]): sum(p[TEXTS[k], TEXTS[o]] for o in members if o != k) / (len(members) - 1)
        for g, members in groups.items() for k in members if len(members) > 1
    }
    known = cut_lineage(S.vectors.headline_vectors(arms.select(F.col("headline").alias("headline_a"), F.col("headline").alias("headline_b"))))
    for block in (5, 32):
        monkeypatch.setattr(S, "BLOCK", block)
        for few in (1, 1000):
            monkeypatch.setattr(S, "FEW_TEXTS", few)
            got = {(r["test_id"], r["headline"]): r["strength"] for r in scorer._by_texts(arms, known, len(TEXTS)).collect()}
            assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-11
    got = {(r["test_id"], r["headline"]): r["strength"] for r in scorer._by_groups(arms, known, 1000).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-11
    scored.clear()
    picks = {r["test_id"]: r["pick"]["headline"] for r in scorer.choices(arms).collect()}
    assert picks == {g: min((-round(want[g, TEXTS[k]], 12), TEXTS[k]) for k in m)[1] for g, m in groups.items() if len(m) > 1}
    assert scored == [len(TEXTS) ** 2]
    scored.clear()
    # Texts that meet once are not scored against texts they never meet.
    few = arms.filter("test_id < 2")
    assert scorer.choices(few).count() == 1 and scored == [2]


def test_the_report_reads_the_packages_once(spark, monkeypatch):
    read, packages = [], tables.packages
    monkeypatch.setattr(tables, "packages", lambda *a: read.append(1) or packages(*a))
    monkeypatch.setattr(M, "fit_trees", functools.partial(M.fit_trees, trees=2))
    assert Q.QUERIES["challenger_report"](spark, "/root/testdata/sf0.01").count() == 1
    assert len(read) == 1


def test_pairs_do_without_a_subset(spark):
    arms = queries_pairs.arms(spark, "/root/testdata/sf0.001")
    whole, lean = P.build_pairs(arms), P.build_pairs(arms.drop("subset"))
    assert whole.columns == [*lean.columns, "subset"] and whole.count() == lean.count() > 0
    assert whole.drop("subset").exceptAll(lean).count() == 0
    assert "SortAggregate" not in arms.drop("subset")._jdf.queryExecution().executedPlan().toString()
