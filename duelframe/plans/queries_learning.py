"""Registered queries: TF-IDF tables and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import learning as M
from ..operators import scorers as S
from ..operators import pairs as P
from ..operators import splits, tfidf, vectors
from ..operators import text_model as X
from ..operators.scoring import headline_strengths
from ..session import cut_lineage
from .queries_evaluation import _round_all
from .queries_pairs import arms, labelled_pairs

FOLD_TREES = M.TREES // 10
#: Distinct pairs of texts up to which their sizes are sent to the pairs.
FEW_PAIRS = 50_000
_KEYS = ["test_id", "image_id", "headline_a", "headline_b"]


def _idf(spark, sf_dir):
    return tfidf.fit_idf(labelled_pairs(spark, sf_dir)).withColumn("idf", rounded(F.col("idf")))


def _weights(pairs, weight=None):
    return tfidf.headline_weights(tfidf.pair_sides(pairs, weight), tfidf.fit_idf(pairs, weight=weight))


def _tfidf_weights(spark, sf_dir):
    weights = _weights(cut_lineage(labelled_pairs(spark, sf_dir)))
    return weights.withColumn("weight", rounded(F.col("weight")))


def _tfidf_diff(spark, sf_dir):
    """All labelled pairs of all groups. They are listed anew from the stored arms where they are read, not stored."""
    numbered = P.numbered_arms(arms(spark, sf_dir).drop("subset"))
    labelled = P.label_pairs(P.pairs_of_numbered(numbered, cap=None)).select(*_KEYS)
    texts = cut_lineage(labelled.groupBy("headline_a", "headline_b").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut_lineage(tfidf.text_sizes(texts, _weights(texts, "n")))
    sizes = sizes.withColumn("sq_norm", rounded(F.col("sq_norm")))
    sent = F.broadcast(sizes) if texts.count() <= FEW_PAIRS else sizes
    return labelled.join(sent, ["headline_a", "headline_b"]).select(*_KEYS, "kind", "n_terms", "sq_norm")


def experiment(spark, sf_dir, cap=P.MAX_PAIRS):
    """Arms, what training reads of labelled pairs, and tests with their side of the temporal split: each worked out and stored once.

    ``cap``: pairs drawn of a group; None: all.
    """
    # Nothing here reads the subset, and the least of texts would be found by sorting.
    numbered = P.numbered_arms(arms(spark, sf_dir).drop("subset"))
    labelled = P.label_pairs(P.pairs_of_numbered(numbered, cap))
    labelled = cut_lineage(labelled.select("test_id", "headline_a", "headline_b", "label", "created_at"))
    return numbered.drop("idx", "n_in_key"), labelled, cut_lineage(splits.holdout_tests(labelled))


def _tables(labelled, tests):
    """Distinct labelled pairs with their counts per run, distinct differences of them, and the features with enough support."""
    split = labelled.join(tests.select("test_id", "holdout"), "test_id")
    pairs = cut_lineage(M.pair_table(splits.with_fold(split)))
    diffs = cut_lineage(vectors.difference_vectors(pairs))
    names = vectors.kept_features(vectors.feature_support(diffs, weight="n"))
    return pairs, cut_lineage(M.difference_table(diffs, names)), names


def training_tables(spark, sf_dir):
    return _tables(*experiment(spark, sf_dir)[1:])


def _four_digits(df):
    """Fits of two solvers agree to more than four digits."""
    return df.withColumns({c: rounded(F.col(c), 4) for c, t in df.dtypes if t == "double"})


def _past_model(table, names):
    return M.fit_baseline(table, names, weight=M.train_weight(M.PAST), both=False)


def _fit_baseline(spark, sf_dir):
    _, table, names = training_tables(spark, sf_dir)
    return _four_digits(_past_model(table, names).to_frame(spark)).withColumn("pos", F.col("pos").cast("long"))


def _cross_validation(spark, sf_dir):
    _, table, names = training_tables(spark, sf_dir)
    return _four_digits(M.cross_validate(table, names))


def _text_folds(spark, pairs):
    """The text model's metrics per fold, and the size of each fold's vocabulary."""
    space = X.text_space(pairs)

    def job(k):
        strengths = X.text_strengths(spark, space, X.fit_text_model(spark, space, k), k)
        return k, S.StrengthScorer("tfidf", strengths).pairs(S.both_ways(pairs))

    rows = M.metrics(M.tested(M.at_once([lambda k=k: job(k) for k in range(splits.N_FOLDS)])), "tfidf", ["fold"], "n")
    sizes = F.array(*[F.lit(space.sizes[k]) for k in range(splits.N_FOLDS)])
    return rows.withColumn("n_features", F.get(sizes, F.col("fold").cast("int")).cast("long"))


def _text_cross_validation(spark, sf_dir):
    return _four_digits(_text_folds(spark, training_tables(spark, sf_dir)[0]))


def _model_cross_validation(spark, sf_dir):
    """Three models on the same folds: 15 rows. The trees of a fold are a tenth of the challenger's."""
    pairs, table, names = training_tables(spark, sf_dir)
    rows = M.cross_validate(table, names).unionByName(M.cross_validate_trees(table, FOLD_TREES))
    return _four_digits(rows.unionByName(_text_folds(spark, pairs).drop("n_features")))


def _held_out(shown, tests, pairs):
    """Pairs and arms of the newest tests."""
    held = tests.filter("holdout").select("test_id")
    newest = pairs.withColumn("n", F.get("test", F.lit(M.PAST))).filter("n > 0")
    return newest, cut_lineage(shown.join(held, "test_id", "left_semi"))


def _baseline_scorer(pairs, table, names):
    texts = pairs.select(F.explode(F.array("headline_a", "headline_b")).alias("headline"))
    return lambda a: S.StrengthScorer("baseline", headline_strengths(texts.unionByName(a.select("headline")), _past_model(table, names)))


def _text_scorer(spark, pairs, a):
    """Strengths of all texts: those of arms without labelled pairs count as terms of no training pair."""
    extra = a.select("headline").distinct().withColumn("other", F.col("headline"))
    empty = extra.select(F.col("headline").alias("headline_a"), F.col("other").alias("headline_b"), F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0).cast("long"), len(M.RUNS)).alias("test"))
    space = X.text_space(pairs.unionByName(empty.withColumn("label", F.lit(0).cast(pairs.schema["label"].dataType))))
    model = X.fit_text_model(spark, space, M.PAST)
    return S.StrengthScorer("tfidf", X.text_strengths(spark, space, model, M.PAST)), space.sizes[M.PAST]


def _holdout(spark, sf_dir):
    """The baseline, fitted on the past, measured on the newest tests."""
    pairs, table, names = training_tables(spark, sf_dir)
    predicted = M.predict_differences(M.both_ways(table), _past_model(table, names)).withColumn("n", F.get("test", F.lit(M.PAST)))
    return _four_digits(M.metrics(predicted.filter("n > 0"), "baseline", weight="n"))


def _baseline_report(spark, sf_dir):
    """The baseline on the newest tests: pairs, calibration, selection, lift, antisymmetry."""
    shown, labelled, split = experiment(spark, sf_dir)
    pairs, table, names = _tables(labelled, split)
    tests, held = _held_out(shown, split, pairs)
    return _four_digits(S.holdout_report(_baseline_scorer(pairs, table, names)(held), tests, held))


def _challenger(spark, sf_dir):
    """The boosted trees at full size on all labelled pairs, with the full report on the newest tests."""
    shown, labelled, split = experiment(spark, sf_dir, cap=None)
    pairs, table, names = _tables(labelled, split)
    tests, held = _held_out(shown, split, pairs)
    model = M.fit_trees(M.both_ways(table), M.train_weight(M.PAST))
    return _round_all(S.holdout_report(S.TreeScorer("trees", model, names), tests, held))


def _tfidf_holdout(spark, sf_dir):
    shown, labelled, split = experiment(spark, sf_dir)
    pairs = _tables(labelled, split)[0]
    tests, held = _held_out(shown, split, pairs)
    scorer, size = _text_scorer(spark, pairs, held)
    return _four_digits(S.holdout_report(scorer, tests, held).withColumn("n_features", F.lit(size).cast("long")))


QUERIES = {
    "tfidf_idf": _idf,
    "tfidf_weights": _tfidf_weights,
    "tfidf_diff": _tfidf_diff,
    "fit_baseline": _fit_baseline,
    "cross_validation": _cross_validation,
    "text_cross_validation": _text_cross_validation,
    "model_cross_validation": _model_cross_validation,
    "holdout_report": _holdout,
    "baseline_report": _baseline_report,
    "challenger_report": _challenger,
    "tfidf_holdout": _tfidf_holdout,
}
