"""Registered queries: evaluation of a scorer on labelled pairs and arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import evaluate as E
from ..operators import ranking as R
from ..operators import splits
from ..operators.scoring import HAND_MODEL, headline_strengths, predict_pairs
from ..session import cut_lineage
from ..sources import tables
from .queries_pairs import arms, labelled_pairs

_METRICS = ["accuracy", "roc_auc", "brier"]


def _round_all(df, skip=()):
    doubles = [c for c, t in df.dtypes if t == "double" and c not in skip]
    return df.withColumns({c: rounded(F.col(c)) for c in doubles})


def predictions(spark, sf_dir):
    """(test_id, fold, run, p, label), every pair in both directions."""
    scored = predict_pairs(cut_lineage(labelled_pairs(spark, sf_dir))).select("test_id", "p", "label")
    return cut_lineage(E.mirrored_predictions(splits.with_fold(scored)).withColumn("run", F.lit("all")))


def _fold_metrics(spark, sf_dir):
    return E.pairwise_metrics(E.score_sums(predictions(spark, sf_dir), ["fold"]), ["fold"])


def _pairwise(spark, sf_dir):
    return _round_all(E.pairwise_metrics(E.score_sums(predictions(spark, sf_dir), ["run"]), ["run"]))


def _calibration(spark, sf_dir):
    return _round_all(E.calibration(E.score_sums(predictions(spark, sf_dir), ["run"]), ["run"]))


def _cv_summary(spark, sf_dir):
    folds = _fold_metrics(spark, sf_dir).withColumn("model", F.lit(HAND_MODEL.version))
    return _round_all(E.cv_summary(folds, ["model"]))


def choices(spark, sf_dir):
    a = cut_lineage(arms(spark, sf_dir))
    return E.group_choices(a.join(headline_strengths(a), "headline"))


def _antisymmetry(spark, sf_dir):
    scored = R.score_sets(tables.lines(spark, sf_dir).drop("doc_id"))
    return _round_all(E.antisymmetry(R.pairwise_matrix(scored), R.SET))


def _run_compare(spark, sf_dir):
    """All predictions against the confident half, fold by fold."""
    preds = predictions(spark, sf_dir)
    long = lambda df: _round_all(E.metrics_long(
        E.pairwise_metrics(E.score_sums(df, ["fold"]), ["fold"]), ["fold"], _METRICS
    ))
    return _round_all(E.run_compare(long(preds), long(preds.filter("p >= 0.5")), ["fold"]))


QUERIES = {
    "pairwise_metrics": _pairwise,
    "fold_metrics": lambda s, d: _round_all(_fold_metrics(s, d)),
    "cv_summary": _cv_summary,
    "top1_selection": lambda s, d: _round_all(E.selection(choices(s, d))),
    "ctr_lift": lambda s, d: _round_all(E.lift(choices(s, d))),
    "calibration": _calibration,
    "probability_histogram": lambda s, d: E.probability_histogram(predictions(s, d), ["run"]),
    "antisymmetry": _antisymmetry,
    "metrics_long": lambda s, d: _round_all(E.metrics_long(_fold_metrics(s, d), ["fold"], _METRICS)),
    "run_compare": _run_compare,
}
