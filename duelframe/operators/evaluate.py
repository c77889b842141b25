"""How good a scorer is: pairs, selection, lift, calibration, antisymmetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import prefix_sums, quantiles_of
from .pairs import GROUP

N_BINS = 10


def mirrored_predictions(predicted: DataFrame) -> DataFrame:
    """(p, label) of every pair in both directions.

    Twelve digits, so that rounding noise does not split equal probabilities.
    """
    return predicted.select(
        "*",
        F.inline(F.array(
            F.struct(F.round("p", 12).alias("_p"), F.col("label").cast("long").alias("_y")),
            F.struct(F.round(F.lit(1.0) - F.col("p"), 12).alias("_p"), (F.lit(1) - F.col("label")).cast("long").alias("_y")),
        )),
    ).drop("p", "label").withColumnsRenamed({"_p": "p", "_y": "label"})


def score_sums(predictions: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Counts per distinct probability with exact prefix sums: base of AUC and calibration.

    ``weight``: a column of how often a row counts (once, if not given).
    """
    times = F.lit(1) if weight is None else F.col(weight)
    return cut_lineage(prefix_sums(
        predictions, keys, "p",
        {"n": times, "pos": F.col("label") * times, "neg": (F.lit(1) - F.col("label")) * times},
    ))


def pairwise_metrics(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, AUC with midranks and Brier score per key, from ``score_sums``."""
    n, pos, neg, p = (F.col(c).cast("double") for c in ("n", "pos", "neg", "p"))
    right = F.when(F.col("p") >= 0.5, pos).otherwise(neg)
    wins = pos * (F.col("neg_before").cast("double") + neg / 2.0)
    total = F.sum(n)
    return sums.groupBy(*keys).agg(
        F.sum("n").alias("n_pairs"),
        (F.sum(right) / total).alias("accuracy"),
        F.try_divide(F.sum(wins), F.sum(pos) * F.sum(neg)).alias("roc_auc"),
        (F.sum(pos * (F.lit(1.0) - p) * (F.lit(1.0) - p) + neg * p * p) / total).alias("brier"),
    )


def calibration(
    sums: DataFrame, keys: Sequence[str], n_bins: int = N_BINS
) -> DataFrame:
    """Reliability per quantile bin; the bin is the number of inner edges strictly below p."""
    inner = quantiles_of(sums, keys, "p", range(1, n_bins), n_bins)
    edges = inner.groupBy(*keys).agg(F.array_sort(F.collect_list("quantile")).alias("_edges"))
    # n_bins - 1 numbers per key
    binned = sums.join(edges, list(keys)).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col("p"))).cast("long")
    )
    n, p = F.col("n").cast("double"), F.col("p")
    mean, seen = F.sum(n * p) / F.sum(n), F.sum(F.col("pos").cast("double")) / F.sum(n)
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), mean.alias("mean_predicted"), seen.alias("observed"),
        F.abs(mean - seen).alias("gap"),
    )


def probability_histogram(predictions: DataFrame, keys: Sequence[str], n_bins: int = N_BINS) -> DataFrame:
    """Equal bins on [0, 1]; the last bin is closed."""
    at = F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)).cast("long")
    return predictions.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def antisymmetry(matrix: DataFrame, group: str) -> DataFrame:
    """max |p(i,j) + p(j,i) - 1| per group: both directions meet under one key, no self-join."""
    low, high = F.least("i", "j"), F.greatest("i", "j")
    both = matrix.groupBy(group, low.alias("i"), high.alias("j")).agg(
        F.sum("p").alias("total"), F.count(F.lit(1)).alias("n")
    )
    return both.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("n") != 2).alias("n_one_sided"),
        F.max(F.when(F.col("n") == 2, F.abs(F.col("total") - 1.0))).alias("max_violation"),
    )


def group_choices(scored_arms: DataFrame, score: str = "strength") -> DataFrame:
    """Per (test, image): what the scorer picks and what the outcome says.

    Mean win probability against the same opponents rises with the strength, so
    the pick is the strongest arm: no pairs are formed, whatever the group size.
    Aggregations combine on the map side, so a hot group is not gathered.
    Ties go to the first headline.
    """
    first = lambda key: F.min_by(F.struct("headline", "ctr"), F.struct(key, F.col("headline")))
    grouped = scored_arms.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_arms"),
        first(-F.col(score)).alias("pick"),
        first(-F.col("ctr")).alias("best"),
        F.avg("ctr").alias("ctr_mean"),
        F.min("ctr").alias("ctr_worst"),
    )
    return grouped.filter(F.col("n_arms") >= 2)


def choices_from_pairs(matrix: DataFrame, arms: DataFrame) -> DataFrame:
    """The same for a scorer known only through (group, headline_i, headline_j, p)."""
    scores = matrix.groupBy(*GROUP, F.col("headline_i").alias("headline")).agg(F.avg("p").alias("strength"))
    return group_choices(arms.join(scores, [*GROUP, "headline"]))


def selection(choices: DataFrame) -> DataFrame:
    """Top-1 accuracy against picking at random."""
    return choices.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.countDistinct("test_id").alias("n_tests"),
        F.avg((F.col("pick.headline") == F.col("best.headline")).cast("double")).alias("top1_accuracy"),
        F.avg(F.lit(1.0) / F.col("n_arms")).alias("top1_baseline_random"),
        F.avg(F.col("n_arms").cast("double")).alias("mean_arms_per_group"),
    )


def lift(choices: DataFrame) -> DataFrame:
    """Realised rate of the pick against the mean, worst and best arm."""
    means = choices.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.avg("pick.ctr").alias("ctr_model_choice"),
        F.avg("ctr_mean").alias("ctr_mean_arm"),
        F.avg("best.ctr").alias("ctr_best_arm"),
        F.avg("ctr_worst").alias("ctr_worst_arm"),
    )
    c = F.col
    pct = lambda a, b: F.lit(100.0) * F.try_divide(a, b)
    return means.select(
        "*",
        pct(c("ctr_model_choice") - c("ctr_mean_arm"), c("ctr_mean_arm")).alias("lift_vs_mean_pct"),
        pct(c("ctr_model_choice") - c("ctr_worst_arm"), c("ctr_worst_arm")).alias("lift_vs_worst_pct"),
        pct(c("ctr_model_choice") - c("ctr_mean_arm"), c("ctr_best_arm") - c("ctr_mean_arm")).alias("pct_of_oracle_gap_captured"),
    )


def cv_summary(per_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return per_fold.groupBy(*keys).agg(
        F.avg("accuracy").alias("cv_accuracy_mean"),
        F.stddev_pop("accuracy").alias("cv_accuracy_std"),
        F.avg("roc_auc").alias("cv_auc_mean"),
        F.stddev_pop("roc_auc").alias("cv_auc_std"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def metrics_long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per metric."""
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return wide.select(*keys, F.inline(F.array(*rows)))


def run_compare(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two runs, metric by metric."""
    side = lambda df, s: df.withColumnRenamed("value", f"value_{s}")
    both = side(first, "1").join(side(second, "2"), [*keys, "metric"], "full")
    a, b = F.col("value_1"), F.col("value_2")
    return both.select(
        *keys, "metric", "value_1", "value_2",
        a.eqNullSafe(b).alias("equal"),
        F.try_divide(F.abs(a - b), F.abs(a)).alias("relative_delta"),
    )


def outcome_agreement(rows: DataFrame, group: Sequence[str], score: Column, rate: Column) -> DataFrame:
    """Share of groups whose reported best rate is the scorer's first choice."""
    tagged = rows.select(*group, score.alias("_s"), rate.alias("_r"))
    best = tagged.groupBy(*group).agg(
        F.max_by("_r", "_s").alias("picked"), F.max("_r").alias("best"), F.count(F.lit(1)).alias("n")
    )
    usable = best.filter("n >= 2 and best is not null")
    return usable.agg(
        F.count(F.lit(1)).alias("n_user_labels"),
        F.avg((F.col("picked") == F.col("best")).cast("double")).alias("user_accuracy"),
    )


