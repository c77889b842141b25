"""Distribution drift per feature and health of the predictions.

Inputs are long tables (feature, value, side) with side ``train`` or ``live``.
Everything is derived from one table of counts per (feature, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import kolmogorov_tail
from ..session import cut_lineage
from .ordered import exact_quantiles, prefix_sums, quantiles_of, spread_steps

# ---- fixed values ------------------------------------------------------------
N_BINS, FLOOR_SHARE = 10, 1e-6
STABLE, MODERATE = 0.10, 0.25
NEAR_HALF, MAX_NEAR_HALF, MIN_STD = 0.05, 0.80, 0.02
MIN_LIVE = 50
# ---- end of fixed values -----------------------------------------------------


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def value_sums(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Train and live counts per (keys, value) with exact prefix sums."""
    finite = sides.filter(_finite(F.col("value")))
    one = lambda s: (F.col("side") == s).cast("long")
    return cut_lineage(
        prefix_sums(finite, keys, "value", {"train": one("train"), "live": one("live")})
    )


def psi_band(psi: Column) -> Column:
    return F.when(psi < STABLE, "stable").when(psi < MODERATE, "moderate shift").otherwise("major shift")


def _share(n: Column, total: Column) -> Column:
    return F.greatest(F.try_divide(n.cast("double"), total.cast("double")), F.lit(FLOOR_SHARE))


def psi(
    sums: DataFrame, keys: Sequence[str], n_bins: int = N_BINS
) -> DataFrame:
    """Population stability index with quantile bins of the training side.

    A bin is the number of inner edges at or below the value.  A training side
    with fewer than three distinct edges gets ten times the live share outside its
    single value, or 0 when it holds more than one value.
    """
    keys = list(keys)
    cuts = quantiles_of(sums, keys, "value", range(n_bins + 1), n_bins, "train")
    edges = cuts.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("_edges")
    )
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    # n_bins + 1 numbers per key
    binned = sums.join(edges, keys).withColumn(
        "_bin", F.size(F.filter(inner, lambda e: e <= F.col("value")))
    )
    per_bin = binned.groupBy(*keys, "_bin").agg(
        F.sum("train").alias("train"), F.sum("live").alias("live"),
        F.max("train_total").alias("train_total"), F.max("live_total").alias("live_total"),
        F.max(F.size("_edges")).alias("_n_edges"),
        F.sum(F.when(F.col("train") > 0, 1).otherwise(0)).alias("_values"),
        F.sum(F.when(F.col("train") == 0, F.col("live")).otherwise(0)).alias("_outside"),
    )
    t, l = _share(F.col("train"), F.col("train_total")), _share(F.col("live"), F.col("live_total"))
    live_total = F.max("live_total")
    usual = F.sum((l - t) * F.ln(l / t))
    outside = F.lit(10.0) * F.sum("_outside") / live_total
    value = (
        F.when((F.max("train_total") == 0) | (live_total == 0), F.lit(None).cast("double"))
        .when(F.max("_n_edges") >= 3, usual)
        .when(F.sum("_values") == 1, outside)
        .otherwise(F.lit(0.0))
    )
    return per_bin.groupBy(*keys).agg(value.alias("psi"))


def psi_discrete(sums: DataFrame, keys: Sequence[str], n_bins: int = N_BINS) -> DataFrame:
    """Index per distinct value; ``usable`` for features with few values, where ``psi`` is blind."""
    t, l = _share(F.col("train"), F.col("train_total")), _share(F.col("live"), F.col("live_total"))
    return sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.sum((l - t) * F.ln(l / t)).alias("psi")
    ).withColumn("usable", F.col("n_values") <= n_bins)


def ks_two_sample(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest distance of the two distributions and its asymptotic p-value."""
    upto = lambda s: (F.col(f"{s}_before") + F.col(s)).cast("double") / F.col(f"{s}_total")
    usable = sums.filter("train_total > 0 and live_total > 0")
    distance = usable.groupBy(*keys).agg(
        F.max(F.abs(upto("train") - upto("live"))).alias("ks_statistic"),
        F.max("train_total").alias("n_train"), F.max("live_total").alias("n_live"),
    )
    return distance.withColumn(
        "ks_p_value",
        kolmogorov_tail(F.col("ks_statistic"), F.col("n_train").cast("double"), F.col("n_live").cast("double")),
    )


def side_moments(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation per side, from the counts per value."""
    x = F.col("value").cast("double")

    def parts(side: str) -> list[Column]:
        n = F.col(side).cast("double")
        mean = F.try_divide(F.sum(n * x), F.sum(n))
        return [mean.alias(f"{side}_mean"), F.sum(n).alias(f"_{side}_n")]

    means = sums.groupBy(*keys).agg(*parts("train"), *parts("live"))
    apart = lambda s: F.sqrt(F.try_divide(
        F.sum(F.col(s) * (x - F.col(f"{s}_mean")) * (x - F.col(f"{s}_mean"))), F.max(f"_{s}_n")
    )).alias(f"{s}_std")
    # Deviations are taken from the mean, so that large values lose no digits.
    return sums.join(means, list(keys)).groupBy(*keys).agg(
        F.max("train_mean").alias("train_mean"), apart("train"), F.max("live_mean").alias("live_mean"), apart("live")
    )


def drift_report(sides: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Everything per feature, worst index first (missing counts as 0)."""
    keys = list(keys)
    sums = value_sums(sides, keys)
    report = (
        psi(sums, keys).withColumn("band", psi_band(F.col("psi")))
        .join(ks_two_sample(sums, keys), keys)
        .join(side_moments(sums, keys), keys)
    )
    return report.orderBy(F.desc(F.coalesce(F.nanvl("psi", F.lit(0.0)), F.lit(0.0))), *keys)


def drift_summary(report: DataFrame, threshold: float = MODERATE) -> DataFrame:
    """Flagged features (at most one name per feature), count and largest index."""
    flagged = _finite(F.col("psi")) & (F.col("psi") >= threshold)
    return report.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(flagged).alias("n_flagged"),
        F.array_join(F.array_sort(F.collect_list(F.when(flagged, F.col("feature")))), " ").alias("flagged_features"),
        F.max(F.when(_finite(F.col("psi")), F.col("psi"))).alias("max_psi"),
    )


def prediction_health(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of predicted probabilities; a pile-up at one half is the alarm."""
    keys = list(keys)
    finite = predictions.filter(_finite(F.col("p")))
    near = (F.abs(F.col("p") - 0.5) < NEAR_HALF).cast("double")
    moments = finite.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"),
        F.avg(near).alias("near_half"),
    )
    points = spread_steps(
        exact_quantiles(finite, keys, "p", [1, 10, 19], 20), keys, {1: "p05", 10: "median", 19: "p95"}
    )
    return moments.join(points, keys).withColumn(
        "degenerate", (F.col("near_half") > MAX_NEAR_HALF) | (F.col("std") < MIN_STD)
    )


def latency_summary(samples: DataFrame, target: str = "target") -> DataFrame:
    """Percentiles and failures per target; only successful requests are timed."""
    good = samples.filter("ok")
    points = spread_steps(
        exact_quantiles(good, [target], "ms", [50, 90, 99], 100), [target],
        {50: "p50_ms", 90: "p90_ms", 99: "p99_ms"},
    )
    counts = samples.groupBy(target).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("errors"),
        F.avg(F.when(F.col("ok"), F.col("ms"))).alias("mean_ms"),
        F.min(F.when(F.col("ok"), F.col("ms"))).alias("min_ms"),
        F.max(F.when(F.col("ok"), F.col("ms"))).alias("max_ms"),
        F.countDistinct(F.when(F.col("ok"), F.col("ranking"))).alias("distinct_orders"),
    )
    return counts.join(points, target, "left")


def targets_agree(samples: DataFrame) -> DataFrame:
    return samples.filter("ok").agg(
        F.countDistinct("ranking").alias("distinct_orders"),
        (F.countDistinct("ranking") <= 1).alias("agree"),
    )


def live_feature_means(items: DataFrame, time: str, tie: Sequence[str], n: int = 500) -> DataFrame:
    """Mean per feature over the newest items; missing is 0, names come from the newest row."""
    recent = items.orderBy(F.desc(time), *[F.desc(t) for t in tie]).limit(n)
    recent = recent.select("features", F.struct(time, *tie).alias("_at"))
    # A few hundred rows from here on.
    first = recent.agg(F.map_keys(F.max_by("features", "_at")).alias("names"), F.count(F.lit(1)).alias("n"))
    names = first.select(F.explode("names").alias("feature"), "n")
    values = recent.select(F.explode("features").alias("feature", "value")).groupBy("feature").agg(
        F.sum(F.coalesce("value", F.lit(0.0))).alias("total")
    )
    return names.join(values, "feature", "left").select(
        "feature", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("mean"), F.col("n").alias("n_items")
    )


def finite_samples(items: DataFrame) -> DataFrame:
    """Long form of stored feature maps without missing or non-finite values."""
    long = items.select(F.explode("features").alias("feature", "value"))
    return long.filter(_finite(F.col("value")))




def latest_per(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Newest row per key without gathering the key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_row")).select(*keys, "_row.*")




def windowed_psi(train: DataFrame, live: DataFrame, window: str, minimum: int = MIN_LIVE) -> DataFrame:
    """Index of every live window against one fixed training distribution: ``psi`` per window.

    The training side is reduced to one row (edges, shares per bin, number of values) before it meets the live
    rows, which are reduced to counts per bin.  Windows with too few values are left out, not measured; without
    training values nothing is.
    """
    base = train.filter(_finite(F.col("value"))).withColumn("_run", F.lit(0))
    sums = cut_lineage(prefix_sums(base, ["_run"], "value", {"n": F.lit(1)}))
    cuts = quantiles_of(sums, ["_run"], "value", range(N_BINS + 1), N_BINS)
    edges = cuts.groupBy("_run").agg(F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("_edges"))
    known = sums.groupBy("_run").agg(F.count(F.lit(1)).alias("_values"), F.min("value").alias("_single"))
    edges = cut_lineage(edges.join(known, "_run"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = lambda df: df.join(F.broadcast(edges), "_run").withColumn(  # noqa: E731 - one row
        "_bin", F.size(F.filter(inner, lambda e: e <= F.col("value")))
    )
    shares = place(sums).groupBy("_run", "_edges", "_values", "_bin").agg(
        F.sum("n").alias("_train"), F.max("n_total").alias("_train_total")
    )
    # At most N_BINS entries; a bin without training rows is missing and counts as empty.
    one = shares.groupBy("_run", "_edges", "_values").agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_train"))).alias("_train"), F.max("_train_total").alias("_train_total")
    )
    outside = F.count_if(F.col("value") != F.col("_single"))
    counted = (
        place(live.filter(_finite(F.col("value"))).withColumn("_run", F.lit(0)))
        .groupBy(window, "_bin").agg(F.count(F.lit(1)).alias("_live"), outside.alias("_outside"))
        .groupBy(window).agg(
            F.map_from_entries(F.collect_list(F.struct("_bin", "_live"))).alias("_counts"),
            F.sum("_live").alias("n_live"), F.sum("_outside").alias("_outside"),
        )
        .filter(F.col("n_live") >= minimum)
        .withColumn("_run", F.lit(0)).join(F.broadcast(one), "_run")
    )
    at = lambda counts, b: F.coalesce(F.try_element_at(counts, b), F.lit(0).cast("long"))
    terms = F.transform(F.sequence(F.lit(0), F.size(inner)), lambda b: F.struct(
        _share(at("_train", b), F.col("_train_total")).alias("t"), _share(at("_counts", b), F.col("n_live")).alias("l"),
    ))
    usual = F.aggregate(terms, F.lit(0.0), lambda a, x: a + (x["l"] - x["t"]) * F.ln(x["l"] / x["t"]))
    value = (
        F.when(F.size("_edges") >= 3, usual)
        .when(F.col("_values") == 1, F.lit(10.0) * F.col("_outside") / F.col("n_live"))
        .otherwise(F.lit(0.0))
    )
    return counted.select(window, "n_live", value.alias("psi")).withColumn("band", psi_band(F.col("psi")))
