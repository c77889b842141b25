"""Feature differences of pairs, support, mirroring, feature tables compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import FEATURE_NAMES, feature_vector, long_features, with_features
from ..session import cut_lineage

MIN_SUPPORT = 0.001


def headline_vectors(pairs: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """(headline, vector), extracted once per distinct text."""
    texts = pairs.select(F.explode(F.array("headline_a", "headline_b")).alias("headline")).distinct()
    return with_features(texts, "headline", ["headline"], names).select(
        "headline", feature_vector(names).alias("vector")
    )


def difference_vectors(pairs: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Pairs with ``d`` = features of a minus features of b."""
    vectors = headline_vectors(pairs, names)
    side = lambda s: vectors.select(F.col("headline").alias(f"headline_{s}"), F.col("vector").alias(f"_v{s}"))
    joined = pairs.join(side("a"), "headline_a").join(side("b"), "headline_b")
    return joined.withColumn("d", F.zip_with("_va", "_vb", lambda a, b: a - b)).drop("_va", "_vb")


def feature_support(diffs: DataFrame, names: Sequence[str] = FEATURE_NAMES, weight: str | None = None) -> DataFrame:
    """Share of pairs where a feature differs: one wide aggregation, then 52 rows. ``weight``: how many pairs a row is."""
    times = F.lit(1) if weight is None else F.col(weight)
    total = F.sum(times).cast("double")
    wide = diffs.agg(*[
        (F.sum((F.abs(F.get("d", F.lit(i))) > 0).cast("long") * times).cast("double") / total).alias(n) for i, n in enumerate(names)
    ])
    return long_features(wide, [], names).withColumnRenamed("value", "support").orderBy("support", "pos")


def kept_features(support: DataFrame, minimum: float = MIN_SUPPORT) -> list[str]:
    """Names with enough support, in feature order (at most one row per feature)."""
    return [r["feature"] for r in support.filter(F.col("support") >= minimum).orderBy("pos").collect()]


def mirrored(diffs: DataFrame) -> DataFrame:
    """Each pair in both directions; a mirror keeps the test, so it stays in its fold."""
    both = diffs.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    return both.withColumns(
        {
            "d": F.transform("d", lambda v: v * F.col("sign")),
            "label": F.when(F.col("sign") == 1, F.col("label")).otherwise(1 - F.col("label")),
        }
    )


def table_diff(
    first: DataFrame, second: DataFrame, keys: Sequence[str], names: Sequence[str], tolerance: float = 1e-9, examples: int = 3,
) -> DataFrame:
    """Cells of two feature tables that disagree, per feature, worst first, with the key of the largest difference and ``examples``.

    The tables meet wide, all features are summed up in one pass, and only that one row is turned.  A row that
    one table lacks differs infinitely. Examples are the keys of the largest differences, ties by key: each task keeps
    the first few of a feature before they meet.
    """
    side = lambda df, s: df.select(*keys, F.struct(*names).alias(s))
    # Stored once: the sums and the examples both read it.
    both = cut_lineage(side(first, "_a").join(side(second, "_b"), list(keys), "full"))

    def summed(name: str):
        delta = F.coalesce(F.abs(F.col(f"_a.{name}") - F.col(f"_b.{name}")), F.lit(float("inf")))
        worst = F.min_by(F.struct(*keys), F.struct(-delta, *[F.col(k) for k in keys]))
        return F.struct(
            F.lit(names.index(name)).alias("pos"), F.lit(name).alias("feature"), F.count(F.lit(1)).alias("n_cells"),
            F.count_if(delta > tolerance).alias("n_divergent"), F.max(delta).alias("max_delta"),
            F.when(F.max(delta) > tolerance, worst).alias("worst"),
        )

    rows = both.agg(*[summed(n).alias(f"_{n}") for n in names])
    turned = rows.select(F.inline(F.array(*[F.col(f"_{n}") for n in names])))
    cells = both.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.coalesce(F.abs(F.col(f"_a.{n}") - F.col(f"_b.{n}")), F.lit(float("inf"))).alias("delta")) for n in names
    ]))).filter(F.col("delta") > tolerance)
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("delta"), *keys))
    shown = cells.withColumn("place", place).filter(F.col("place") <= examples).groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("place", *keys, "delta"))).alias("examples"))
    turned = turned.filter("n_cells > 0").join(shown, "feature", "left")
    return turned.orderBy(F.desc("n_divergent"), F.desc("max_delta"), "pos").drop("pos")
