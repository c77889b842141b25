"""Leak-free splits by test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import hash_number
from ..session import cut_lineage
from .ordered import prefix_sums

N_FOLDS = 5
HOLDOUT_FRACTION = 0.20


class LeakageError(RuntimeError):
    """A test sits on both sides of a split."""


def with_fold(df: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Fold by a hash of the test: whole tests, no shuffle."""
    return df.withColumn("fold", hash_number(F.col("test_id")) % n_folds)


def split_overlap(train: DataFrame, test: DataFrame, column: str = "test_id") -> DataFrame:
    """Values present on both sides (must be empty)."""
    return train.select(column).intersect(test.select(column))


def require_no_overlap(train: DataFrame, test: DataFrame, column: str = "test_id") -> None:
    shared = split_overlap(train, test, column).limit(3).collect()
    if shared:
        raise LeakageError(f"{column} on both sides, for example {[r[0] for r in shared]}")


def _range_key(df: DataFrame, column: str):
    """A number in the order of the column, to balance value ranges."""
    if isinstance(df.schema[column].dataType, T.StringType):
        head = F.rpad(F.substring(F.hex(F.col(column)), 1, 14), 14, "0")
        return F.conv(head, 16, 10).cast("long")
    return None


def holdout_tests(pairs: DataFrame, fraction: float = HOLDOUT_FRACTION) -> DataFrame:
    """(test_id, first_at, holdout): the newest tests by (first date, test_id).

    The cut is found from counts per date; only tests that share the boundary
    date are ordered by id.
    """
    tests = pairs.groupBy("test_id").agg(F.min("created_at").alias("first_at"))
    tests = cut_lineage(tests.filter(F.col("first_at").isNotNull()).withColumn("_run", F.lit(0)))
    dates = prefix_sums(tests, ["_run"], "first_at", {"n": F.lit(1)})
    wanted = F.greatest(F.bround(F.col("n_total") * F.lit(fraction)).cast("long"), F.lit(1).cast("long"))
    newer = F.col("n_total") - F.col("n_before") - F.col("n")
    cut = dates.filter((newer < wanted) & (newer + F.col("n") >= wanted)).select(
        "_run", F.col("first_at").alias("_cut"), (wanted - newer).alias("_need")
    )
    # ``cut`` has exactly one row.
    placed = cut_lineage(tests.join(F.broadcast(cut), "_run"))
    edge = placed.filter(F.col("first_at") == F.col("_cut"))
    ranks = prefix_sums(
        edge, ["_run", "_need", "_cut"], "test_id", {"n": F.lit(1)},
        range_on=_range_key(edge, "test_id"),
    )
    on_edge = ranks.select(
        "test_id",
        F.col("_cut").alias("first_at"),
        (F.col("n_total") - F.col("n_before") <= F.col("_need")).alias("holdout"),
    )
    others = placed.filter(F.col("first_at") != F.col("_cut")).select(
        "test_id", "first_at", (F.col("first_at") > F.col("_cut")).alias("holdout")
    )
    return others.unionByName(on_edge)


def temporal_split(pairs: DataFrame, fraction: float = HOLDOUT_FRACTION) -> tuple[DataFrame, DataFrame]:
    tests = holdout_tests(pairs, fraction)
    held = tests.filter("holdout").select("test_id")
    return pairs.join(held, "test_id", "left_anti"), pairs.join(held, "test_id", "left_semi")


def with_holdout(pairs: DataFrame, fraction: float = HOLDOUT_FRACTION) -> DataFrame:
    return pairs.join(holdout_tests(pairs, fraction).select("test_id", "holdout"), "test_id")


def text_overlap(split_pairs: DataFrame) -> DataFrame:
    """How much held-out text was seen in training (one row)."""
    sides = split_pairs.select(
        "holdout", F.explode(F.array("headline_a", "headline_b")).alias("headline")
    )
    texts = sides.groupBy("headline").agg(
        F.bool_or("holdout").alias("held"), F.bool_or(~F.col("holdout")).alias("seen")
    )
    headlines = texts.filter("held").agg(
        F.count(F.lit(1)).alias("n_headlines"), F.count_if("seen").alias("n_headlines_seen")
    )
    seen = texts.filter("seen").select("headline")
    held_pairs = split_pairs.filter("holdout").select("headline_a", "headline_b")
    both = (
        held_pairs.join(seen.withColumnRenamed("headline", "headline_a"), "headline_a", "left_semi")
        .join(seen.withColumnRenamed("headline", "headline_b"), "headline_b", "left_semi")
        .agg(F.count(F.lit(1)).alias("n_pairs_both_seen"))
    )
    total = held_pairs.agg(F.count(F.lit(1)).alias("n_pairs"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(headlines).join(one(total), "_one").join(one(both), "_one").drop("_one")
