"""Registered queries: packages, arms, pairs and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import clean, pairs, splits
from ..operators.ordered import exact_quantiles
from ..session import cut_lineage
from ..sources import tables

_RATES = ("ctr", "ctr_a", "ctr_b", "z", "p_value")


def _rounded_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in _RATES if c in df.columns})


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.build_arms(tables.packages(spark, sf_dir))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.build_pairs(arms(spark, sf_dir))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.label_pairs(candidate_pairs(spark, sf_dir))


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs with their side of the temporal split, stored once."""
    return cut_lineage(splits.with_holdout(cut_lineage(labelled_pairs(spark, sf_dir))))


def _source_count_check(spark, sf_dir):
    """Counts per subset against those of the orders' items; one expectation is wrong by one test."""
    expected = tables.table(spark, sf_dir, "orders").join(
        tables.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    ).groupBy(F.col("l_linestatus").alias("subset")).agg(
        F.count(F.lit(1)).alias("packages"), F.countDistinct("l_suppkey").alias("tests")
    )
    expected = expected.withColumn("tests", F.col("tests") + (F.col("subset") == "F").cast("long"))
    return clean.count_check(tables.packages(spark, sf_dir), expected)


def _capped_pairs(spark, sf_dir):
    a = arms(spark, sf_dir)
    kept = pairs.build_pairs(a).groupBy(*pairs.GROUP).agg(F.count(F.lit(1)).alias("kept"))
    sizes = pairs.group_sizes(a)
    return sizes.join(kept, list(pairs.GROUP), "left").select(
        *pairs.GROUP, "n_arms", pairs._pair_total(F.col("n_arms")).alias("possible"),
        F.coalesce("kept", F.lit(0).cast("long")).alias("kept"),
    )


def _z_test(spark, sf_dir):
    tested = pairs.with_z(candidate_pairs(spark, sf_dir))
    return _rounded_rates(tested.select(*pairs.GROUP, "headline_a", "headline_b", "z", "p_value"))


def _filter_ledger(spark, sf_dir):
    raw = tables.packages(spark, sf_dir)
    a = cut_lineage(clean.build_arms(raw))
    return clean.filter_ledger(raw, pairs.with_z(pairs.build_pairs(a)), pairs.group_census(a))


def _temporal_split(spark, sf_dir):
    labelled = cut_lineage(labelled_pairs(spark, sf_dir))
    sizes = labelled.groupBy("test_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return splits.holdout_tests(labelled).join(sizes, "test_id")


def _group_folds(spark, sf_dir):
    return splits.with_fold(labelled_pairs(spark, sf_dir)).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("test_id").alias("n_tests"),
        F.sum("label").alias("n_positive"),
    )


def _split_overlap(spark, sf_dir):
    """Shared values per column: none for tests, some for texts."""
    both = split_pairs(spark, sf_dir)
    texts = both.select("holdout", F.explode(F.array("headline_a", "headline_b")).alias("headline"))
    parts = []
    for column, rows in (("test_id", both), ("headline", texts)):
        train, test = rows.filter(~F.col("holdout")), rows.filter("holdout")
        counts = [df.select(column).distinct().agg(F.count(F.lit(1)).alias(n)) for df, n in (
            (splits.split_overlap(train, test, column), "n_shared"), (train, "n_train"), (test, "n_test"))]
        # Three tables of one row each.
        one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])
        parts.append(one.select(F.lit(column).alias("column_name"), "n_shared", "n_train", "n_test"))
    return parts[0].unionByName(parts[1])


def _text_overlap(spark, sf_dir):
    return splits.text_overlap(split_pairs(spark, sf_dir))


def _train_char_median(spark, sf_dir):
    a = arms(spark, sf_dir)
    used = pairs.label_pairs(pairs.build_pairs(a)).select("test_id").distinct()
    lengths = a.join(used, "test_id", "left_semi").select(
        F.lit(0).alias("_run"), F.char_length("headline").cast("long").alias("n_chars")
    )
    counted = lengths.groupBy("_run").agg(F.count(F.lit(1)).alias("n_arms"))
    median = exact_quantiles(lengths, ["_run"], "n_chars", [1], 2)
    return counted.join(median, "_run").select(
        "n_arms", F.floor("quantile").cast("long").alias("char_median")
    )


def _label_balance(spark, sf_dir):
    balance = labelled_pairs(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("label").alias("n_positive")
    )
    share = F.col("n_positive").cast("double") / F.col("n_pairs")
    return balance.select("*", rounded(share).alias("balance"), ((share > 0.4) & (share < 0.6)).alias("balanced"))


QUERIES = {
    "source_count_check": _source_count_check,
    "arms": lambda s, d: _rounded_rates(arms(s, d)),
    "group_census": lambda s, d: pairs.group_census(arms(s, d)),
    "candidate_pairs": lambda s, d: _rounded_rates(candidate_pairs(s, d)),
    "capped_pairs": _capped_pairs,
    "z_test": _z_test,
    "labelled_pairs": lambda s, d: _rounded_rates(labelled_pairs(s, d)),
    "alpha_sweep": lambda s, d: pairs.alpha_sweep(cut_lineage(candidate_pairs(s, d))),
    "filter_ledger": _filter_ledger,
    "temporal_split": _temporal_split,
    "group_folds": _group_folds,
    "split_overlap": _split_overlap,
    "text_overlap": _text_overlap,
    "train_char_median": _train_char_median,
    "label_balance": _label_balance,
}
