"""From raw packages to arms: row filters, strict timestamps, aggregation, accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("test_id", "image_id", "headline", "clicks", "impressions", "created_at")
MIN_IMPRESSIONS = 100


class DataError(RuntimeError):
    """The data is not what the run was told to expect."""


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise DataError(f"missing required columns {missing}; present: {sorted(df.columns)}")
    return df


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def stage_flags(packages: DataFrame) -> dict[str, Column]:
    """Row rules in order; a row survives a stage when it passes all rules so far."""
    clicks, shown = _number("clicks"), _number("impressions")
    blank = "^[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*$"
    text = F.col("headline").cast("string")
    flags = {
        "headline present": text.isNotNull() & ~text.rlike(blank),
        "outcomes valid": F.coalesce(
            (shown > 0) & (clicks >= 0) & (clicks <= shown), F.lit(False)
        ),
    }
    if "problem" in packages.columns:
        flags["problem flag clear"] = F.coalesce(_number("problem"), F.lit(0.0)) == 0
    flags["image id present"] = F.col("image_id").isNotNull()
    return flags


def parsed_timestamp(df: DataFrame, name: str = "created_at") -> Column:
    """Timestamp of a text in one of two ISO shapes (null when it has neither)."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    value = F.trim(F.col(name))
    iso = value.rlike("^\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:?\\d{2})?$")
    return F.when(iso, value.try_cast("timestamp"))


def unparsed_timestamps(df: DataFrame, name: str = "created_at") -> DataFrame:
    return df.filter(parsed_timestamp(df, name).isNull())


def clean_packages(packages: DataFrame, strict: bool = True) -> DataFrame:
    """Valid rows with typed outcomes; a timestamp that does not parse fails the job."""
    require_columns(packages)
    kept = packages
    for rule in stage_flags(packages).values():
        kept = kept.filter(rule)
    stamp = parsed_timestamp(kept)
    if strict:
        problem = F.concat(F.lit("created_at does not parse: "), F.coalesce(F.col("created_at").cast("string"), F.lit("null")))
        stamp = F.when(stamp.isNull(), F.raise_error(problem)).otherwise(stamp)
    whole = lambda name: F.floor(_number(name)).cast("long").alias(name)
    return kept.select(
        "test_id", "image_id", "headline", whole("clicks"), whole("impressions"),
        stamp.alias("created_at"), "subset",
    )


def all_arms(packages: DataFrame) -> DataFrame:
    """One row per (test, image, headline) with its whole exposure."""
    return (
        clean_packages(packages)
        .groupBy("test_id", "image_id", "headline")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.min("created_at").alias("created_at"),
            F.min("subset").alias("subset"),
        )
    )


def build_arms(packages: DataFrame, min_impressions: int = MIN_IMPRESSIONS) -> DataFrame:
    return (
        all_arms(packages)
        .filter(F.col("impressions") >= min_impressions)
        .withColumn("ctr", F.col("clicks") / F.col("impressions"))
    )


def package_ledger(packages: DataFrame) -> DataFrame:
    """Rows left after each row rule, in one pass."""
    flags = stage_flags(packages)
    survives = F.lit(True)
    counts = [F.count(F.lit(1)).alias("packages loaded")]
    for name, rule in flags.items():
        survives = survives & rule
        counts.append(F.count_if(survives).alias(name))
    wide = packages.agg(*counts)
    return _stacked(wide, ["packages loaded", *flags], first_seq=1)


def _stacked(wide: DataFrame, names: Sequence[str], first_seq: int) -> DataFrame:
    rows = [
        F.struct(
            F.lit(first_seq + i).cast("long").alias("seq"),
            F.lit(n).alias("stage"),
            F.col(f"`{n}`").cast("long").alias("remaining"),
        )
        for i, n in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def filter_ledger(packages: DataFrame, pairs: DataFrame, census: DataFrame, alpha: float = 0.10, cap: int = 40) -> DataFrame:
    """What every filter cost, from packages to labelled pairs, with notes.

    ``census``: one row of group counts (``pairs.group_census``). Pairs lost to the cap are a stage of their own; where the
    unit changes, from arms to pairs, nothing counts as removed.
    """
    first = package_ledger(packages)
    n_first = 1 + len(stage_flags(packages))
    arms = all_arms(packages).agg(
        F.count(F.lit(1)).alias("arms after aggregation"),
        F.count_if(F.col("impressions") >= MIN_IMPRESSIONS).alias("arm impressions >= threshold"),
    )
    tied = F.col("clicks_a") * F.col("impressions_b") == F.col("clicks_b") * F.col("impressions_a")
    distinct = F.col("headline_a") != F.col("headline_b")
    tested = pairs.agg(
        F.count(F.lit(1)).alias("candidate pairs"),
        F.count_if(distinct).alias("distinct headlines"),
        F.count_if(distinct & ~tied).alias("non-tied rate"),
        F.count_if(distinct & ~tied & (F.col("p_value") < alpha)).alias("distinguishable"),
    )
    possible = census.select(F.col("possible_pairs").alias("possible pairs"))
    noted = census.select(F.inline(F.array(
        F.struct(F.lit("possible pairs").alias("stage"), F.concat_ws(" ", F.col("n_singletons").cast("string"), F.lit("of"), F.col("n_groups").cast("string"), F.lit("groups have a single arm")).alias("note")),
        F.struct(F.lit("candidate pairs").alias("stage"), F.concat_ws(" ", F.col("n_capped").cast("string"), F.lit(f"groups are cut to {cap} pairs")).alias("note")),
        F.struct(F.lit("arm impressions >= threshold").alias("stage"), F.lit(f"at least {MIN_IMPRESSIONS} after aggregation").alias("note")),
        F.struct(F.lit("distinguishable").alias("stage"), F.lit(f"two-sided test below {alpha}").alias("note")),
    )))
    stages = (
        first
        .unionByName(_stacked(arms, arms.columns, n_first + 1))
        .unionByName(_stacked(possible, possible.columns, n_first + 3))
        .unionByName(_stacked(tested, tested.columns, n_first + 4))
    )
    # A dozen rows: one per stage of the run.
    removed = F.lag("remaining").over(Window.orderBy("seq")) - F.col("remaining")
    return stages.join(noted, "stage", "left").select(
        "seq", "stage", "remaining", F.when(F.col("stage") != "possible pairs", removed).alias("removed"), F.coalesce("note", F.lit("")).alias("note"))


def count_check(packages: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows and tests per subset against the published counts.

    ``expected``: (subset, tests, packages), one row per subset.
    """
    found = packages.groupBy("subset").agg(
        F.count(F.lit(1)).alias("found_packages"),
        F.countDistinct("test_id").alias("found_tests"),
    )
    return found.join(expected, "subset", "full").select(
        "subset",
        "found_packages",
        "found_tests",
        F.col("packages").alias("expected_packages"),
        F.col("tests").alias("expected_tests"),
        F.coalesce(
            (F.col("found_packages") == F.col("packages")) & (F.col("found_tests") == F.col("tests")),
            F.lit(False),
        ).alias("matches"),
    )
