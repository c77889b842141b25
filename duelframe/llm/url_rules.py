"""URL filter by a sort-merge range join over canonical keys (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage

# One label of a reversed host ends with this mark; it sorts below every printable character.
_MARK = "\u0001"


def _lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or end; A-Z lowered; else empty."""
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from right to left, each closed by a mark: all hosts below one host form one interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _MARK), F.lit(_MARK))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules`` has host, path, verdict. A rule fits its host and all hosts below it when the path starts
    with the rule's path. The deepest host wins, then the longest path; of equal rules, ``allow`` (the
    smaller verdict). Rows without a fitting rule get a null rule and ``default``. Rules with a null or
    empty host fit nothing; a null path is empty. Null urls and urls without ``://`` have empty host and
    path; a path may not hold U+10FFFF, which is no character. Columns of ``pages`` with the four names are replaced; repeated rows stay repeated.

    Each rule becomes the interval [key, end) of the canonical keys that start with its reversed host and
    path. Each url asks one key for each of its host's last labels (no more than the deepest rule has).
    Rule bounds and urls are range-sorted together, so that a host of any size is spread over many tasks,
    and one running value sweeps each range. At the start of an interval the top of the stack is that rule;
    at its end it is the rule around it, or none.
    """
    known = rules.select(
        _lower_ascii(F.col("host").cast("string")).alias("_host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("_path"),
        F.col("verdict").cast("string").alias("_verdict"),
    ).filter(F.length("_host") > 0)
    known = known.groupBy("_host", "_path").agg(F.min("_verdict").alias("_verdict")).select(
        host_key(F.col("_host")).alias("hk"), F.col("_path").alias("rp"),
        F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict"),
    )
    depth = known.agg(F.max(F.size(F.split("hk", _MARK)) - 1)).first()[0] or 0

    # The rule around each rule: the longest proper prefix of its path with the same host.
    inner = known.select("hk", "rp", F.explode(F.sequence(F.lit(0), F.length("rp"))).alias("n")).filter(F.col("n") < F.length("rp"))
    inner = inner.select("hk", "rp", F.col("rp").substr(F.lit(1), F.col("n")).alias("outer"))
    around = inner.join(
        known.select("hk", F.col("rp").alias("outer"), F.struct(F.length("rp").alias("len"), "rule", "verdict").alias("up")), ["hk", "outer"],
    ).groupBy("hk", "rp").agg(F.max("up").alias("up"))
    bounds = known.join(around, ["hk", "rp"], "left")
    top = F.struct(F.lit(True).alias("set"), F.length("rp").alias("len"), "rule", "verdict")
    below = F.struct(
        F.lit(True).alias("set"), F.col("up.len").alias("len"), F.col("up.rule").alias("rule"), F.col("up.verdict").alias("verdict"),
    )
    # An interval ends behind every string with its prefix; U+10FFFF sorts behind each following character.
    # Among bounds of one key, ends come before starts and inner ends before outer ones.
    end = F.struct(F.concat("hk", "rp", F.lit("\U0010ffff")).alias("key"), F.lit(0).alias("kind"), (-F.length("rp")).alias("nest"), below.alias("top"))
    start = F.struct(F.concat("hk", "rp").alias("key"), F.lit(1).alias("kind"), F.length("rp").alias("nest"), top.alias("top"))
    edges = bounds.select(F.explode(F.array(start, end)).alias("e")).select("e.*", F.lit(None).cast("bigint").alias("row"), F.lit(0).alias("level"))

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    link = F.col(url).cast("string")
    rows = cut_lineage(pages.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*kept).alias("data"),
        host_of(link).alias("host"), path_of(link).alias("path"),
    ))
    labels = F.reverse(F.split("host", r"\.", -1))
    asks = rows.filter(F.length("host") > 0).select("row", "path", labels.alias("l"))
    asks = asks.select("row", "path", "l", F.explode(F.sequence(F.lit(1), F.least(F.size("l"), F.lit(depth)))).alias("level")) if depth else asks.withColumn("level", F.lit(0)).limit(0)
    asks = asks.select(
        F.concat(F.array_join(F.slice("l", 1, F.col("level")), _MARK), F.lit(_MARK), F.col("path")).alias("key"),
        F.lit(2).alias("kind"), F.lit(0).alias("nest"), F.lit(None).cast(edges.schema["top"].dataType).alias("top"), "row", "level",
    )
    order = ["key", "kind", "nest", "row"]
    events = cut_lineage(edges.unionByName(asks).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # What is on top where a range begins: one row for each range.
    bound = F.when(F.col("kind") < 2, F.struct(*order[:3]))
    tops = events.groupBy("part").agg(F.max_by("top", bound).alias("last"))
    carry = tops.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    swept = events.join(carry, "part").withColumn("now", F.coalesce(F.last("top", True).over(
        Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.col("before")))
    found = swept.filter("kind = 2 and now.rule is not null").groupBy("row").agg(F.max(F.struct("level", "now")).alias("best"))
    return rows.join(found, "row", "left").select(
        "data.*", "host", "path", F.col("best.now.rule").alias("rule"),
        F.coalesce("best.now.verdict", F.lit(default)).alias("verdict"),
    )
