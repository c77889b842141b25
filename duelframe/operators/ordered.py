"""Exact order statistics that never sort one group in one task.

A plain window ``partition by key order by value`` puts a whole key into one
task.  Here every key is first collapsed to distinct values, cut into value
ranges by a quantile sketch of those distinct values, and summed range by range;
the range totals (at most ``n_ranges`` rows per key) carry the offsets.  The
result is exact; the sketch only balances the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

N_RANGES = 64
#: Share of the rows on either side of a wanted quantile that ``exact_quantiles`` looks at.
NEAR = 1 / 1024
#: Distinct values of a range of ``prefix_sums``, and the most ranges of a key; the sketch tells some thousands apart.
RANGE_VALUES, MOST_RANGES = 200_000, 4096
#: Keys up to which a table with a few ranges for each is sent to the rows, so that the rows of a key stay where they are.
FEW_KEYS = 1000


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(FEW_KEYS + 1).count() <= FEW_KEYS else small


def _with_range(df: DataFrame, keys: Sequence[str], at: Column, cuts: Sequence[float]) -> DataFrame:
    """Adds ``_range``, which rises with ``at``: even numbers between the key's edges, odd ones on an edge.

    Edges are values cut by a sketch of ``at`` at these shares. A value that comes often is an edge and a range of its own.
    """
    edges = cut_lineage(df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(at, cuts, 10000)).alias("_edges")))
    if len(cuts) <= 16:
        below = F.lit(0)
        for i in range(len(cuts)):
            below = below + F.when(F.get("_edges", F.lit(i)) < at, 1).otherwise(0)
    else:
        steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
        below = F.coalesce(F.aggregate(
            steps, F.lit(0), lambda found, step: found + F.when(F.get("_edges", found + step - 1) < at, step).otherwise(0)), F.lit(0))
    placed = df.join(_sent(edges), list(keys)).withColumn("_below", below)
    on_edge = F.when(F.get("_edges", F.col("_below")) == at, 1).otherwise(0)
    return placed.withColumn("_range", F.col("_below") * 2 + on_edge).drop("_edges", "_below")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column],
    n_ranges: int = N_RANGES,
    range_on: Column | None = None,
) -> DataFrame:
    """Per (keys, value): each sum, ``<sum>_before`` and ``<sum>_total`` of its key.

    ``range_on``: a number that rises with
    ``value``, for values the sketch cannot take.
    """
    at = F.col(value) if range_on is None else range_on
    keys = list(keys)
    names = list(sums)
    # Read several times below, so it is stored once instead of planned four times.
    per_value = cut_lineage(
        df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )
    # More values, more ranges: what one task sorts does not grow with the input.
    n_ranges = max(n_ranges, min(per_value.count() // RANGE_VALUES, MOST_RANGES))
    ranged = _with_range(per_value, keys, at, [i / n_ranges for i in range(1, n_ranges)]).select(*keys, value, *names, "_range")
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = ranged.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_{n}_in") for n in names]
    )
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_off") for n in names],
        *[F.sum(n).over(every).alias(f"{n}_total") for n in names],
    )
    joined = ranked.join(offsets, [*keys, "_range"])
    return joined.select(
        *keys,
        value,
        *names,
        *[(F.col(f"_{n}_in") + F.col(f"_{n}_off")).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names],
    )


def quantiles_of(
    sums: DataFrame, keys: Sequence[str], value: str, steps: Sequence[int], parts: int, count: str = "n"
) -> DataFrame:
    """Linear-interpolated quantiles ``step/parts`` from a ``prefix_sums`` table.

    Positions are integer arithmetic, so no rounding decides a rank.  Columns:
    keys, ``step``, ``quantile``.
    """
    last = F.col(f"{count}_total") - 1
    before, n = F.col(f"{count}_before"), F.col(count)
    covers = lambda rank: (rank >= before) & (rank < before + n)

    def at(s: Column) -> Column:
        position = last * s.cast("long")
        lo = (position - position % parts) / parts
        lo = lo.cast("long")
        rest = position % parts
        hi = lo + F.when(rest > 0, 1).otherwise(0)
        return F.struct(
            s.cast("int").alias("step"),
            F.when(covers(lo), F.col(value).cast("double")).alias("lo"),
            F.when(covers(hi), F.col(value).cast("double")).alias("hi"),
            (rest / F.lit(float(parts))).alias("part"),
        )

    wanted = F.array(*[F.lit(int(s)) for s in steps])
    hits = F.filter(F.transform(wanted, at), lambda h: h["lo"].isNotNull() | h["hi"].isNotNull())
    rows = sums.filter(n > 0).select(*keys, F.inline(hits))
    return rows.groupBy(*keys, "step").agg(
        (F.max("lo") + (F.max("hi") - F.max("lo")) * F.max("part")).alias("quantile")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    steps: Sequence[int],
    parts: int = 100,
) -> DataFrame:
    """``quantiles_of`` without sums over all values.

    Each wanted quantile has a narrow range around it. Rows are counted per range, and only ranges with a wanted rank are
    sorted: narrow ones, or, where the sketch missed a rank, the one beside.
    """
    keys = list(keys)
    cuts = sorted({min(max(s / parts + way * NEAR, 0.0), 1.0) for s in steps for way in (-1, 1)})
    ranged = _with_range(df.select(*keys, value), keys, F.col(value), cuts)
    totals = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_range", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), F.sum("_n").over(every).alias("n_total"))
    inside = lambda rank: (rank >= F.col("_off")) & (rank < F.col("_off") + F.col("_n"))
    # Whole numbers: a rank is never rounded to its neighbour.
    ranks = [r for s in steps for r in (
        F.expr(f"((n_total - 1) * {int(s)}L) div {parts}"), F.expr(f"((n_total - 1) * {int(s)}L + {parts - 1}) div {parts}"))]
    held = F.lit(False)
    for rank in ranks:
        held = held | inside(rank)
    wanted = cut_lineage(totals.filter(held).drop("_n"))
    kept = ranged.join(_sent(wanted), [*keys, "_range"])
    kept = kept.groupBy(*keys, "_range", value).agg(
        F.count(F.lit(1)).alias("n"), F.max("_off").alias("_off"), F.max("n_total").alias("n_total"))
    before = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("_off"))
    return quantiles_of(sums, keys, value, steps, parts)


def spread_steps(
    quantiles: DataFrame, keys: Sequence[str], names: dict[int, str]
) -> DataFrame:
    """One row per key with a column per named step."""
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("step") == s, F.col("quantile"))).alias(n) for s, n in names.items()]
    )


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], salt_on: Column, salts: int = 64
) -> DataFrame:
    """Dense numbers ``idx`` from 0 inside each key and the key's size ``n_in_key``.

    The order is (salt, order columns), where the salt is a hash: a hot key is
    numbered by up to ``salts`` tasks and the sizes of its slices give the offsets.
    """
    keys = list(keys)
    slice_ = Window.partitionBy(*keys, "_salt")
    # Stored once: the offsets and every reader of the result would repeat the input.
    numbered = cut_lineage(
        df.withColumn("_salt", salt_on % salts)
        .withColumn("_rn", F.row_number().over(slice_.orderBy(*order)).cast("long") - 1)
    )
    # The last number of a slice is its size.
    sizes = numbered.groupBy(*keys, "_salt").agg((F.max("_rn") + 1).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_salt",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n_in_key"),
    )
    return (
        numbered.join(offsets, [*keys, "_salt"])
        .withColumn("idx", F.col("_rn") + F.col("_off"))
        .drop("_salt", "_rn", "_off")
    )
