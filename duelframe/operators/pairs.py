"""Pairs of arms inside one (test, image) group, labels and the alpha sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hash_number, two_proportion_z, two_sided_p
from ..session import cut_lineage
from .ordered import exact_quantiles, number_within, spread_steps

GROUP = ("test_id", "image_id")
MAX_PAIRS = 40
#: Arms of one block, where all pairs are listed: a row holds a block, or two that meet.
BLOCK = 32
SEED = 20260826
ALPHA = 0.10
ALPHAS = (0.05, 0.10, 0.20, 0.50, 1.00)


def group_sizes(arms: DataFrame) -> DataFrame:
    return arms.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_arms"))


def _pair_total(n: Column) -> Column:
    return F.shiftright(n * (n - 1), 1)


def group_census(arms: DataFrame, cap: int = MAX_PAIRS) -> DataFrame:
    """Groups, singletons, groups over the cap, possible and kept pairs."""
    total = _pair_total(F.col("n_arms"))
    return group_sizes(arms).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n_arms") < 2).alias("n_singletons"),
        F.count_if(total > cap).alias("n_capped"),
        F.sum(total).cast("long").alias("possible_pairs"),
        F.sum(F.least(total, F.lit(cap))).cast("long").alias("kept_pairs"),
    )


def _whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _larger_arm(p: Column) -> Column:
    """The j of pair number p = j(j-1)/2 + i; the root may be off by one."""
    root = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * p)) / 2.0)
    fixed = lambda j: (
        F.when(_pair_total(j) > p, j - 1).when(_pair_total(j + 1) <= p, j + 1).otherwise(j)
    )
    return F.transform(F.array(root), fixed)


def pick_pairs(groups: DataFrame, cap: int = MAX_PAIRS, seed: int = SEED) -> DataFrame:
    """At most ``cap`` pair numbers per group, drawn without listing all pairs.

    The n(n-1)/2 pairs of a group are numbered; the numbers are cut into ``cap``
    equal strata and a seeded hash picks one pair per stratum.  Every pair has
    (up to the rounding of strata) the same chance, none is drawn twice, and the
    cost per group is ``cap`` rows whatever its size.  Groups within the cap give
    all their pairs.  Columns: group, ``i`` < ``j`` (arm numbers from 0).
    """
    total, cap_ = _pair_total(F.col("n_arms")), F.lit(cap).cast("long")
    sized = groups.select(*GROUP, total.alias("_total"), F.least(total, cap_).alias("_k"))
    sized = sized.filter(F.col("_total") > 0)
    total, k = F.col("_total"), F.col("_k")
    # floor(slot * total / k) without a product that could overflow
    start = lambda s: s * _whole_div(total, k) + _whole_div(s * (total % k), k)

    def draw(slot: Column) -> Column:
        hashed = hash_number(*[F.col(g) for g in GROUP], slot, F.lit(seed))
        return start(slot) + hashed % (start(slot + 1) - start(slot))

    slots = F.sequence(F.lit(0).cast("long"), k - 1)
    drawn = sized.select(*GROUP, F.explode(F.transform(slots, draw)).alias("_p"))
    drawn = drawn.select(*GROUP, "_p", F.explode(_larger_arm(F.col("_p"))).alias("j"))
    return drawn.select(*GROUP, (F.col("_p") - _pair_total(F.col("j"))).alias("i"), "j")


def numbered_arms(arms: DataFrame) -> DataFrame:
    """Arms with their number ``idx`` in (test, image) and the group's size ``n_in_key``, stored: pairs read them three times."""
    return cut_lineage(number_within(arms, GROUP, ["headline"], hash_number(F.col("headline"))))


def build_pairs(
    arms: DataFrame, cap: int | None = MAX_PAIRS, seed: int = SEED, same_image: bool = True
) -> DataFrame:
    """Candidate pairs inside (test, image), all of them without a ``cap``; ``a`` is the smaller headline."""
    if not same_image:
        raise ValueError("pairs across images measure image and text together")
    return pairs_of_numbered(numbered_arms(arms), cap, seed)


def _met(numbered: DataFrame, side: Column) -> DataFrame:
    """(group, x, y): all pairs of a group, each once.

    Arms form blocks of BLOCK by their number. A block's pairs come from its own row, those across blocks from a row for
    each two blocks, so a row makes at most BLOCK * BLOCK pairs and a hot group spreads over its pairs of blocks.
    """
    blocks = numbered.groupBy(*GROUP, F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.collect_list(side).alias("members"), F.floor((F.max("n_in_key") - 1) / BLOCK).alias("last"))

    def listed(rows: DataFrame) -> DataFrame:
        first = rows.select(*GROUP, "against", F.explode("members").alias("x"))
        return first.select(*GROUP, "x", F.explode("against").alias("y"))

    inside = listed(blocks.withColumn("against", F.col("members"))).filter("x.headline < y.headline")
    later = blocks.filter("block < last").withColumn("to", F.explode(F.sequence(F.col("block") + 1, F.col("last"))))
    others = blocks.filter("block > 0").select(*GROUP, F.col("block").alias("to"), F.col("members").alias("against"))
    return inside.unionByName(listed(later.join(others, [*GROUP, "to"])))


def pairs_of_numbered(numbered: DataFrame, cap: int | None = MAX_PAIRS, seed: int = SEED) -> DataFrame:
    """``build_pairs`` from ``numbered_arms``; without ``subset`` if the arms have none."""
    named = [c for c in ("subset",) if c in numbered.columns]
    side = F.struct("headline", "clicks", "impressions", "ctr", "created_at", *named)
    if cap is None:
        both = _met(numbered, side)
    else:
        groups = numbered.filter("idx = 0").select(*GROUP, F.col("n_in_key").alias("n_arms"))
        first = numbered.select(*GROUP, F.col("idx").alias("i"), side.alias("x"))
        second = numbered.select(*GROUP, F.col("idx").alias("j"), side.alias("y"))
        both = pick_pairs(groups, cap, seed).join(first, [*GROUP, "i"]).join(second, [*GROUP, "j"])
    in_order = F.col("x.headline") <= F.col("y.headline")
    both = both.select(
        *GROUP,
        F.when(in_order, F.col("x")).otherwise(F.col("y")).alias("a"),
        F.when(in_order, F.col("y")).otherwise(F.col("x")).alias("b"),
    )
    return both.select(
        *GROUP,
        *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("headline", "clicks", "impressions", "ctr") for s in "ab"],
        F.least("a.created_at", "b.created_at").alias("created_at"),
        *[F.col(f"a.{c}").alias(c) for c in named],
    ).filter(F.col("headline_a") != F.col("headline_b"))


def with_z(pairs: DataFrame) -> DataFrame:
    z = two_proportion_z(*[F.col(c) for c in ("clicks_a", "impressions_a", "clicks_b", "impressions_b")])
    return pairs.withColumn("z", z).withColumn("p_value", two_sided_p(F.col("z")))


def _cross(side: str, other: str) -> Column:
    return F.col(f"clicks_{side}") * F.col(f"impressions_{other}")


def tied() -> Column:
    """Equal rates, decided on integers."""
    return _cross("a", "b") == _cross("b", "a")


def label() -> Column:
    return (_cross("a", "b") > _cross("b", "a")).cast("int")


def label_pairs(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Pairs the outcome can tell apart, with ``label`` = a beats b."""
    tested = with_z(pairs)
    return tested.filter(~tied() & (F.col("p_value") < alpha)).withColumn("label", label())


def alpha_sweep(pairs: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Pairs kept, balance and exposure per significance level."""
    tested = with_z(pairs).select(
        tied().alias("_tied"),
        "p_value",
        label().alias("_label"),
        F.least("impressions_a", "impressions_b").alias("_least"),
        F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"),
    )
    keep = ~F.col("_tied") & (F.col("p_value") < F.col("alpha"))
    counts = tested.groupBy("alpha").agg(
        F.count_if(keep).alias("pairs"),
        F.count(F.lit(1)).alias("candidates"),
        F.sum(F.when(keep, F.col("_label")).otherwise(0)).cast("long").alias("positive"),
    )
    medians = spread_steps(
        exact_quantiles(tested.filter(keep), ["alpha"], "_least", [1], 2),
        ["alpha"],
        {1: "median_min_impressions"},
    )
    return counts.join(medians, "alpha", "left").select(
        "alpha",
        "pairs",
        "candidates",
        F.round(F.lit(100.0) * F.col("pairs") / F.greatest("candidates", F.lit(1)), 2).alias("pct_of_candidates"),
        F.round(F.try_divide(F.col("positive").cast("double"), F.col("pairs").cast("double")), 4).alias("label_balance"),
        "median_min_impressions",
    )
