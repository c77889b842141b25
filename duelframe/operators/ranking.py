"""Ranking sets of two to five lines.

A set is bounded by contract, and ``split_requests`` enforces the bound before
anything is gathered per set.  All set-level work then runs in windows over one
shuffle by set: no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import logistic
from ..functions.text import ordinal_range
from .scoring import HAND_MODEL, LinearModel, with_strength

# ---- fixed values ------------------------------------------------------------
MIN_LINES, MAX_LINES, MAX_CHARS = 2, 5, 300
TOO_CLOSE = 0.04
RULE_MARGIN = 0.07
# ---- end of fixed values -----------------------------------------------------
SET = "ranking_id"


def request_check(lines: DataFrame) -> DataFrame:
    """Per set: lines after trimming, longest line, the first broken rule or null."""
    text = F.trim(F.col("text"))
    sized = lines.filter(text != "").groupBy(SET).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.char_length(text)).cast("long").alias("longest")
    )
    broken = (
        F.when(F.col("n_lines") < MIN_LINES, "too few lines")
        .when(F.col("n_lines") > MAX_LINES, "too many lines")
        .when(F.col("longest") > MAX_CHARS, "line too long")
    )
    return sized.withColumn("refused", broken)


def split_requests(lines: DataFrame) -> DataFrame:
    """Lines of accepted sets.  Sizes are counted with partial aggregation, so an
    oversized set never reaches one task as a group."""
    accepted = request_check(lines).filter("refused is null").select(SET)
    return lines.filter(F.trim("text") != "").withColumn("text", F.trim("text")).join(accepted, SET, "left_semi")


def _set() -> Window:
    return Window.partitionBy(SET)


def score_sets(lines: DataFrame, model: LinearModel = HAND_MODEL) -> DataFrame:
    """Accepted lines with strength, pairwise map, score and confidence."""
    return aggregate_sets(with_strength(split_requests(lines), model))


def aggregate_sets(scored: DataFrame) -> DataFrame:
    """Mean win probability against the other lines of the set.

    Probabilities are added in the order of the strengths: equal lines get equal scores to the last bit, wherever
    they stand, so that only their position decides between them.
    """
    mates = F.array_sort(F.collect_list(F.struct("strength", "position")).over(_set()))
    others = F.filter("_mates", lambda m: m["position"] != F.col("position"))
    chances = F.transform(
        "_others",
        lambda m: F.struct(
            m["position"].alias("position"), logistic(F.col("strength") - m["strength"]).alias("p")
        ),
    )
    total = lambda f: F.aggregate("_chances", F.lit(0.0), lambda a, c: a + f(c["p"]))
    n = F.size("_chances")
    return (
        scored.withColumn("_mates", mates)
        .withColumn("_others", others)
        .withColumn("_chances", chances)
        .withColumns(
            {
                "n_lines": F.size("_mates").cast("long"),
                "pairwise": F.map_from_entries("_chances"),
                "score": F.when(n > 0, F.round(total(lambda p: p) / n, 12)).otherwise(F.lit(0.5)),
                "confidence": F.when(
                    n > 0, total(lambda p: F.abs(p - F.lit(0.5))) / n * F.lit(2.0)
                ).otherwise(F.lit(0.0)),
            }
        )
        .drop("_mates", "_others", "_chances")
    )


def pairwise_matrix(scored: DataFrame) -> DataFrame:
    """Long form (set, i, j, p) of the off-diagonal matrix."""
    rows = scored.select(SET, F.col("position").alias("i"), F.explode_outer("pairwise").alias("j", "p"))
    return rows.filter(F.col("j").isNotNull())


def borda_scores(matrix: DataFrame) -> DataFrame:
    """Score and confidence from any scorer's (set, i, j, p) table; p from the largest, as ``aggregate_sets`` adds them."""
    rows = matrix.groupBy(SET, "i").agg(F.sort_array(F.collect_list("p"), asc=False).alias("_ps"))
    mean = lambda f: F.aggregate("_ps", F.lit(0.0), lambda a, p: a + f(p)) / F.size("_ps")
    return rows.select(
        SET, "i", F.round(mean(lambda p: p), 12).alias("score"), (mean(lambda p: F.abs(p - 0.5)) * 2).alias("confidence")
    )


def _by_rank() -> Window:
    return _set().orderBy(F.desc("score"), F.asc("position"))


def rank_lines(scored: DataFrame) -> DataFrame:
    """Best first; ties keep the input order."""
    return scored.withColumn("rank", F.row_number().over(_by_rank()).cast("long"))


def placing_ranges(scored: DataFrame) -> DataFrame:
    """The best and worst place each line could hold.

    Only differences of at least the threshold count.  This is not a transitive
    grouping, so every line is held against every other one of its set.
    """
    mates = F.collect_list(F.struct("position", "score")).over(_set())
    apart = lambda m: F.abs(F.col("score") - m["score"]) >= TOO_CLOSE
    beaten_by = F.size(F.filter("_mates", lambda m: apart(m) & (m["score"] > F.col("score"))))
    beats = F.size(F.filter("_mates", lambda m: apart(m) & (m["score"] < F.col("score"))))
    placed = scored.withColumn("_mates", mates).withColumns(
        {
            "lo": (beaten_by + 1).cast("long"),
            "hi": (F.size("_mates") - beats).cast("long"),
        }
    )
    lo, hi = F.col("lo"), F.col("hi")
    return placed.withColumns({"exact": lo == hi, "place_label": ordinal_range(lo, hi)}).drop("_mates")


def contenders(placed: DataFrame) -> DataFrame:
    return placed.filter("lo = 1")


def verdicts(placed: DataFrame) -> DataFrame:
    """What each comparison found: class, contenders and groups that share a placing."""
    letter = F.chr(F.lit(65) + F.col("position"))
    per_label = placed.groupBy(SET, "place_label").agg(
        F.array_sort(F.collect_list(letter)).alias("ids"),
        F.max(F.col("lo") == 1).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    sets = per_label.groupBy(SET).agg(
        F.sum("n").alias("n_lines"),
        F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("n_contenders"),
        F.array_sort(
            F.collect_list(F.when(F.col("n") > 1, F.array_join("ids", "+")))
        ).alias("_tied"),
        F.array_join(F.array_sort(F.flatten(F.collect_list(F.when(F.col("first"), F.col("ids"))))), "+").alias("first_ids"),
    )
    n, top = F.col("n_lines"), F.col("n_contenders")
    kind = (
        F.when((top == n) & (n > 1), "all tied")
        .when(top > 1, "several contenders")
        .when(F.size("_tied") == 0, "fully separated")
        .otherwise("winner with ties below")
    )
    return sets.select(
        SET, "n_lines", "n_contenders", kind.alias("verdict"), "first_ids",
        F.array_join("_tied", " ").alias("tied_groups"),
    )


def with_next(ranked: DataFrame) -> DataFrame:
    """Flags against the next line in rank: too close, overlapping placings."""
    nxt = lambda c: F.lead(c).over(_by_rank())
    gap = F.col("score") - nxt("score")
    return ranked.withColumns(
        {
            "next_position": nxt("position"),
            "gap": gap,
            "too_close": F.coalesce(gap < TOO_CLOSE, F.lit(False)),
            "overlaps_next": F.coalesce(
                (F.col("hi") >= nxt("lo")) & (nxt("hi") >= F.col("lo")), F.lit(False)
            ),
        }
    )


def tie_islands(scored: DataFrame, score: str, order: list[Column], margin: float = RULE_MARGIN) -> DataFrame:
    """Runs of neighbours closer than the margin; each shares one rank range."""
    by_score = _set().orderBy(F.desc(score), *order)
    starts = F.coalesce(
        (F.abs(F.lag(score).over(by_score) - F.col(score)) >= margin).cast("int"), F.lit(1)
    )
    runs = scored.withColumn("_rn", F.row_number().over(by_score).cast("long")).withColumn("_start", starts)
    runs = runs.withColumn("_run", F.sum("_start").over(by_score))
    island = Window.partitionBy(SET, "_run")
    return runs.withColumns(
        {"rank_start": F.min("_rn").over(island), "rank_end": F.max("_rn").over(island)}
    ).drop("_rn", "_start", "_run")


def rank_line_sets(lines: DataFrame, model: LinearModel = HAND_MODEL) -> DataFrame:
    """The whole comparison for every accepted set: one shuffle by set after the size check."""
    return with_next(rank_lines(placing_ranges(score_sets(lines, model))))


def order_invariance(lines: DataFrame, model: LinearModel = HAND_MODEL) -> DataFrame:
    """Rank every set again in each rotation and in reverse; compare per line.

    Rows: set, line, the largest score drift and whether the order changed.
    """
    # A line's strength and its chances do not depend on its place; the orders only change in which order chances are added.
    accepted = with_strength(split_requests(lines), model)
    mates = F.collect_list(F.struct(F.col("position").alias("line"), "strength")).over(_set())
    sized = accepted.select(SET, F.col("position").alias("line"), "strength", mates.alias("_mates"))
    n = F.size("_mates").cast("long")
    others = F.filter("_mates", lambda m: m["line"] != F.col("line"))
    chances = F.transform(others, lambda m: F.struct(
        m["line"].alias("line"), m["strength"].alias("strength"), logistic(F.col("strength") - m["strength"]).alias("p")))
    turns = F.sequence(F.lit(0).cast("long"), F.col("_n") * 2 - 1)

    def at(line: Column, turn: Column) -> Column:
        """The place of a line: even turns are rotations, odd ones are reversed."""
        r = F.shiftright(turn, 1)
        return F.when(turn % 2 == 0, (line + r) % F.col("_n")).otherwise((F.col("_n") * 2 - 1 - line - r) % F.col("_n"))

    def score(turn: Column) -> Column:
        placed = F.array_sort(F.transform("_chances", lambda c: F.struct(
            at(c["line"], turn).alias("at"), c["strength"].alias("strength"), c["line"].alias("line"), c["p"].alias("p"))))
        return F.aggregate(placed, F.lit(0.0), lambda a, c: a + c["p"]) / (F.col("_n") - 1)

    # Texts with equal strength may swap with the input order; the strength decides the order.
    ahead = F.size(F.filter("_mates", lambda m: m["strength"] > F.col("strength")))
    trials = sized.withColumns({"_n": n, "_chances": chances, "_ahead": ahead}).withColumn("_scores", F.transform(turns, score))
    return trials.groupBy(SET, "line").agg(
        F.sum(F.size("_scores")).alias("n_orders"),
        (F.max(F.array_max("_scores")) - F.min(F.array_min("_scores"))).alias("score_drift"),
        (F.max("_ahead") != F.min("_ahead")).alias("order_changed"),
    )


def scorer_agreement(first: DataFrame, second: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Two scorers' (set, position, score, rank) side by side, one row per set."""
    side = lambda df, s: df.select(
        SET, "position", F.col("score").alias(f"score_{s}"), F.col("rank").alias(f"rank_{s}")
    )
    both = side(first, "1").join(side(second, "2"), [SET, "position"], "full")
    delta = F.abs(F.col("score_1") - F.col("score_2"))
    return both.groupBy(SET).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("score_1").isNull() | F.col("score_2").isNull()).alias("n_unmatched"),
        F.count_if(~F.col("rank_1").eqNullSafe(F.col("rank_2"))).alias("n_rank_changes"),
        F.max(delta).alias("max_delta"),
        F.coalesce(F.max(delta) <= tolerance, F.lit(False)).alias("agrees"),
    )
