"""Registered queries: scoring, ranking, attribution, rule engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import rule_pair_probability, rule_score
from ..functions.stats import rounded
from ..operators import attribution as A
from ..operators import ranking as R
from ..operators.scoring import LinearModel, predict_pairs
from ..session import cut_lineage
from ..sources import tables
from .queries_pairs import labelled_pairs


def _lines(spark, sf_dir):
    return tables.lines(spark, sf_dir).drop("doc_id")


def _scored(spark, sf_dir):
    return R.score_sets(_lines(spark, sf_dir))


def _placed(spark, sf_dir):
    return R.placing_ranges(_scored(spark, sf_dir))


def _matrix(spark, sf_dir):
    return R.pairwise_matrix(_scored(spark, sf_dir)).withColumn("p", rounded(F.col("p")))


def _pair_probability(spark, sf_dir):
    return predict_pairs(labelled_pairs(spark, sf_dir)).select(
        "test_id", "image_id", "headline_a", "headline_b", rounded(F.col("p")).alias("p")
    )


def _neighbours(flag, *columns):
    def run(spark, sf_dir):
        full = R.rank_line_sets(_lines(spark, sf_dir)).filter(flag)
        return full.withColumn("gap", rounded(F.col("gap"))).select(R.SET, "position", "next_position", *columns)
    return run


def rank_line_sets(spark, sf_dir):
    full = R.rank_line_sets(_lines(spark, sf_dir))
    return full.select(
        R.SET, "position", "text", "n_lines", "rank", rounded(F.col("score")).alias("score"),
        rounded(F.col("confidence")).alias("confidence"), "lo", "hi", "place_label", "too_close", "overlaps_next",
    )


def _noted(noted):
    return noted.withColumns({c: rounded(F.col(c)) for c in ("contribution", "mine", "theirs")})


#: A model of the features that can be marked in a text.
MARK_MODEL = LinearModel(
    version="marks-1",
    features=("second_person_count", "leading_demonstrative", "demonstrative_count", "ends_question", "ends_exclamation", "ends_ellipsis"),
    coef=(0.3, 0.2, 0.1, 0.25, -0.2, -0.1), scale=(0.5, 0.3, 0.8, 0.4, 0.3, 0.2),
)


def _mark_spans(spark, sf_dir):
    noted = A.note_kinds(A.notes(_lines(spark, sf_dir), MARK_MODEL)).select(R.SET, "position", "text", "kinds")
    return A.marked_lines(noted).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


def _no_attribution(spark, sf_dir):
    """The notes of a model without coefficients."""
    return A.no_attribution(R.split_requests(_lines(spark, sf_dir))).withColumn("position", F.col("position").cast("long"))


def _order_invariance(spark, sf_dir):
    return R.order_invariance(_lines(spark, sf_dir)).withColumn("score_drift", rounded(F.col("score_drift")))


def _scorer_agreement(spark, sf_dir):
    """The window form against the long pair table, both ranked."""
    scored = cut_lineage(_scored(spark, sf_dir).select(R.SET, "position", "pairwise", "score"))
    long = R.borda_scores(R.pairwise_matrix(scored)).withColumnRenamed("i", "position")
    exact = lambda df: df.withColumn("score", F.round("score", 12))
    both = R.scorer_agreement(R.rank_lines(exact(scored)), R.rank_lines(exact(long)))
    return both.withColumn("max_delta", rounded(F.col("max_delta")))


def _ruled(spark, sf_dir):
    accepted = R.split_requests(_lines(spark, sf_dir))
    return accepted.select(R.SET, "position", "text", rule_score(F.col("text")).alias("rule_score"))


def _rule_pairs(spark, sf_dir):
    """Pairs of a set from its (at most five) lines, without a join."""
    ruled = _ruled(spark, sf_dir)
    over_set = R.Window.partitionBy(R.SET)
    mates = F.collect_list(F.struct("position", "rule_score")).over(over_set)
    later = F.filter("_mates", lambda m: m["position"] > F.col("position"))
    rows = ruled.withColumn("_mates", mates).select(
        R.SET, F.col("position").alias("i"), "rule_score", F.explode(later).alias("m")
    )
    gap = F.round(F.col("rule_score") - F.col("m.rule_score"), 9)
    return rows.select(
        R.SET, "i", F.col("m.position").alias("j"),
        rounded(rule_pair_probability(F.col("rule_score"), F.col("m.rule_score"))).alias("p"),
        (F.abs(gap) < R.RULE_MARGIN).alias("inseparable"),
    )


def _directed(spark, sf_dir):
    """Stored once per pair, read in either direction."""
    half = R.pairwise_matrix(_scored(spark, sf_dir)).filter("i < j")
    both = half.select(
        R.SET,
        F.inline(F.array(
            F.struct(F.col("i").alias("from_position"), F.col("j").alias("to_position"), F.col("p").alias("p")),
            F.struct(F.col("j").alias("from_position"), F.col("i").alias("to_position"), (1 - F.col("p")).alias("p")),
        )),
    )
    return both.withColumn("p", rounded(F.col("p")))


QUERIES = {
    "request_check": lambda s, d: R.request_check(_lines(s, d)),
    "pair_probability": _pair_probability,
    "pairwise_matrix": _matrix,
    "borda_scores": lambda s, d: _scored(s, d).select(
        R.SET, "position", "n_lines", rounded(F.col("score")).alias("score"), rounded(F.col("confidence")).alias("confidence")
    ),
    "rank_lines": lambda s, d: R.rank_lines(_scored(s, d)).select(
        R.SET, "position", "rank", rounded(F.col("score")).alias("score")
    ),
    "placing_ranges": lambda s, d: _placed(s, d).select(R.SET, "position", "lo", "hi", "exact", "place_label"),
    "contenders": lambda s, d: R.contenders(_placed(s, d)).select(R.SET, "position"),
    "verdict": lambda s, d: R.verdicts(_placed(s, d)),
    "too_close": _neighbours("too_close", "gap"),
    "placing_overlaps": _neighbours("overlaps_next"),
    "rank_line_sets": rank_line_sets,
    "attribution": lambda s, d: _noted(A.attribution(A.notes(_lines(s, d)))),
    "top_reasons": lambda s, d: _noted(A.top_reasons(A.notes(_lines(s, d)))),
    "mark_spans": _mark_spans,
    "no_attribution": _no_attribution,
    "order_invariance": _order_invariance,
    "scorer_agreement": _scorer_agreement,
    "rule_score": lambda s, d: _ruled(s, d).drop("text"),
    "rule_pair_probability": _rule_pairs,
    "tie_islands": lambda s, d: R.tie_islands(_ruled(s, d), "rule_score", [F.col("text"), F.col("position")]).select(
        R.SET, "position", "rank_start", "rank_end"
    ),
    "directed_probability": _directed,
}
