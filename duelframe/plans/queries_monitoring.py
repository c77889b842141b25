"""Registered queries: drift, prediction health, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import long_features, with_features
from ..functions.stats import logistic, rounded
from ..operators import activity as A
from ..operators import drift as D
from ..operators import ranking as R
from ..session import cut_lineage
from ..sources import tables
from .queries_evaluation import _round_all


def feature_sides(spark, sf_dir):
    """(feature, value, side): English documents train, the others are live."""
    wide = with_features(tables.documents(spark, sf_dir, "lang", "text"), "text", ["lang"])
    long = long_features(wide, ["lang"])
    side = F.when(F.col("lang") == "en", "train").otherwise("live")
    return long.select("feature", rounded(F.col("value")).alias("value"), side.alias("side"))


def _sums(spark, sf_dir):
    return D.value_sums(feature_sides(spark, sf_dir), ["feature"])


def _psi(spark, sf_dir):
    return _round_all(D.psi(_sums(spark, sf_dir), ["feature"]).withColumn("band", D.psi_band(F.col("psi"))))


def _report(spark, sf_dir):
    return D.drift_report(feature_sides(spark, sf_dir), ["feature"])


def _drift_by_window(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select("ts", "value", F.to_date("ts").alias("day"))
    cut = F.lit("2024-01-11").cast("timestamp_ntz")
    train, live = events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)
    return _round_all(D.windowed_psi(train.select("value"), live.select("day", "value"), "day"))


def _health(spark, sf_dir):
    scored = R.score_sets(tables.lines(spark, sf_dir).drop("doc_id"))
    p = R.pairwise_matrix(scored).select(F.lit("all").alias("run"), F.round("p", 12).alias("p"))
    return _round_all(D.prediction_health(cut_lineage(p), ["run"]))


def _health_by_day(spark, sf_dir):
    p = F.round(logistic((F.col("value") - 50) / F.lit(40.0)), 12)
    days = tables.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), p.alias("p"))
    return _round_all(D.prediction_health(days, ["day"]))


def _funnel(spark, sf_dir):
    events = tables.activity(spark, sf_dir)
    return A.funnel(events, A.last_moment(events))


def _funnel_by_day(spark, sf_dir):
    return A.known_events(tables.activity(spark, sf_dir)).groupBy(F.to_date("ts").alias("day"), "name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users")
    )


def _activity_sessions(spark, sf_dir):
    found = A.activity_sessions(tables.activity(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_event")})


def _recent_samples(spark, sf_dir):
    items = tables.ranking_items(spark, sf_dir)
    order = [F.desc(c) for c in ("created_at", "ranking_id", "rank", "item_id")]
    long = D.finite_samples(items.orderBy(*order).limit(2000))
    return _round_all(long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def _erasure(spark, sf_dir):
    return A.erasure_report(
        {
            "events": tables.activity(spark, sf_dir), "feedback": tables.feedback(spark, sf_dir),
            "outcomes": tables.outcomes(spark, sf_dir), "rankings": tables.rankings(spark, sf_dir),
        },
        7,
    )


def _validate(spark, sf_dir):
    checked = A.validated(tables.outcomes(spark, sf_dir), A.outcome_rules())
    return checked.select("outcome_id", F.array_join("failed", "; ").alias("failed"))


def _clean_outcomes(spark, sf_dir):
    return tables.outcomes(spark, sf_dir).select(
        "outcome_id", A.clean_number("opens").alias("opens"), A.clean_number("clicks").alias("clicks"),
        F.round(A.clean_number("share", 1.0), 6).alias("share"),
    )


def _feedback(keep):
    def run(spark, sf_dir):
        rows = keep(tables.feedback(spark, sf_dir), tables.rankings(spark, sf_dir))
        return rows.select("feedback_id", "ranking_id", "user_id")
    return run


def _queue(spark, sf_dir):
    queue = A.feedback_queue(tables.feedback(spark, sf_dir), tables.ranking_items(spark, sf_dir))
    return queue.select("feedback_id", "created_at", "ranking_id", F.array_join("lines", " | ").alias("lines"))


def _visible(spark, sf_dir):
    rankings = tables.rankings(spark, sf_dir)
    admins = tables.table(spark, sf_dir, "customer").filter("c_custkey = 149").select(F.col("c_custkey").alias("user_id"))
    return A.visible_rows(rankings, 7, admins)


QUERIES = {
    "psi": _psi,
    "psi_discrete": lambda s, d: _round_all(D.psi_discrete(_sums(s, d), ["feature"])),
    "ks_two_sample": lambda s, d: _round_all(D.ks_two_sample(_sums(s, d), ["feature"])),
    "drift_report": lambda s, d: _round_all(_report(s, d)),
    "drift_summary": lambda s, d: _round_all(D.drift_summary(_report(s, d))),
    "drift_by_window": _drift_by_window,
    "prediction_health": _health,
    "prediction_health_by_day": _health_by_day,
    "funnel_24h": _funnel,
    "funnel_by_day": _funnel_by_day,
    "rate_limit": lambda s, d: A.rate_windows(tables.activity(s, d)).select("event_id", "user_id", "n_recent", "allowed"),
    "rate_limit_daily": lambda s, d: A.rate_windows(tables.activity(s, d), seconds=86400, limit=3, slice_seconds=604800).select(
        "event_id", "user_id", "n_recent", "allowed"
    ),
    "rate_limit_exact": lambda s, d: A.exact_limit(tables.activity(s, d), seconds=86400, limit=3, slice_seconds=604800).select(
        "event_id", "user_id", "allowed"
    ),
    "user_sessions": lambda s, d: A.user_sessions(tables.activity(s, d)),
    "activity_sessions": _activity_sessions,
    "recent_samples": _recent_samples,
    "live_feature_means": lambda s, d: _round_all(
        D.live_feature_means(tables.ranking_items(s, d), "created_at", ["ranking_id", "rank", "item_id"])
    ),
    "latest_run": lambda s, d: _round_all(D.latest_per(tables.monitoring_runs(s, d), ["model_version"], "created_at", "run_id")),
    "event_props": lambda s, d: tables.table(s, d, "events").groupBy(
        "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")
    ).agg(F.count(F.lit(1)).alias("n")),
    "latency_summary": lambda s, d: _round_all(D.latency_summary(tables.latency_samples(s, d))),
    "targets_agree": lambda s, d: D.targets_agree(tables.latency_samples(s, d)),
    "erasure_report": _erasure,
    "validate_outcomes": _validate,
    "clean_outcomes": _clean_outcomes,
    "orphan_feedback": _feedback(A.orphaned),
    "owned_feedback": _feedback(A.owned),
    "feedback_queue": _queue,
    "visible_rows": _visible,
}
