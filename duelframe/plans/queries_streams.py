"""Registered queries: bounded replays of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import logistic
from ..functions.spans import token_spans
from ..sources import tables
from ..streaming import activity_streams as S
from .queries_evaluation import _round_all


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _replayed(spark, sf_dir):
    events = tables.activity(spark, sf_dir)
    once = S.known_once(events.unionByName(events))
    return once.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


def _health(spark, sf_dir):
    p = F.round(logistic((F.col("value") - 50) / F.lit(40.0)), 12)
    events = tables.table(spark, sf_dir, "events").select("ts", p.alias("p"))
    return _round_all(_plain(S.health_windows(events)))


def _token_spans(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return token_spans(tables.spread(turns), "text", ["conv_id", "turn"])


QUERIES = {
    "stream_rate_limit": lambda s, d: _plain(S.rate_counts(tables.activity(s, d))),
    "stream_funnel": lambda s, d: _plain(S.funnel_counts(tables.activity(s, d), "24 hours", "1 hour")),
    "stream_sessions": lambda s, d: _plain(S.sessions(tables.activity(s, d))),
    "stream_dedup": _replayed,
    "stream_health": _health,
    "token_spans": _token_spans,
}
