"""Structured Streaming over activity events.

Each function takes a streaming (or batch) DataFrame and returns one; the caller
picks trigger, output mode and sink.  On a batch the watermark has no effect, so
the same function gives the bounded replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift
from ..operators.activity import EVENT_NAMES, RATE_MAX, RATE_SECONDS

LATE = "2 minutes"


def stamped(events: DataFrame, late: str = LATE) -> DataFrame:
    """Watermarked events; watermarks need a zoned timestamp."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def known_once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Closed list of names, each event id once within the watermark."""
    known = stamped(events, late).filter(F.col("name").isin(*EVENT_NAMES))
    if known.isStreaming:
        return known.dropDuplicatesWithinWatermark(["event_id"])
    return known.dropDuplicates(["event_id"])


def rate_counts(events: DataFrame, late: str = LATE, slide: str = "10 seconds") -> DataFrame:
    """Events per user in sliding windows of the rate limit."""
    window = F.window("ts", f"{RATE_SECONDS} seconds", slide)
    counted = stamped(events, late).groupBy(window.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("w.start").alias("started_at"), "user_id", "n", (F.col("n") > RATE_MAX).alias("over_limit")
    )


def funnel_counts(events: DataFrame, length: str = "24 hours", slide: str | None = None, late: str = LATE) -> DataFrame:
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        stamped(events, late).groupBy(window.alias("w"), "name").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("started_at"), "name", "n")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    window = F.session_window("ts", gap)
    grouped = stamped(events, late).groupBy("user_id", window.alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_event")
    )
    return grouped.select("user_id", F.col("w.start").alias("started_at"), "last_event", "n_events")


def live_users(events: DataFrame) -> DataFrame:
    """First and last seen per user; update mode keeps one state row per user."""
    return events.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_events"),
        F.max(F.col("name") == "account_created").alias("upgraded"),
    )


def health_windows(predictions: DataFrame, length: str = "24 hours", late: str = LATE) -> DataFrame:
    """Collapse alarm per window of predicted probabilities (columns ts, p)."""
    near = (F.abs(F.col("p") - 0.5) < drift.NEAR_HALF).cast("double")
    grouped = stamped(predictions, late).groupBy(F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"),
        F.avg(near).alias("near_half"),
    )
    alarm = (F.col("near_half") > drift.MAX_NEAR_HALF) | (F.col("std") < drift.MIN_STD)
    return grouped.select(F.col("w.start").alias("started_at"), "n", "mean", "std", "near_half", alarm.alias("degenerate"))


def drift_writer(train: DataFrame, window: str, path: str):
    """A ``foreachBatch`` function: compare each batch with the training values, append the run.

    A batch that is replayed after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        report = drift.windowed_psi(train, batch, window)
        report.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def exact_rate_limit(events: DataFrame, limit: int = RATE_MAX, seconds: int = RATE_SECONDS) -> DataFrame:
    """Decision per event: refused events do not count against the user.

    The state of a user is the times of accepted events still inside the window,
    at most ``limit`` numbers.
    """

    def decide(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        verdicts = []
        for at in rows["us"]:
            accepted = [t for t in accepted if at - t < seconds * 1_000_000]
            verdicts.append(len(accepted) < limit)
            if verdicts[-1]:
                accepted.append(int(at))
        state.update((accepted,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": verdicts})

    timed = events.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(
        decide, "event_id long, user_id long, allowed boolean", "accepted array<long>", "append", "NoTimeout"
    )
