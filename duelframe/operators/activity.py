"""Activity of users: funnel, rate windows, sessions, ownership, erasure, row validation."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# ---- fixed values ------------------------------------------------------------
EVENT_NAMES = (
    "landed example_seen input_focused compare_clicked ranking_shown attribution_expanded "
    "disagreed account_prompt_shown account_created outcome_prompt_shown outcome_reported"
).split()
RATE_MAX, RATE_SECONDS = 30, 60
FEEDBACK_SHOWN, MODELS_SHOWN = 25, 20
MAX_NOTE = 2000
# ---- end of fixed values -----------------------------------------------------


def known_events(events: DataFrame) -> DataFrame:
    """Names outside the closed list are dropped."""
    return events.filter(F.col("name").isin(*EVENT_NAMES))


def funnel(events: DataFrame, as_of: DataFrame, hours: int = 24) -> DataFrame:
    """Events per name in the last hours before ``as_of`` (one row, column ``now``)."""
    since = F.col("now") - F.expr(f"interval {hours} hours")
    one = known_events(events).withColumn("_one", F.lit(1)).join(
        F.broadcast(as_of.withColumn("_one", F.lit(1))), "_one"
    )
    return one.filter((F.col("ts") > since) & (F.col("ts") <= F.col("now"))).groupBy("name").agg(
        F.count(F.lit(1)).alias("n")
    )


def last_moment(events: DataFrame) -> DataFrame:
    return events.agg(F.max("ts").alias("now"))


def rate_windows(
    events: DataFrame, keys: Sequence[str] = ("user_id",), seconds: int = RATE_SECONDS,
    limit: int = RATE_MAX, slice_seconds: int = 3600,
) -> DataFrame:
    """Per event, how many events its user had in the last seconds (this one included).

    A user is cut into time slices; the tail of a slice is repeated in the next
    one, so every frame is whole and a busy user is spread over many tasks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width, span = slice_seconds * 1000000, seconds * 1000000
    own = F.floor(F.col("_us") / width)
    reach = F.floor((F.col("_us") + span) / width)
    sliced = events.withColumn("_us", micros).withColumn("_slice", F.explode(F.array_distinct(F.array(own, reach))))
    w = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = sliced.withColumn("n_recent", F.count(F.lit(1)).over(w))
    kept = counted.filter(F.col("_slice") == own)
    return kept.withColumn("allowed", F.col("n_recent") <= limit).drop("_us", "_slice")


def exact_limit(
    events: DataFrame, keys: Sequence[str] = ("user_id",), seconds: int = RATE_SECONDS,
    limit: int = RATE_MAX, slice_seconds: int = 3600, order: str = "event_id",
) -> DataFrame:
    """Per event ``allowed``: fewer than ``limit`` accepted events of its user in the last seconds. Refused ones do not count.

    Events are decided by (ts, ``order``). One with at most ``limit`` events in its window is accepted whatever came before,
    so most are decided by a count over time slices. What remains are bursts: events over the limit and those that
    lie in their windows. A burst is replayed in order by one task that holds the accepted times of one window, never
    the burst; bursts are a window apart, so they do not depend on each other and spread over tasks.
    """
    keys = list(keys)
    counted = cut_lineage(rate_windows(events, keys, seconds, limit, slice_seconds).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))))
    width, span = slice_seconds * 1000000, seconds * 1000000
    over = F.col("n_recent") > limit
    # Whether an event over the limit follows within the window: again by slices, with the head of the next one repeated.
    own, back = F.floor(F.col("_us") / width), F.floor((F.col("_us") - span) / width)
    sliced = counted.withColumn("_slice", F.explode(F.array_distinct(F.array(own, back))))
    ahead = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(0, span - 1)
    marked = cut_lineage(
        sliced.withColumn("_burst", F.count_if(over).over(ahead) > 0).filter(F.col("_slice") == own).drop("_slice"))
    plain = marked.filter(~F.col("_burst")).withColumn("allowed", F.lit(True))
    gap = F.col("_us") - F.lag("_us").over(Window.partitionBy(*keys).orderBy("_us", order))
    starts = (F.coalesce(gap, F.lit(span)) >= span).cast("int")
    bursts = marked.filter("_burst").drop("allowed").withColumn("_starts", starts)
    number = F.sum("_starts").over(Window.partitionBy(*keys).orderBy("_us", order).rowsBetween(Window.unboundedPreceding, 0))
    bursts = bursts.withColumn("_number", number)
    names = [c for c in bursts.columns]
    at = [names.index(k) for k in (*keys, "_number")]

    def replay(batches):
        accepted, last = deque(), None
        for batch in batches:
            groups = zip(*(batch.column(i).to_pylist() for i in at))
            allowed = []
            for group, us in zip(groups, batch.column(names.index("_us")).to_pylist()):
                if group != last:
                    accepted.clear()
                    last = group
                while accepted and us - accepted[0] >= span:
                    accepted.popleft()
                allowed.append(len(accepted) < limit)
                if allowed[-1]:
                    accepted.append(us)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], [*names, "allowed"])

    ordered = bursts.repartition(*keys, "_number").sortWithinPartitions(*keys, "_number", "_us", order)
    replayed = ordered.mapInArrow(replay, T.StructType([*bursts.schema, T.StructField("allowed", T.BooleanType())]))
    columns = [*events.columns, "n_recent", "allowed"]
    return plain.select(*columns).unionByName(replayed.select(*columns))


def user_sessions(events: DataFrame) -> DataFrame:
    """First and last seen; upgraded once an account was created."""
    upgraded = F.min(F.when(F.col("name") == "account_created", F.col("ts")))
    return events.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        upgraded.isNull().alias("is_anonymous"), upgraded.alias("upgraded_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def activity_sessions(events: DataFrame, gap_seconds: int = 1800, slice_seconds: int = 3600) -> DataFrame:
    """Runs of activity without a longer gap.

    Events become partial sessions per (user, time slice) first, so a busy user is
    spread over tasks; the partial sessions of a user, few per slice, are then
    joined where their gap is short.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stamped = events.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.floor(at / (slice_seconds * 1000000)).alias("_slice"),
    )
    partial = stamped.groupBy("user_id", "_slice", F.session_window("ts", f"{gap_seconds} seconds")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    by_time = Window.partitionBy("user_id").orderBy("first")
    idle = F.unix_micros("first") - F.unix_micros(F.lag("last").over(by_time))
    starts = F.coalesce((idle > gap_seconds * 1000000).cast("int"), F.lit(1))
    runs = partial.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(by_time))
    return runs.groupBy("user_id", "_run").agg(
        F.min("first").alias("started_at"), F.max("last").alias("last_event"), F.sum("n").alias("n_events")
    ).drop("_run")


def owned(rows: DataFrame, rankings: DataFrame) -> DataFrame:
    """Rows that point at a ranking of the same user."""
    return rows.join(rankings.select("ranking_id", "user_id"), ["ranking_id", "user_id"], "left_semi")


def orphaned(rows: DataFrame, rankings: DataFrame) -> DataFrame:
    return rows.join(rankings.select("ranking_id", "user_id"), ["ranking_id", "user_id"], "left_anti")


def visible_rows(rows: DataFrame, caller: int, admins: DataFrame) -> DataFrame:
    """Rows of the caller; an admin sees all."""
    is_admin = admins.filter(F.col("user_id") == caller).limit(1).withColumn("_admin", F.lit(True))
    tagged = rows.withColumn("_caller", F.lit(caller))
    # At most one row on the right.
    joined = tagged.join(
        F.broadcast(is_admin.select(F.col("user_id").alias("_caller"), "_admin")), "_caller", "left"
    )
    return joined.filter((F.col("user_id") == caller) | F.col("_admin")).drop("_caller", "_admin")


def feedback_queue(feedback: DataFrame, items: DataFrame, shown: int = FEEDBACK_SHOWN) -> DataFrame:
    """The newest disagreements with the lines they are about, in rank order.

    Only items of the few rankings shown are gathered (a ranking has at most five
    lines by contract).
    """
    queue = feedback.orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(shown)
    # ``queue`` is bounded by ``shown``.
    hits = items.select("ranking_id", "rank", "text").join(F.broadcast(queue.select("ranking_id").distinct()), "ranking_id")
    lines = hits.groupBy("ranking_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]).alias("lines")
    )
    return queue.join(lines, "ranking_id", "left").withColumn(
        "lines", F.coalesce("lines", F.array().cast("array<string>"))
    )


def erasure_report(tables: dict[str, DataFrame], user: int) -> DataFrame:
    """Rows per table that an erasure of the user removes and keeps."""
    mine = F.col("user_id") == user
    parts = [
        df.agg(F.count_if(mine).alias("n_removed"), F.count_if(~mine | mine.isNull()).alias("n_kept"))
        .select(F.lit(name).alias("table_name"), "n_removed", "n_kept")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erase(df: DataFrame, user: int) -> DataFrame:
    return df.filter(~F.coalesce(F.col("user_id") == user, F.lit(False)))


def clean_number(name: str, top: float | None = None) -> Column:
    """Finite and not negative (and at most ``top``), else null."""
    value = F.col(name).try_cast("double")
    fine = ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    if top is not None:
        fine = fine & (value <= top)
    return F.when(fine, value)


def outcome_rules() -> dict[str, Column]:
    """Row rules of reported outcomes; null passes unless a signal is required."""
    c = F.col
    return {
        "list_size positive": c("list_size").isNull() | (c("list_size") > 0),
        "opens not negative": c("opens").isNull() | (c("opens") >= 0),
        "clicks not negative": c("clicks").isNull() | (c("clicks") >= 0),
        "share within 0-1": c("share").isNull() | c("share").between(0, 1),
        "some signal": c("opens").isNotNull() | c("clicks").isNotNull(),
    }


def ranking_rules() -> dict[str, Column]:
    c = F.col
    return {
        "lines 2-5": c("n_lines").between(2, 5),
        "text 1-300": F.char_length("text").between(1, 300),
    }


def note_rules(column: str) -> dict[str, Column]:
    return {f"{column} too long": F.col(column).isNull() | (F.char_length(column) <= MAX_NOTE)}


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``failed``: names of broken rules.  Empty means valid; the rest is quarantine."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed", F.array_compact(F.array(*broken)))


def valid_and_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = validated(df, rules)
    return checked.filter(F.size("failed") == 0).drop("failed"), checked.filter(F.size("failed") > 0)
