"""Writing results: rankings with their lines, append-only tables, run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import FEATURE_NAMES, feature_map, with_features
from ..session import cut_lineage


def with_feature_maps(ranked: DataFrame) -> DataFrame:
    """Ranked lines with the named feature map they were ranked on."""
    kept = ranked.columns
    return with_features(ranked, "text", kept).select(*kept, feature_map(FEATURE_NAMES).alias("features"))


def save_rankings(
    ranked: DataFrame, folder: str, model_version: str, spec_version: int, mode: str = "append",
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One row per ranking and one per line, from one stored result.

    ``widen``: adds columns that follow from a line alone (``with_feature_maps``) as the lines are written, so that
    the stored result stays narrow. Lines are written first: a failed run leaves lines without a ranking, which
    ``orphaned`` finds, and never a ranking without lines.
    """
    stored = cut_lineage(ranked.withColumn("created_at", F.current_timestamp()))
    (stored if widen is None else widen(stored)).write.mode(mode).parquet(f"{folder}/ranking_items")
    rankings = stored.groupBy("ranking_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("created_at").alias("created_at")
    )
    rankings.select(
        "ranking_id", F.lit(model_version).alias("model_version"),
        F.lit(spec_version).alias("feature_spec_version"), "n_lines", "created_at",
    ).write.mode(mode).parquet(f"{folder}/rankings")


def ranking_writer(folder: str, model_version: str, spec_version: int):
    """The same as a ``foreachBatch`` function; a replayed batch overwrites its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        save_rankings(batch, f"{folder}/batch={batch_id}", model_version, spec_version, "overwrite")

    return write


def append_rows(df: DataFrame, folder: str, table: str, partition: str | None = None) -> None:
    """Feedback, outcomes, events and monitoring runs only ever grow."""
    writer = df.write.mode("append")
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(f"{folder}/{table}")


def write_report(parts: dict[str, DataFrame], folder: str) -> None:
    """Run report: one JSON folder per part (ledger, sweep, metrics ...)."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
