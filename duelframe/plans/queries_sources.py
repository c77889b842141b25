"""Registered queries: archives, sinks and reports, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, ranking
from ..session import cut_lineage, shared_folder
from ..sources import archive, sinks, tables
from .queries_pairs import _rounded_rates

# Subset of the archive that each half of the packages plays.
_HALVES = {"confirmatory": "F", "exploratory": "O"}


def _written_archive(spark, sf_dir) -> dict[str, list[str]]:
    """The packages as CSV parts per subset, headlines of every seventh test with a line break, timestamps as text in two shapes."""
    stamp = F.when(F.col("test_id") % 2 == 0, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    raw = tables.packages(spark, sf_dir).withColumn("created_at", stamp)
    broken = F.when(F.col("test_id") % 7 == 0, F.concat(F.lit('<\n"'), "headline", F.lit('"\n>'))).otherwise(F.col("headline"))
    raw = raw.withColumn("headline", broken).withColumnsRenamed({new: old for old, new in archive.RENAMED.items()})
    folder = shared_folder(spark, "archive")
    # Both subsets in one pass over the packages, each in a folder of its own.
    rows = raw.filter(F.col("subset").isin(*_HALVES.values()))
    rows.write.option("maxRecordsPerFile", 20000).partitionBy("subset").csv(folder, header=True, quote='"', escape='"')
    written = archive.discover_files(spark, folder, {"all": "part-*.csv"}, parts=True).get("all", [])
    files = {subset: [p for p in written if f"/subset={half}/" in p] for subset, half in _HALVES.items()}
    return {subset: paths for subset, paths in files.items() if paths}


def _archive_arms(spark, sf_dir):
    counts = {r["subset"]: (r["tests"], r["packages"]) for r in tables.packages(spark, sf_dir).groupBy("subset").agg(
        F.countDistinct("test_id").alias("tests"), F.count(F.lit(1)).alias("packages")).collect()}
    expected = {subset: counts.get(half, (0, 0)) for subset, half in _HALVES.items()}
    loaded = archive.load_all(spark, _written_archive(spark, sf_dir), expected)
    # The line breaks and quotation marks that were put around headlines, taken off again.
    bare = F.regexp_replace("headline", r'(?s)^<\n"(.*)"\n>$', "$1")
    arms = clean.build_arms(loaded.withColumn("headline", bare))
    return _rounded_rates(arms.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))


def _archive_manifest(spark, sf_dir):
    expected = {"confirmatory": (0, tables.packages(spark, sf_dir).filter("subset = 'F'").count()), "exploratory": (0, -1)}
    found = archive.manifest(spark, _written_archive(spark, sf_dir), expected)
    return found.select("subset", "data_rows", "expected_packages", "rows_match", (F.length("digest") == 64).alias("hashed"))


def _saved_rankings(spark, sf_dir):
    folder = shared_folder(spark, "saved")
    ranked = ranking.rank_line_sets(tables.lines(spark, sf_dir).drop("doc_id"))
    ranked = ranked.select("ranking_id", "position", "text", "rank", "score")
    sinks.save_rankings(ranked, folder, "hand-1", 1, widen=sinks.with_feature_maps)
    items = spark.read.parquet(f"{folder}/ranking_items").groupBy("ranking_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.round(F.sum(F.col("features")["char_count"])).cast("long").alias("n_chars"))
    saved = spark.read.parquet(f"{folder}/rankings").select("ranking_id", "model_version", "n_lines")
    return saved.join(items, "ranking_id")


def _appended_outcomes(spark, sf_dir):
    """Outcomes appended in two parts, by user."""
    folder, rows = shared_folder(spark, "log"), cut_lineage(tables.outcomes(spark, sf_dir))
    for part in (0, 1):
        sinks.append_rows(rows.filter(F.col("user_id") % 2 == part), folder, "outcomes")
    return spark.read.parquet(f"{folder}/outcomes").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("clicks").cast("long").alias("clicks"))


def _run_report(spark, sf_dir):
    """The row ledger as a JSON part of a run report."""
    folder = shared_folder(spark, "report")
    sinks.write_report({"ledger": clean.package_ledger(tables.packages(spark, sf_dir))}, folder)
    return spark.read.schema("seq bigint, stage string, remaining bigint").json(f"{folder}/ledger")


QUERIES = {
    "archive_arms": _archive_arms,
    "archive_manifest": _archive_manifest,
    "saved_rankings": _saved_rankings,
    "appended_outcomes": _appended_outcomes,
    "run_report": _run_report,
}
