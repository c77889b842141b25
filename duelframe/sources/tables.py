"""The given tables and the experiment views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences

LINES_PER_SET = 5
SMALL_INPUT_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input that sits in one row group.

    Large inputs have enough row groups and are left alone.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SMALL_INPUT_BYTES else df


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw experiment rows: one shown headline with its outcome."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount",
        "l_tax", "l_shipdate",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    shown = F.col("l_quantity").cast("long")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_suppkey").alias("test_id"),
        F.col("l_returnflag").alias("image_id"),
        F.col("p_name").alias("headline"),
        F.when(F.col("l_discount") >= 0.05, shown).otherwise(F.lit(0).cast("long")).alias("clicks"),
        shown.alias("impressions"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_linestatus").alias("subset"),
        (F.col("l_tax") == 0).cast("int").alias("problem"),
    )


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document as a candidate line, in sets of five."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "text"))
    return rows.select(
        (F.col("doc_id") * 1000000 + F.floor(F.col("n") / LINES_PER_SET)).alias("ranking_id"),
        (F.col("n") % LINES_PER_SET).cast("long").alias("position"),
        "text",
        "doc_id",
    )


# Activity names of the closed list, by event type of the given table.
FUNNEL_NAMES = {
    "view": "landed",
    "click": "compare_clicked",
    "error": "disagreed",
    "signup": "account_created",
    "purchase": "outcome_reported",
}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = None
    for kind, mapped in FUNNEL_NAMES.items():
        test = F.col("event_type") == kind
        name = F.when(test, mapped) if name is None else name.when(test, mapped)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", name.alias("name"), "value", "props"
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved comparisons: orders, owned by 150 users."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ranking_id"),
        (F.col("o_custkey") % 150).alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def ranking_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the saved comparisons: order items with their product text."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_shipdate",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("ranking_id"),
        F.col("l_linenumber").cast("long").alias("rank"),
        F.col("p_name").alias("text"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("item_id"),
        F.col("l_shipdate").alias("created_at"),
        F.create_map(
            F.lit("quantity"), F.col("l_quantity"),
            F.lit("discount"), F.when(F.col("l_discount") > 0, F.col("l_discount")),
            F.lit("tax"), F.when(F.col("l_tax") > 0, F.col("l_tax")),
        ).alias("features"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).filter(F.col("name") == "disagreed").select(
        F.col("event_id").alias("feedback_id"),
        F.col("ts").alias("created_at"),
        "user_id",
        F.col("event_id").alias("ranking_id"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported results; the given values break some of the row rules."""
    k = F.get_json_object("props", "$.k").cast("long")
    return activity(spark, sf_dir).filter(F.col("name") == "outcome_reported").select(
        F.col("event_id").alias("outcome_id"),
        "user_id",
        F.col("event_id").alias("ranking_id"),
        (F.floor("value") - 5).alias("list_size"),
        F.when(k % 3 != 0, k - 10).alias("opens"),
        F.when(k % 5 != 0, F.floor(F.col("value") / 10)).alias("clicks"),
        (k / F.lit(80.0)).alias("share"),
    )


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed requests: events by type, with some failures and two orders for one target."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("target"), F.col("value").alias("ms"), (k % 10 != 0).alias("ok"),
        F.when((F.col("event_type") == "error") & (k % 2 == 1), "[1,0,2,3]").otherwise("[0,1,2,3]").alias("ranking"),
    )


def monitoring_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model_version"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 1000000).alias("max_psi"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model versions: users in twenty groups, measured on their events."""
    v = F.col("user_id") % 20
    hit = (F.col("value") > 10).cast("double")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    measured = table(spark, sf_dir, "events").select(
        v.alias("v"), hit.alias("hit"), early.alias("early"), "value"
    ).groupBy("v").agg(
        F.avg(F.when(F.col("early"), F.col("hit"))).alias("holdout_accuracy"),
        F.avg(F.when(~F.col("early"), F.col("hit"))).alias("user_accuracy"),
        F.count_if(~F.col("early")).alias("n_user_labels"),
        (F.max("value") * F.lit(2.5e-9)).alias("antisymmetry"),
    )
    return measured.select(
        F.concat(F.lit("v"), F.col("v").cast("string")).alias("version"),
        F.when(F.col("v") % 2 == 0, "linear").otherwise("trees").alias("algorithm"),
        F.when(F.col("v") == 0, "champion").when(F.col("v") % 4 == 1, "archived").otherwise("challenger").alias("status"),
        F.when(F.col("v") == 0, "champion").otherwise("challenger").alias("role"),
        F.when(F.col("v") % 7 == 6, 2).otherwise(1).alias("feature_spec_version"),
        (F.col("v") == 3).alias("synthetic"),
        (F.col("v") % 5 != 4).alias("export_passed"),
        F.lit(1e-6).alias("tolerance"),
        F.when(F.col("v") % 4 == 0, "agreed").alias("force"),
        "holdout_accuracy", "user_accuracy", "n_user_labels", "antisymmetry",
    )
