"""Which model may serve: gates, champion and challengers, registry, leakage audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import FEATURE_SPEC_VERSION

# ---- fixed values ------------------------------------------------------------
MIN_HOLDOUT_GAIN, MIN_USER_GAIN, MIN_USER_LABELS = 0.005, 0.0, 200
TOLERANCE = 1e-6
# ---- end of fixed values -----------------------------------------------------


def promotion_gates(registry: DataFrame, spec_version: int = FEATURE_SPEC_VERSION) -> DataFrame:
    """Gate results per version.

    Columns read: synthetic, feature_spec_version, export_passed, antisymmetry,
    tolerance, force (a reason, or null).  Only antisymmetry can be forced.
    """
    c = F.col
    lopsided = F.coalesce(c("antisymmetry") > F.coalesce("tolerance", F.lit(TOLERANCE)), F.lit(False))
    forced = F.coalesce(F.length("force") > 0, F.lit(False))
    fail = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    failures = F.array_compact(F.array(
        fail(c("synthetic"), "synthetic"),
        fail(~c("feature_spec_version").eqNullSafe(F.lit(spec_version)), "feature spec"),
        fail(~c("export_passed"), "export"),
        fail(lopsided & ~forced, "antisymmetry"),
    ))
    warnings = F.array_compact(F.array(fail(lopsided & forced, "antisymmetry")))
    gated = registry.withColumns({"failures": failures, "warnings": warnings})
    return gated.withColumns({
        "passed": F.size("failures") == 0,
        "forced": F.when(F.size("warnings") > 0, c("force")),
    })


def _signed(x: Column) -> Column:
    """Four digits with a sign."""
    return F.format_string("%+.4f", x)


def promotion_verdict(candidates: DataFrame) -> DataFrame:
    """Verdict per challenger against the single champion (column ``role``).

    Without a champion, or with several, and where an accuracy is missing, every challenger is held.
    """
    champion = candidates.agg(
        F.lit(1).alias("_one"), F.count_if(F.col("role") == "champion").alias("_champions"),
        *[F.max(F.when(F.col("role") == "champion", F.col(c))).alias(n) for c, n in (("holdout_accuracy", "_h"), ("user_accuracy", "_u"))],
    )
    # ``champion`` is one row.
    judged = (
        candidates.filter("role <> 'champion'").withColumn("_one", F.lit(1))
        .join(F.broadcast(champion), "_one")
        .withColumns({
            "holdout_gain": F.col("holdout_accuracy") - F.col("_h"),
            "user_gain": F.col("user_accuracy") - F.col("_u"),
        })
    )
    h, u, n = F.col("holdout_gain"), F.col("user_gain"), F.col("n_user_labels")
    enough, wins_h, wins_u = F.coalesce(n, F.lit(0)) >= MIN_USER_LABELS, h >= MIN_HOLDOUT_GAIN, u > MIN_USER_GAIN
    verdict = (
        F.when(F.col("_champions") == 0, "HELD: no champion")
        .when(F.col("_champions") > 1, "HELD: several champions")
        .when(F.col("antisymmetry") > TOLERANCE, "REJECTED: order dependent")
        .when(~enough, "HELD: too few user labels")
        .when(h.isNull() | u.isNull(), "HELD: accuracy missing")
        .when(wins_h & wins_u, "PROMOTE")
        .when(wins_h, "REJECTED: no user gain")
        .when(wins_u, "REJECTED: no holdout gain")
        .otherwise("REJECTED: worse on both")
    )
    decided = judged.withColumns({"verdict": verdict, "promote": verdict == "PROMOTE"})
    why = (
        F.when(F.col("verdict").contains("champion"), F.concat(F.col("_champions").cast("string"), F.lit(" champions")))
        .when(F.col("verdict").contains("missing"), F.lit("an accuracy is missing"))
        .when(F.col("verdict").startswith("HELD"), F.concat(n.cast("string"), F.lit(f" of {MIN_USER_LABELS} labels")))
        .when(F.col("verdict").contains("order"), F.lit(f"antisymmetry above {TOLERANCE:.0e}"))
        .otherwise(F.concat(F.lit("holdout "), _signed(h), F.lit(", user "), _signed(u)))
    )
    return decided.withColumn("reason", why).drop("_one", "_h", "_u", "_champions")


def registry_check(registry: DataFrame) -> DataFrame:
    """At most one champion."""
    champions = F.count_if(F.col("status") == "champion")
    return registry.agg(
        F.count(F.lit(1)).alias("n_models"), champions.alias("n_champions"),
        (champions <= 1).alias("one_champion_at_most"),
    )


def registry_view(registry: DataFrame) -> DataFrame:
    """Versions per algorithm with gate result and champion mark."""
    gated = promotion_gates(registry)
    return gated.select(
        "algorithm", "version", F.col("passed").alias("gate_passed"), "antisymmetry",
        (F.col("status") == "champion").alias("is_champion"),
    ).orderBy("algorithm", "version")


def move_champion(registry: DataFrame, version: str) -> DataFrame:
    """The named version becomes champion, the old one is archived (also a rollback)."""
    status = (
        F.when(F.col("version") == version, "champion")
        .when(F.col("status") == "champion", "archived")
        .otherwise(F.col("status"))
    )
    return registry.withColumn("status", status)


def check_row(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    """One audit line from one aggregated row."""
    return df.select(
        F.lit(name).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("ok"),
        detail.cast("double").alias("detail"),
    )


def leakage_audit(split_pairs: DataFrame, diffs: DataFrame, mirrored: DataFrame, names: list[str], banned: list[str]) -> DataFrame:
    """Data checks on a split: one row per check.

    ``split_pairs``: labelled pairs with ``holdout`` and ``fold``; ``diffs`` and
    ``mirrored``: their feature differences before and after mirroring.
    """
    spark = split_pairs.sparkSession
    count = lambda cond: F.count_if(cond)
    tests = split_pairs.groupBy("test_id").agg(
        F.countDistinct("fold").alias("n_folds"), F.countDistinct("holdout").alias("n_sides")
    ).agg(
        count(F.col("n_folds") > 1).alias("in_folds"), count(F.col("n_sides") > 1).alias("in_sides")
    )
    held = F.col("holdout")
    totals = split_pairs.agg(
        F.count(F.lit(1)).alias("n"), count(held).alias("n_held"), F.avg("label").alias("balance"),
        F.max(F.when(~held, F.col("created_at"))).alias("train_last"),
        F.min(F.when(held, F.col("created_at"))).alias("held_first"),
        F.count_if(F.col("subset") == "holdout").alias("locked"),
    )
    late = split_pairs.filter(~held).withColumn("_one", F.lit(1)).join(
        F.broadcast(totals.select(F.lit(1).alias("_one"), "held_first")), "_one"
    ).agg(count(F.col("created_at") >= F.col("held_first")).alias("late"))
    texts = diffs.groupBy("headline_a", "headline_b").agg(
        F.countDistinct(F.array_join(F.transform("d", lambda v: v.cast("string")), ",")).alias("n")
    ).agg(F.max("n").alias("n"))
    # Both directions of a pair, cell by cell; a missing direction counts as infinitely far.
    side = lambda s: F.max(F.when(F.col("sign") == s, F.col("d")))
    both = mirrored.groupBy("test_id", "image_id", "headline_a", "headline_b").agg(side(1).alias("_to"), side(-1).alias("_fro"))
    left = F.array_max(F.zip_with("_to", "_fro", lambda a, b: F.abs(a + b)))
    negation = both.agg(F.max(F.coalesce(left, F.lit(float("inf")))).alias("left"))
    one_row = spark.range(1)
    share = F.col("n_held").cast("double") / F.col("n")
    rows = [
        check_row(one_row, "no outcome name in a feature", F.lit(not banned), F.lit(len(banned))),
        check_row(one_row, "features in the specification", F.lit(len(names) == len(set(names))), F.lit(len(names))),
        check_row(texts, "same texts give the same vector", F.col("n") == 1, F.col("n")),
        check_row(tests, "no test in two folds", F.col("in_folds") == 0, F.col("in_folds")),
        check_row(tests, "no test on both sides", F.col("in_sides") == 0, F.col("in_sides")),
        check_row(late, "no training pair after the holdout starts", F.col("late") == 0, F.col("late")),
        check_row(totals, "holdout share 10-30 percent", share.between(0.10, 0.30), F.round(share, 6)),
        check_row(totals, "locked subset not loaded", F.col("locked") == 0, F.col("locked")),
        check_row(totals, "labels balanced", (F.col("balance") > 0.4) & (F.col("balance") < 0.6), F.round("balance", 6)),
        check_row(negation, "mirror is the exact negation", F.col("left") == 0, F.col("left")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
