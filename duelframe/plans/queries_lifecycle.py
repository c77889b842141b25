"""Registered queries: gates, verdicts, registry, leakage audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import FEATURE_NAMES, banned_features
from ..functions.stats import rounded
from ..operators import lifecycle as L
from ..operators import splits, vectors
from ..session import cut_lineage
from ..sources import tables
from .queries_pairs import split_pairs


def _gates(spark, sf_dir):
    return L.promotion_gates(tables.registry(spark, sf_dir)).select(
        "version", F.array_join("failures", ", ").alias("failures"), F.array_join("warnings", ", ").alias("warnings"),
        "passed", "forced",
    )


def _verdict(spark, sf_dir):
    return L.promotion_verdict(tables.registry(spark, sf_dir)).select(
        "version", "verdict", "promote", rounded(F.col("holdout_gain")).alias("holdout_gain"),
        rounded(F.col("user_gain")).alias("user_gain"), "reason",
    )


def _audit(spark, sf_dir):
    pairs = splits.with_fold(split_pairs(spark, sf_dir))
    diffs = cut_lineage(vectors.difference_vectors(pairs))
    return L.leakage_audit(
        pairs, diffs, vectors.mirrored(diffs), FEATURE_NAMES, banned_features(FEATURE_NAMES)
    )


QUERIES = {
    "promotion_gates": _gates,
    "promotion_verdict": _verdict,
    "registry_check": lambda s, d: L.registry_check(tables.registry(s, d)),
    "registry_view": lambda s, d: L.registry_view(tables.registry(s, d)).withColumn("antisymmetry", F.round("antisymmetry", 12)),
    "alias_move": lambda s, d: L.move_champion(tables.registry(s, d), "v2").select("version", "status"),
    "leakage_audit": _audit,
}
