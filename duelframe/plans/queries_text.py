"""Registered queries: text features, vectors, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import FEATURE_NAMES, long_features, with_features
from ..functions.phrases import PHRASES
from ..functions.stats import rounded
from ..operators import tfidf, vectors
from ..session import cut_lineage
from ..sources import tables
from .oracle_text import FAMILIES
from .queries_pairs import labelled_pairs


def _rounded(df, names=FEATURE_NAMES):
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[rounded(F.col(n)).alias(n) for n in names])


def _text_features(spark, sf_dir):
    return _rounded(with_features(tables.documents(spark, sf_dir, "doc_id", "text"), "text", ["doc_id"]))


def _family(names):
    def run(spark, sf_dir):
        turns = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
        return _rounded(with_features(tables.spread(turns), "text", ["conv_id", "turn"], names), names)
    return run


def diffs(spark, sf_dir):
    """Differences of the labelled pairs, which are stored once: their texts are read twice more."""
    return vectors.difference_vectors(cut_lineage(labelled_pairs(spark, sf_dir)))


def _feature_diff_vectors(spark, sf_dir):
    d = [rounded(F.get("d", F.lit(i))).alias(f"d_{n}") for i, n in enumerate(FEATURE_NAMES)]
    return diffs(spark, sf_dir).select("test_id", "image_id", "headline_a", "headline_b", *d)


def _feature_support(spark, sf_dir):
    return vectors.feature_support(diffs(spark, sf_dir)).select(
        "feature", rounded(F.col("support")).alias("support"), (F.col("support") < vectors.MIN_SUPPORT).alias("dropped")
    )


def _excluded(spark, sf_dir):
    support = cut_lineage(vectors.feature_support(diffs(spark, sf_dir)))
    every = support.select("feature")
    return every.exceptAll(support.filter(F.col("support") >= vectors.MIN_SUPPORT).select("feature"))


def _augment(spark, sf_dir):
    at = lambda n: F.sum(F.get("d", F.lit(FEATURE_NAMES.index(n))))
    return vectors.mirrored(diffs(spark, sf_dir)).groupBy("test_id", "image_id", "sign").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("n_positive"),
        rounded(at("char_count")).alias("sum_char_count"),
        rounded(at("flesch_reading_ease"), 4).alias("sum_flesch"),
    )


def _vocabulary(spark, sf_dir):
    texts = tables.table(spark, sf_dir, "documents").select("text")
    # A file for each core: texts are read where they lie.
    spread = len(texts.inputFiles()) >= spark.sparkContext.defaultParallelism
    return tfidf.vocabulary(texts if spread else tables.spread(texts), "text")


def _phrase_coverage(spark, sf_dir):
    """Which features texts use, and whether each has a plain description."""
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    wide = with_features(docs, "text", []).agg(*[F.count_if(F.col(n) != 0).alias(n) for n in FEATURE_NAMES])
    return long_features(wide, []).select(
        "feature", F.col("value").alias("n_used"), F.col("feature").isin(*PHRASES).alias("has_phrase")
    )


def _feature_diff(spark, sf_dir):
    """Features of the documents with and without their last marks, all 52, cell by cell."""
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    bare = docs.withColumn("text", F.regexp_replace("text", "[.!?]+$", ""))
    first, second = (_rounded(with_features(df, "text", ["doc_id"])) for df in (docs, bare))
    found = vectors.table_diff(first, second, ["doc_id"], FEATURE_NAMES, 1e-5)
    shown = F.array_join(F.transform("examples", lambda e: e["doc_id"].cast("string")), ",")
    return found.select(
        "feature", "n_cells", "n_divergent", rounded(F.col("max_delta")).alias("max_delta"), F.col("worst.doc_id").alias("worst_doc"), shown.alias("example_docs"))


def _url_hosts(spark, sf_dir):
    """Only the host of a referring address is kept."""
    pages = tables.table(spark, sf_dir, "pages").select("url")
    return pages.groupBy(F.expr("parse_url(url, 'HOST')").alias("host")).agg(F.count(F.lit(1)).alias("n_pages"))


QUERIES = {
    "text_features": _text_features,
    **{name: _family(names) for name, names in FAMILIES.items()},
    "feature_diff_vectors": _feature_diff_vectors,
    "feature_support": _feature_support,
    "excluded_features": _excluded,
    "augment_pairs": _augment,
    "vocabulary": _vocabulary,
    "phrase_coverage": _phrase_coverage,
    "feature_diff": _feature_diff,
    "url_hosts": _url_hosts,
}
