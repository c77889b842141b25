"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows_per_class: int, columns: list[Column]) -> DataFrame:
    """At most ``rows_per_class`` documents of each class, the same ones in every run.

    Ids are drawn by the order of a hash from the labels that ``learn`` admits and for which a document
    exists; a doc_id with contradicting labels takes the smaller one. Null ids, null labels and ids that
    several documents bear are left out. The drawn ids are at most 2 x ``rows_per_class``, so that they may
    be broadcast.
    """
    admitted = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    admitted = admitted.groupBy("doc_id").agg(F.min(label).alias("y"))
    single = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    admitted = admitted.join(single, "doc_id", "left_semi")
    order = [F.xxhash64(F.lit("draw"), F.col("doc_id")), F.col("doc_id")]
    drawn = [admitted.filter(F.col("y") == y).orderBy(*order).limit(rows_per_class) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    return docs.select(F.col("doc_id"), *columns).join(F.broadcast(ids), "doc_id")
