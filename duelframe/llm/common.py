"""Pieces that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import cut_lineage

__all__ = ["cut_lineage", "fresh_name", "lower_words", "pieces", "quoted", "remainder", "shared_folder", "table", "utf8"]

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def lower_words(data: bytes) -> list[bytes]:
    """Words of a text: runs without space and control white space, A-Z lowered."""
    return data.translate(_LOWER).split()


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(*taken: list[str]) -> str:
    """A column name that none of the given frames uses."""
    used = {c.lower() for names in taken for c in names}
    name = "_key"
    while name in used:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one piece holds about ``most_bytes`` of a binary column (one row at least)."""
    for batch in batches:
        start, held = 0, 0
        for i, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if i > start and held + (length or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the one that all executors share."""
    cut_root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if cut_root is None:
        cut_lineage(spark.range(1))
        cut_root = spark.sparkContext.getCheckpointDir()
    return f"{cut_root}/{label}-{uuid.uuid4().hex}"
