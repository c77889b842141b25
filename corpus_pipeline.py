"""Corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.byte_bpe import decode, encode
from duelframe.llm.common import fresh_name, quoted, remainder, shared_folder, table
from duelframe.llm.line_dedup import dedup_lines
from duelframe.llm.quality_fm import score_quality, train_quality
from duelframe.llm.simhash_trie import drop_near_copies
from duelframe.llm.spaced_seeds import clean_documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more.

    Learned from the labels of the documents given; null texts count as empty and are scored like others, null ids and
    labels are never learned from, and repeated rows share one score. An empty table, or one without labels of
    both classes, passes or fails as a whole by the share of good labels (none: 0.5, all stay).
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    score = fresh_name(docs.columns)
    return score_quality(docs, model, docs.columns, score).filter(F.col(score) >= 0.5).select(*map(quoted, docs.columns))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs go, and documents of which they leave no word; n_chars follows the text.

    Null, empty and wordless texts stay as they are. Of equal documents with different ids the first by (doc_id, text)
    stays, a null id first; rows that repeat an id and its text are one document and share its fate.
    """
    cleaned = dedup_lines(docs)
    cleaned = cleaned.filter((F.size("removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    n_chars = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*map(quoted, docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, null ids last, one row of those that repeat it.

    Null, empty and wordless texts are copies of each other. An empty table stays empty.
    """
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark text is found.

    Null and empty texts hold none and stay, as do all documents beside an empty benchmark. Rows that repeat an id are
    judged each by their own text.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and round_trip (decoding gives the text); columns of these names are replaced.

    Null and empty texts have no ids and come back as empty. Repeated rows stay.
    """
    vocabulary = public_tokenizers.path(VOCABULARY)
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "round_trip")]
    encoded = encode(docs, vocabulary, public_tokenizers.PATTERN, kept)
    same = decode(F.col("ids"), vocabulary) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select(*map(quoted, kept), "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", cut_lines),
    ("near_copies", drop_copies),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; a stage's rows are in the shared folder before the next one begins."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
