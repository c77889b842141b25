"""TF-IDF variant: word 1-2-grams and in-word character 3-5-grams, in long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE_CLASS, WIDE_SPACES
from .document_terms import document_terms

MIN_DF = 3


def word_terms(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, and neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))
    two = F.zip_with(words, F.slice(words, 2, 1000000000), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(two, lambda t: t.isNotNull()))


def char_terms(text: Column, distinct: bool = False) -> Column:
    """Character 3-5-grams inside space-padded words; a short word counts once.  ``distinct``: of each different word once."""
    words = F.filter(F.split(F.lower(text), f"[{WHITESPACE_CLASS}]+"), lambda w: w != "")
    words = F.array_distinct(words) if distinct else words

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.char_length(padded)
        lengths = F.filter(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: (n == 3) | (n - 1 < size))
        return F.flatten(
            F.transform(
                lengths,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
                    lambda at: F.substr(padded, at, n),
                ),
            )
        )

    return F.flatten(F.transform(words, grams))


def term_counts(texts: DataFrame, keys: Sequence[str], text: str, kinds: Sequence[str] = ("word", "char")) -> DataFrame:
    """(keys, kind, term, tf)."""
    makers = {"word": word_terms, "char": char_terms}
    parts = [
        texts.select(*keys, F.lit(k).alias("kind"), F.explode(makers[k](F.col(text))).alias("term"))
        for k in kinds
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys, "kind", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(texts: DataFrame, text: str, min_df: int = MIN_DF) -> DataFrame:
    """Document frequency per word and character term.

    Tasks count pieces of texts (``document_terms``), so only the terms of a piece are rows, not those of each text. What
    is white space or no word beyond ASCII is marked here, by Spark's own tables of characters.
    """
    dark = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[{WIDE_SPACES}]", " ")
    plain = F.regexp_replace("_dark", "[^\\p{L}\\p{N}_\\x{0}-\\x{7F}]", " ")
    marked = texts.select(dark.alias("_dark")).select("_dark", plain.alias("_plain"))
    rows = marked.mapInArrow(document_terms, "kind string, term string, df bigint")
    # Dealt before they are added up: most terms come in few pieces, and a task that held all of its own would sort them on disk.
    return rows.repartition("kind", "term").groupBy("kind", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_df)


def pair_sides(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """(headline, occurrences) over both sides of the pairs: the training documents. ``weight``: how many pairs a row is."""
    times = F.lit(1) if weight is None else F.col(weight)
    sides = pairs.select(F.explode(F.array("headline_a", "headline_b")).alias("headline"), times.alias("times"))
    return sides.groupBy("headline").agg(F.sum("times").alias("occurrences"))


def fit_idf(pairs: DataFrame, min_df: int = MIN_DF, weight: str | None = None) -> DataFrame:
    """(kind, term, df, idf) from training pairs only. ``weight``: how many pairs a row is.

    Terms are found once per distinct headline and weighted by its occurrences.
    """
    sides = pair_sides(pairs, weight)
    counts = term_counts(sides, ["headline", "occurrences"], "headline")
    df = counts.groupBy("kind", "term").agg(F.sum("occurrences").alias("df")).filter(F.col("df") >= min_df)
    total = sides.agg(F.sum("occurrences").alias("n"))
    one = F.lit(1)
    idf = F.ln((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    # ``total`` is one row.
    return (
        df.withColumn("_one", one).join(F.broadcast(total.withColumn("_one", one)), "_one")
        .select("kind", "term", "df", idf.alias("idf"))
    )


def headline_weights(headlines: DataFrame, idf: DataFrame) -> DataFrame:
    """(headline, kind, term, weight): (1 + ln tf) * idf, length 1 per kind."""
    counts = term_counts(headlines.select("headline").distinct(), ["headline"], "headline")
    raw = counts.join(idf, ["kind", "term"]).select(
        "headline", "kind", "term", ((F.lit(1.0) + F.ln("tf")) * F.col("idf")).alias("raw")
    )
    norms = raw.groupBy("headline", "kind").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, ["headline", "kind"]).select(
        "headline", "kind", "term", (F.col("raw") / F.col("norm")).alias("weight")
    )


def difference_terms(pairs: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, term, d): weights of a minus weights of b, terms that differ."""
    sides = pairs.select(
        *keys,
        F.inline(F.array(
            F.struct(F.col("headline_a").alias("headline"), F.lit(1.0).alias("sign")),
            F.struct(F.col("headline_b").alias("headline"), F.lit(-1.0).alias("sign")),
        )),
    )
    return (
        sides.join(weights, "headline")
        .groupBy(*keys, "kind", "term").agg(F.sum(F.col("sign") * F.col("weight")).alias("d"))
        .filter(F.abs("d") > 0)
    )


def text_sizes(texts: DataFrame, weights: DataFrame, least: float = 1e-9) -> DataFrame:
    """(headline_a, headline_b, kind, n_terms, sq_norm) of distinct pairs of texts: terms that differ by more than ``least``."""
    sides = ["headline_a", "headline_b"]
    terms = difference_terms(texts, weights, sides).filter(F.abs("d") > least)
    return terms.groupBy(*sides, "kind").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("d") * F.col("d")).alias("sq_norm"))


def difference_sizes(pairs: DataFrame, weights: DataFrame, keys: Sequence[str], least: float = 1e-9) -> DataFrame:
    """(keys, kind, n_terms, sq_norm): terms that differ by more than ``least`` and their squared length.

    Terms are compared once per distinct pair of texts; only the sizes meet the pairs.  ``keys`` name a pair.
    """
    texts = ["headline_a", "headline_b"]
    sizes = text_sizes(pairs.select(*texts).distinct(), weights, least)
    return pairs.join(sizes, texts).select(*keys, "kind", "n_terms", "sq_norm")
