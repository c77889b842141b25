"""Token positions inside a text, in code points, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import bind
from .text import FULL

SPAN_TYPE = "array<struct<token:string,start:int,end:int>>"
_APOSTROPHES = "'’"
#: Pieces of one block: offsets are added up inside blocks and then over blocks, so that a long text costs little more per piece.
BLOCK = 128


def spans(text: Column) -> Column:
    """Tokens with start and end. Null for null.

    A text is cut into runs of token characters and runs of others; their lengths, added up, are the offsets.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"[{FULL['token']}]+|[^{FULL['token']}]+"), F.lit(0))
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pieces) / BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)),
    )
    kind = "array<struct<piece:string,at:int>>"

    def placed(block: Column, start: Column) -> Column:
        """The pieces of a block, each with its offset; ``at``: where the block ends."""
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + F.char_length(p)).alias("at"),
                F.concat(acc["out"], F.array(F.struct(p.alias("piece"), acc["at"].alias("at")))).alias("out"),
            ),
        )

    starts = F.aggregate(
        blocks, F.array(F.lit(0)),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(F.array_join(b, "")))),
    )
    every = F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: placed(b, s)["out"]))

    def token(p: Column) -> Column:
        bare = F.ltrim(p["piece"], F.lit(_APOSTROPHES))
        start = p["at"] + F.char_length(p["piece"]) - F.char_length(bare)
        kept = F.rtrim(bare, F.lit(_APOSTROPHES))
        return F.struct(kept.alias("token"), start.cast("int").alias("start"), (start + F.char_length(kept)).cast("int").alias("end"))

    found = F.transform(F.filter(every, lambda p: p["piece"].rlike(f"^[{FULL['token']}]")), token)
    return F.filter(found, lambda s: s["token"] != "")


def folded(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("’"), F.lit("'"))


def spans_of(text: Column, words: Sequence[str]) -> Column:
    """Of the tokens of ``spans``, the first one and those that fold to one of ``words``.

    Offsets are added up for these alone, so a text without such words costs one search.
    """
    def found(pieces: Column) -> Column:
        placed = F.transform(pieces, lambda p, i: F.struct(
            F.when(p.rlike(f"^[{FULL['token']}]"), F.trim(p, F.lit(_APOSTROPHES))).otherwise("").alias("token"), i.alias("i")))
        kept = F.filter(F.filter(placed, lambda t: t["token"] != ""), lambda t, k: (k == 0) | folded(t["token"]).isin(*words))

        def located(t: Column) -> Column:
            bare = F.ltrim(F.get(pieces, t["i"]), F.lit(_APOSTROPHES))
            before = F.array_join(F.slice(pieces, F.lit(1), t["i"] + 1), "")
            start = F.char_length(before) - F.char_length(bare)
            return F.struct(t["token"].alias("token"), start.cast("int").alias("start"), (start + F.char_length(t["token"])).cast("int").alias("end"))

        return F.transform(kept, located)

    return bind(F.regexp_extract_all(text, F.lit(f"[{FULL['token']}]+|[^{FULL['token']}]+"), F.lit(0)), found)


def with_spans(df: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
    return df.withColumn(name, spans(F.col(text)))


def token_spans(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per token: keys, token, start, end."""
    rows = df.select(*keys, spans(F.col(text)).alias("spans")).select(*keys, F.explode("spans").alias("s"))
    return rows.select(
        *keys, "s.token", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end")
    )
