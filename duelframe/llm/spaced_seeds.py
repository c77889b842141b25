"""Benchmark decontamination by spaced seeds (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage

#: Token positions that a seed compares, counted from two neighbours (0, 1); the others may differ. Every 13 tokens or
#: more of which AGREE are equal hold one of these.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
#: For items under LONG tokens: every 5 tokens of which 4 are equal hold one.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (-2, 0, 1, 2))
LONG, SHORTEST = 13, 5
#: For items that must be found exactly, by their number of tokens; items of one token are looked up.
EXACT_MASKS = {2: (0, 1), 3: (0, 1, 2), 4: (0, 1, 2, 3)}
#: Tokens around a hit that are compared, and the share of them that must agree.
OVERLAP = 32
AGREE = 0.8
#: Tokens from which on an excerpt of an item counts, wherever it lies in the item.
EXCERPT = 13
#: Bits (as a power of two) of the map of token pairs that occur in the benchmark: 128 KB, whatever its size.
MAP_BITS = 20


def token_hashes(text: Column) -> Column:
    """Hashes of the words (A-Z lowered) of a text; an empty array for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(low, r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _pair_hashes(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.xxhash64(a, b))


def _seeds(tokens: str, places: Column, masks: dict[int, tuple[int, ...]]) -> Column:
    """(at, key) for each place from which a mask fits."""
    t, n = F.col(tokens), F.size(tokens)

    def seeds(number: int, mask: tuple[int, ...]) -> Column:
        fits = F.filter(places, lambda at: (at + mask[0] >= 0) & (at + (mask[-1] + 1) <= n))
        return F.transform(fits, lambda at: F.struct(
            at.alias("at"), F.xxhash64(F.lit(number), *(F.get(t, at + o) for o in mask)).alias("key")))

    return F.flatten(F.array(*(seeds(number, mask) for number, mask in masks.items())))


def _pair_map(items: DataFrame) -> Column:
    """A bit for each hash of neighbouring tokens of the benchmark, as an array of 2^MAP_BITS / 64 longs."""
    spark = items.sparkSession
    words = 1 << (MAP_BITS - 6)
    slots = items.select(F.explode(_pair_hashes(F.col("item"))).alias("p")).select((F.col("p").bitwiseAND(F.lit((1 << MAP_BITS) - 1))).alias("s"))
    bits = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    filled = spark.range(words).join(bits, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    line = filled.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"].cast("string")), ",")).first()[0]
    return F.split(F.lit(line), ",").cast("array<bigint>")


def _by_length(items: DataFrame) -> tuple[dict[int, tuple[int, ...]], DataFrame]:
    """The masks that the benchmark's items need, by number, and the items' seeds: (ino, length, key, item_at)."""
    every = F.sequence(F.lit(0), F.size("item") - 1)
    n = F.size("item")
    classes = [(n >= LONG, MASKS), ((n >= SHORTEST) & (n < LONG), SHORT_MASKS), *((n == k, (mask,)) for k, mask in EXACT_MASKS.items())]
    present = items.agg(*(F.count_if(which).alias(str(i)) for i, (which, _) in enumerate(classes))).first()
    masks, parts, number = {}, [], 0
    for (which, kinds), there in zip(classes, present):
        numbered = dict(enumerate(kinds, number))
        number += len(kinds)
        if there:
            masks |= numbered
        parts.append(items.filter(which).select("ino", n.alias("length"), F.explode(_seeds("item", every, numbered)).alias("s")))
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.unionByName(part)
    return masks, wanted.select("ino", "length", F.col("s.key").alias("key"), F.col("s.at").alias("item_at"))


def _windows(pairs: DataFrame) -> DataFrame:
    """compared and matched of each of the column ``windows``, where AGREE of the window do."""
    tried = pairs.withColumn("compared", F.least(F.size("item"), F.lit(OVERLAP))).withColumn("w", F.explode("windows"))
    same = F.aggregate(
        F.sequence(F.lit(0), F.col("compared") - 1), F.lit(0),
        lambda n, j: n + F.when(F.get("t", F.when(F.col("shift") + F.col("w") + j >= 0, F.col("shift") + F.col("w") + j)) == F.get("item", F.col("w") + j), 1).otherwise(0))
    return tried.withColumn("matched", same).filter(F.col("matched") >= AGREE * F.col("compared"))


def _excerpts(pairs: DataFrame, least: int) -> DataFrame:
    """compared and matched of the best run of ``least`` item tokens or more (of all, if there are fewer) on the diagonal.

    An equal token counts 1 and another one -4, so that a sum of 0 is an agreement of 0.8; the best run has the
    largest sum. One pass: the sum up to a token less the smallest sum up to ``least`` tokens before it.
    """
    place = lambda j: F.when(F.col("shift") + j >= 0, F.col("shift") + j)
    scores = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.when(F.get("t", place(j)) == F.get("item", j), 1).otherwise(-4))
    pairs = pairs.withColumn("scores", scores).withColumn("least", F.least(F.size("item"), F.lit(least)))
    fields = ("end", "sum", "before", "low", "low_at", "best", "first", "last")

    def step(a: Column, score: Column) -> Column:
        end, total = a["end"] + 1, a["sum"] + score
        behind = end - F.col("least") - 1
        before = a["before"] + F.when(behind >= 0, F.get("scores", behind)).otherwise(0)
        reached = behind >= -1
        lower = reached & (before < a["low"])
        low, low_at = F.when(lower, before).otherwise(a["low"]), F.when(lower, behind + 1).otherwise(a["low_at"])
        wins = reached & (total - low > a["best"])
        values = (end, total, before, low, low_at, F.when(wins, total - low).otherwise(a["best"]), F.when(wins, low_at).otherwise(a["first"]), F.when(wins, end).otherwise(a["last"]))
        return F.struct(*(v.cast("int").alias(f) for v, f in zip(values, fields)))

    zero = F.struct(*(F.lit(v).cast("int").alias(f) for v, f in zip((0, 0, 0, 1 << 30, 0, -1, 0, 0), fields)))
    run = pairs.withColumn("run", F.aggregate("scores", zero, step)).filter("run.best >= 0").withColumn("compared", F.expr("run.last - run.first"))
    return run.withColumn("matched", F.expr("(run.best + 4 * compared) div 5").cast("int"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, excerpt: int | None = None) -> DataFrame:
    """rid, doc_id, item_id, start, compared, matched: one row per document and benchmark text found in it.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Tokens are words, A-Z lowered. A seed is the
    hash of the tokens at the positions of a mask; seeds of documents and items meet in an equi-join, and the
    diagonal of each hit is compared (``start``: the document's token under the item's first one, negative if that
    was cut off). With ``excerpt`` (LONG or more) any run of so many item tokens of which AGREE are equal is found,
    or the whole item if it is shorter, and the best run is told. Without it AGREE of up to OVERLAP item tokens around
    the hit must be equal. Items with equal tokens are one item (smallest item_id). Items of under SHORTEST tokens are
    found exactly; null and empty texts nowhere. ``rid`` is a hash of doc_id and text; rows that repeat
    both are one document.

    Every place of a document is first tried against a bit map of the benchmark's token pairs of fixed
    size; only places that pass are hashed by the masks, and only those rows leave the scan.
    """
    if excerpt is not None and excerpt < LONG:
        raise ValueError(f"excerpts of under {LONG} tokens have no seed for certain")
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).filter(F.size("item") > 0)
    items = cut_lineage(items.groupBy("item").agg(F.min("item_id").alias("item_id")).withColumn("ino", F.monotonically_increasing_id()))
    masks, wanted = _by_length(items)

    known = _pair_map(items)
    rid = F.xxhash64("doc_id", "text").alias("rid")
    tokens = docs.select("doc_id", rid, token_hashes(F.col("text")).alias("t"))
    mask = F.lit((1 << MAP_BITS) - 1)

    def seen(pair: Column, at: Column) -> Column:
        slot = pair.bitwiseAND(mask)
        word = F.get(known, F.shiftright(slot, 6).cast("int"))
        return F.when(F.call_function("bit_get", word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1, at)

    placed = tokens.select("doc_id", "rid", "t", F.filter(F.transform(_pair_hashes(F.col("t")), seen), lambda i: i.isNotNull()).alias("places"))
    placed = placed.filter(F.size("places") > 0)
    seeds = placed.select("doc_id", "rid", F.explode(_seeds("t", F.col("places"), masks or {0: MASKS[0]})).alias("s"))
    hits = seeds.select("doc_id", "rid", F.col("s.key").alias("key"), F.col("s.at").alias("at")).join(wanted, "key")
    width = F.least("length", F.lit(OVERLAP))
    window = F.greatest(F.lit(0), F.least(F.col("item_at") + 3 - F.floor(width / 2).cast("int"), F.col("length") - width))
    hits = hits.select("doc_id", "rid", "ino", (F.col("at") - F.col("item_at")).alias("shift"), window.cast("int").alias("window"))
    ones = items.filter(F.size("item") == 1).select("ino", F.get("item", F.lit(0)).alias("token"))
    if not ones.isEmpty():
        single = tokens.select("doc_id", "rid", "t", F.explode(F.array_distinct("t")).alias("token")).join(ones, "token")
        hits = hits.unionByName(single.select("doc_id", "rid", "ino", (F.array_position("t", F.col("token")) - 1).cast("int").alias("shift"), F.lit(0).alias("window")))
    if excerpt is None:
        hits = hits.groupBy("doc_id", "rid", "ino", "shift").agg(F.collect_set("window").alias("windows"))
    else:
        hits = hits.select("doc_id", "rid", "ino", "shift").distinct()
    hits = cut_lineage(hits)

    texts = docs.select(rid, "text").join(hits.select("rid").distinct(), "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))
    texts = cut_lineage(texts.select("rid", token_hashes(F.col("text")).alias("t")))
    pairs = hits.join(texts, "rid").join(items, "ino")
    tried = _windows(pairs) if excerpt is None else _excerpts(pairs, excerpt)
    best = tried.groupBy("doc_id", "rid", "item_id").agg(F.max_by(F.struct("shift", "compared", "matched"), F.struct("matched", "compared", -F.col("shift"))).alias("best"))
    return best.select("rid", "doc_id", "item_id", F.col("best.shift").alias("start"), F.col("best.compared").alias("compared"), F.col("best.matched").alias("matched"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark text or excerpt of one is found, with all their columns."""
    found = find_overlaps(docs.select("doc_id", "text"), benchmark, EXCERPT).select(F.col("rid").alias("_found")).distinct()
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_found"), "left_anti")
