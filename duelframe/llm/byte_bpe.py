"""Byte-level BPE: encoding by ranked merges over the bytes of distinct words, decoding by joining pieces."""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import pieces, quoted, utf8

#: Distinct words whose ids a task remembers; beyond, it starts anew.
REMEMBERED = 300_000
#: Words of more bytes are folded with a heap.
SHORT = 64
_BUCKETS = 1 << 16


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of a base64 piece and its rank. The file's size bounds what tasks hold."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: of all neighbouring pieces whose union has a rank, the lowest (leftmost) is joined, until none has."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best = min((r for r in found if r is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = found.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a linked list of pieces and a heap of (rank, place)."""
    n = len(word)
    ends = list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:ends[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else n
        if j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:ends[i]]])
        i = after[i]
    return out


def encode(docs: DataFrame, vocabulary: str, pattern: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and ``ids`` (array of int) for the whole ``text`` of every row.

    Every match of ``pattern`` is a word and encoded by itself, without special tokens. A task folds each
    distinct word once while it remembers it; nothing is shuffled. Null and empty texts have no ids.
    ``vocabulary`` is the path of a rank file that every executor has.
    """
    names = [f"_c{i}" for i in range(len(carry))]

    def rows(batches):
        ranks, split, known = read_ranks(vocabulary), regex.compile(pattern), {}
        for batch in pieces(batches, "_data"):
            out = []
            for data in batch.column("_data").to_pylist():
                words = split.findall(data.decode("utf-8", "replace"))
                ids: list[int] = []
                for w in words:
                    found = known.get(w)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[w] = fold_merges(w.encode(), ranks)
                    ids += found
                out.append(pa.array(ids, pa.int32()))
            offsets = [0]
            for ids in out:
                offsets.append(offsets[-1] + len(ids))
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(out) if out else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, column], [*names, "ids"])

    given = docs.select(*(quoted(c).alias(n) for c, n in zip(carry, names)), utf8("text").alias("_data"))
    schema = given.drop("_data").schema.add("ids", docs.sparkSession.range(0).select(F.array(F.lit(0))).schema[0].dataType)
    return given.mapInArrow(rows, schema).select(*(F.col(n).alias(c) for c, n in zip(carry, names)), "ids")


def _piece_list(vocabulary: str) -> Column:
    """Pieces in hex by id, as one folded literal."""
    ranks = read_ranks(vocabulary)
    by_id = {i: p.hex() for p, i in ranks.items()}
    return F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")


def decode(ids: Column, vocabulary: str) -> Column:
    """Bytes of a list of ids: the binary pieces, one after the other. Null for null; an unknown id makes it null."""
    table = _piece_list(vocabulary)
    found = F.transform(ids, lambda i: F.get(table, i))
    return F.when(~F.exists(found, lambda p: p.isNull() | (p == "")), F.unhex(F.array_join(found, "")))


def fold_words(words: DataFrame, vocabulary: str, column: str = "word") -> DataFrame:
    """Adds ``ids`` to a table of distinct words with higher-order functions alone.

    The rank map is a literal of _BUCKETS small maps, chosen by a checksum of the joined piece. Each step of
    the fold joins one pair; words without pairs left stay as they are. Null stays null.
    """
    ranks = read_ranks(vocabulary)
    rows: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        rows[zlib.crc32(piece) % _BUCKETS].append(f'"{piece.hex().upper()}":{rank}')
    table = F.from_json(F.lit("[" + ",".join("{" + ",".join(r) + "}" for r in rows) + "]"), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(table, (F.crc32(F.unhex(piece)) % _BUCKETS).cast("int")), piece)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(parts: Column, _: Column) -> Column:
        n = F.size(parts)
        found = F.zip_with(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: rank(F.concat(a, b)))

        def merged(got: Column) -> Column:
            at = F.array_position(got, F.array_min(got)).cast("int")
            both = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
            return F.when(F.array_min(got).isNull(), parts).otherwise(
                F.concat(F.slice(parts, 1, at - 1), both, F.slice(parts, at + 2, F.greatest(n - at - 1, F.lit(0)))))

        return let(found, merged)

    data = F.hex(F.col(column).cast("binary"))
    size = F.octet_length(column)
    start = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(data, 2 * i + 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>")), start, step)
    return words.withColumn("ids", F.when(F.col(column).isNotNull(), F.transform(folded, rank)))
