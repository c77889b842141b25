"""Line dedup: winnowed fingerprints of line runs, matches extended both ways, later repeats deleted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import cut_lineage, pieces, quoted, utf8

#: A fingerprint covers whole lines with this many words at least; shorter repeats are left alone.
RUN_WORDS = 30
#: Fingerprints are chosen among starts that lie this many words apart at most: every repeat of
#: RUN_WORDS + SPREAD_WORDS words holds one.
SPREAD_WORDS = 20
#: Bytes of a line's digest.
_WIDE = 16


def line_digests(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """128-bit digests (over words joined by one space) in a row, number of words and line number of every line that has words."""
    digests, sizes, numbers = [], [], []
    for number, line in enumerate(data.split(b"\n")):
        words = line.split()
        if words:
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(words))
            numbers.append(number)
    return b"".join(digests), np.array(sizes, np.int64), np.array(numbers, np.int64)


def winnow(digests: bytes, sizes: np.ndarray, run: int = RUN_WORDS, spread: int = SPREAD_WORDS) -> tuple[list[int], list[bytes]]:
    """Chosen starts and their fingerprints (digests of the lines of the run).

    The run at a line is the fewest whole lines from there with ``run`` words. For every line, of the runs that
    start at it or up to ``spread`` words further on, the one with the least fingerprint is chosen (the last of equals).
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(before, before[:-1] + run)
    whole = int((ends <= len(sizes)).sum())  # a prefix: ends never fall
    if not whole:
        return [], []
    prints = [xxhash.xxh3_128_digest(digests[_WIDE * i:_WIDE * e]) for i, e in enumerate(ends[:whole].tolist())]
    last = np.minimum(np.searchsorted(before, before[:whole] + spread, side="right"), whole)
    chosen = set()
    queue: list[int] = []
    head = reach = 0
    for i in range(whole):
        while reach < last[i]:
            while len(queue) > head and prints[queue[-1]] >= prints[reach]:
                queue.pop()
            queue.append(reach)
            reach += 1
        while queue[head] < i:
            head += 1
        chosen.add(queue[head])
    at = sorted(chosen)
    return at, [prints[i] for i in at]


def windows_around(digests: bytes, sizes: np.ndarray, at: np.ndarray, run: int = RUN_WORDS, spread: int = SPREAD_WORDS) -> tuple[list[int], list[bytes]]:
    """Starts and digests of the windows that hold one of the runs at ``at`` whole.

    A window is the fewest whole lines with ``run`` + ``spread`` words from some line on, or up to some line. Every line of a
    repeat of so many words lies in a window of the repeat, and each of these holds a chosen run.
    """
    n, least = len(sizes), run + spread
    before = np.concatenate([[0], np.cumsum(sizes)])
    i = np.arange(n)
    e = np.searchsorted(before, before[:-1] + least)
    to = np.arange(1, n + 1)
    s = np.searchsorted(before, before[1:] - least, side="right") - 1
    start, end = np.concatenate([i[e <= n], s[s >= 0]]), np.concatenate([e[e <= n], to[s >= 0]])
    at = np.sort(at)
    run_ends = np.append(np.searchsorted(before, before[at] + run), n + 1)
    holds = run_ends[np.searchsorted(at, start)] <= end
    pairs = sorted(set(zip(start[holds].tolist(), end[holds].tolist())))
    return [a for a, _ in pairs], [xxhash.xxh3_128_digest(digests[_WIDE * a:_WIDE * b]) for a, b in pairs]


def extend(later: bytes, earlier: bytes, shift: int, anchors: list[int]) -> list[tuple[int, int]]:
    """Largest runs [a, b) around the anchors in which line i of ``later`` equals line i - shift of ``earlier``."""
    x, y = (np.frombuffer(d, np.uint64).reshape(-1, _WIDE // 8) for d in (later, earlier))
    lo, hi = max(shift, 0), min(len(x), len(y) + shift)
    same = (x[lo:hi] == y[lo - shift:hi - shift]).all(1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    begins, ends = edges[::2] + lo, edges[1::2] + lo
    at = np.array(anchors, np.int64)
    k = np.searchsorted(begins, at, side="right") - 1
    kept = np.unique(k[(k >= 0) & (at < ends[np.maximum(k, 0)])]) if len(begins) else []
    return [(int(begins[k]), int(ends[k])) for k in kept]


def without_runs(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list[dict], int]:
    """The text without the runs of lines that have words (and the blank lines inside), their line ranges, and the number of lines."""
    lines = data.split(b"\n")
    _, sizes, numbers = line_digests(data)
    gone = np.zeros(len(lines) + 1, bool)
    for a, b in runs:
        gone[numbers[a]:numbers[b - 1] + 1] = True
    if not gone.any():
        return data, [], len(lines)
    words = np.zeros(len(lines), np.int64)
    words[numbers] = sizes
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])))
    spans = [{"first": int(a), "last": int(b) - 1, "words": int(words[a:b].sum())} for a, b in zip(edges[::2], edges[1::2])]
    return b"\n".join(line for line, g in zip(lines, gone) if not g), spans, len(lines)


def _first_of(marks: DataFrame, key: str) -> DataFrame:
    """The first place (column here) of each key that occurs at several."""
    first = marks.groupBy(key).agg(F.min("here").alias("first"), F.max("here").alias("last"))
    return first.filter(~F.col("first").eqNullSafe(F.col("last"))).select(key, "first")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Deletes runs of lines that occurred earlier, by (doc_id, line), in any document.

    Gives all columns with ``text`` cleaned, and ``n_lines`` and ``removed`` (first and last line from 0,
    words); input columns of these two names are replaced. Lines are equal if their words are (128-bit digests). A
    fingerprint stands for whole lines with RUN_WORDS words; every occurrence but the first is matched with that first
    one. As the first one may stand in another passage, windows of RUN_WORDS + SPREAD_WORDS words around repeated
    fingerprints are matched with their own first occurrence as well. Matches are extended both ways over equal lines,
    and all their lines are deleted: every line that lies in a repeat of RUN_WORDS + SPREAD_WORDS words of some
    earlier place, and none outside repeats of RUN_WORDS words. Each deleted line has an equal one earlier that a
    chain of such steps leads to a kept one. Of lines in shorter repeats all stay, as do texts without deletion,
    byte by byte. Null texts stay null; null ids come first. Rows that repeat a doc_id and its text are one document
    and get the same result. One hot line or passage is one row of minima, and its occurrences meet only that.
    """
    # Two hashes: 128 bits.
    key = F.concat_ws("-", F.xxhash64(F.col("doc_id"), F.col("text")), F.xxhash64(F.lit("twice"), F.col("text"), F.col("doc_id")))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "removed")]

    def sign(batches):
        for batch in pieces(batches, "data"):
            out = []
            for data in batch.column("data").to_pylist():
                digests, sizes, _ = line_digests(data)
                out.append((digests, sizes.tolist(), *winnow(digests, sizes)))
            kinds = pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())
            arrays = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *arrays], ["doc_id", "rid", "lines", "sizes", "at", "prints"])

    given = docs.select("doc_id", key.alias("rid"), utf8("text").alias("data"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut_lineage(given.mapInArrow(sign, f"doc_id {kind}, rid string, lines binary, sizes array<int>, at array<bigint>, prints array<binary>"))
    marks = signed.select("doc_id", "rid", F.explode(F.arrays_zip("prints", "at")).alias("m")).select(
        F.col("m.prints").alias("print"), F.struct("doc_id", "rid", F.col("m.at").alias("at")).alias("here"))
    repeated = cut_lineage(marks.join(cut_lineage(_first_of(marks, "print")), "print").select("here", "first"))
    lines = cut_lineage(signed.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes")))

    def surround(batches):
        for batch in pieces(batches, "lines"):
            out = [windows_around(d, np.array(s, np.int64), np.array(a, np.int64)) for d, s, a in zip(*(batch.column(c).to_pylist() for c in ("lines", "sizes", "ats")))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("rid"), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.binary())),
            ], ["doc_id", "rid", "at", "windows"])

    around = repeated.groupBy(F.col("here.rid").alias("rid")).agg(F.collect_set("here.at").alias("ats")).join(lines, "rid")
    around = around.select("doc_id", "rid", "lines", "sizes", "ats").mapInArrow(surround, f"doc_id {kind}, rid string, at array<bigint>, windows array<binary>")
    wide = cut_lineage(around.select("doc_id", "rid", F.explode(F.arrays_zip("windows", "at")).alias("m")).select(
        F.col("m.windows").alias("window"), F.struct("doc_id", "rid", F.col("m.at").alias("at")).alias("here")))
    hits = repeated.unionByName(wide.join(cut_lineage(_first_of(wide, "window")), "window").select("here", "first"))
    pairs = cut_lineage(hits.filter(~F.col("here").eqNullSafe(F.col("first"))).groupBy(
        F.col("here.rid").alias("rid"), F.col("first.rid").alias("source"), (F.col("here.at") - F.col("first.at")).alias("shift"),
    ).agg(F.collect_set("here.at").alias("anchors")))
    met = pairs.join(lines.select(F.col("rid").alias("source"), F.col("lines").alias("earlier")), "source")
    met = met.join(lines.select("rid", F.col("lines").alias("later")), "rid")

    def grow(batches):
        for batch in pieces(batches, "later"):
            rids, begins, ends = [], [], []
            for rid, shift, anchors, later, earlier in zip(*(batch.column(c).to_pylist() for c in ("rid", "shift", "anchors", "later", "earlier"))):
                for a, b in extend(later, earlier, shift, sorted(anchors)):
                    rids.append(rid)
                    begins.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["rid", "a", "b"])

    grown = met.select("rid", "shift", "anchors", "later", "earlier").mapInArrow(grow, "rid string, a bigint, b bigint")
    cuts = cut_lineage(grown.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("runs")))

    def clean(batches):
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("words", pa.int64())]))
        for batch in pieces(batches, "data"):
            out = [without_runs(d, [(r["a"], r["b"]) for r in runs or []]) for d, runs in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([o[0].decode() for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[1] for o in out], spans),
            ], ["row", "cleaned", "n_lines", "removed"])

    rows = docs.select(F.struct(*(quoted(c) for c in names)).alias("row"), utf8("text").alias("data"), key.alias("rid"))
    rows = rows.join(cuts, "rid", "left").select("row", "data", "runs")
    made = "cleaned string, n_lines bigint, removed array<struct<first:bigint,last:bigint,words:bigint>>"
    schema = T.StructType([*rows.select("row").schema, *T.StructType.fromDDL(made)])
    cleaned = rows.mapInArrow(clean, schema)

    def column(name: str) -> Column:
        if name.lower() == "text":
            return F.when(F.col("row").getField(name).isNotNull(), F.col("cleaned")).alias(name)
        return F.col("row").getField(name).alias(name)

    return cleaned.select(*(column(c) for c in names), "n_lines", "removed")
