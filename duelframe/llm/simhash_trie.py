"""Near copies by SimHash: fingerprints that differ in few bits, found by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from duelframe.llm.common import cut_lineage, fresh_name, lower_words, pieces, quoted, utf8
from duelframe.llm.components import Forest, components

SEED = 42
#: Rows of one trie that a task takes; larger groups are cut into blocks that meet in pairs.
BLOCK_ROWS = 4096
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 19
_STEP = 1 << 14


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces; of the whole text if it has fewer; none of none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: n - size + 1].tolist()
    parts = (whole[a:b] for a, b in zip(begins, ends[size - 1:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(begins))


def _more_bits(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits for each hash (k = 0: the hash itself), by a mixing step of additions and multiplications."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Bits that are set in over half of the hashes, highest bit first; all 0 without hashes."""
    out = []
    for k in range(bits // 64):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), _STEP):
            part = _more_bits(hashes[i:i + _STEP], k).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def with_fingerprints(docs: DataFrame, name: str, size: int = 3, bits: int = 64) -> DataFrame:
    """Adds the fingerprint of every whole text as bytes; null texts count as empty."""
    columns = docs.columns

    def rows(batches):
        for batch in pieces(batches, "_data"):
            found = [fingerprint(shingle_hashes(lower_words(d or b""), size), bits) for d in batch.column("_data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(found, pa.binary())], [*names, "_fp"])

    names = [f"_c{i}" for i in range(len(columns))]
    given = docs.select(*(quoted(c).alias(n) for c, n in zip(columns, names)), utf8("text").alias("_data"))
    schema = given.drop("_data").schema.add("_fp", "binary")
    return given.mapInArrow(rows, schema).select(*(F.col(n).alias(c) for c, n in zip(columns, names)), F.col("_fp").alias(name))


def _turned(keys: np.ndarray, offset: int) -> np.ndarray:
    """Rows of bytes with the bit at ``offset`` first."""
    whole, rest = divmod(offset, 8)
    keys = np.roll(keys, -whole, axis=1)
    if not rest:
        return keys
    wide = keys.astype(np.uint16)
    return ((wide << rest | np.roll(wide, -1, axis=1) >> (8 - rest)) & 255).astype(np.uint8)


def trie_links(
    keys: np.ndarray, groups: np.ndarray, depth: int, budget: int, forest: Forest | None = None, counted: int | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that differ in at most ``budget`` bits.

    With a ``forest``, to which the caller adds what it gets, pairs of nodes whose rows are all connected
    already are left out: enough for components. Of longer keys only the first ``counted`` bits (a multiple of
    64) are compared; the others tell rows apart.

    ``keys``: bytes of each row, sorted within its group; the rows of a group agree in their first ``depth``
    bits. ``groups``: where each group begins, and the end. A node is the range of rows below a prefix. Pairs
    of nodes go down together: equal branches keep the number of differing bits, unequal ones add one, and
    a pair over budget is dropped. Two single rows are compared in whole.
    """
    n, width = keys.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = keys
    counted = 8 * width if counted is None else counted
    words = words.view(np.uint64)[:, : -(-counted // 64)]
    ones: dict[int, np.ndarray] = {}
    lo, hi = groups[:-1], groups[1:]
    many = hi - lo > 1
    todo = [(depth, *(x[many] for x in (lo, hi, lo, hi)), np.zeros(int(many.sum()), np.int64))]
    while todo:
        d, a, a_end, b, b_end, diff = todo.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [(d, *(x[half:] for x in (a, a_end, b, b_end, diff))), (d, *(x[:half] for x in (a, a_end, b, b_end, diff)))]
            continue
        if forest is not None:
            root = forest.root
            turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            apart = (turns[a_end - 1] != turns[a]) | (turns[b_end - 1] != turns[b]) | (root[a] != root[b])
            a, a_end, b, b_end, diff = (x[apart] for x in (a, a_end, b, b_end, diff))
        single = (a_end - a == 1) & (b_end - b == 1)
        u, v = a[single], b[single]
        near = (u != v) & (np.bitwise_count(words[u] ^ words[v]).sum(1, dtype=np.int64) <= budget)
        if near.any():
            yield u[near], v[near]
        a, a_end, b, b_end, diff = (x[~single] for x in (a, a_end, b, b_end, diff))
        if not len(a) or d >= 8 * width:
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum(keys[:, d // 8] >> (7 - d % 8) & 1, dtype=np.int64)])
        c = ones[d]
        a_mid, b_mid = a_end - (c[a_end] - c[a]), b_end - (c[b_end] - c[b])
        same, cost = a == b, int(d < counted)
        parts = [
            (a, a_mid, b, b_mid, diff, slice(None)), (a_mid, a_end, b_mid, b_end, diff, slice(None)),
            (a, a_mid, b_mid, b_end, diff + cost, slice(None)), (a_mid, a_end, b, b_mid, diff + cost, ~same),
        ]
        joined = [np.concatenate([p[i][p[5]] for p in parts]) for i in range(5)]
        alive = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        todo.append((d + 1, *(x[alive] for x in joined)))


def near_links(prints: DataFrame, bits: int, budget: int, segments: list[tuple[int, int]]) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of at most ``budget`` differing bits.

    Each segment (offset, length) is the top of one trie, in which pairs must agree: with more segments than
    ``budget`` every pair agrees in one of them, and none is lost. Tasks emit a spanning forest of their
    links, never more rows than fingerprints. A group of more than BLOCK_ROWS rows is cut by hash into blocks
    and every two blocks meet in a task of their own.
    """
    def spread(batches):
        for batch in batches:
            raw = batch.column("fp").to_pylist()
            if not raw:
                continue
            keys = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), bits // 8)
            for j, (offset, length) in enumerate(segments):
                turned = _turned(keys, offset)
                top = np.zeros(len(raw), np.int64)
                for i in range(-(-length // 8)):
                    top = top << 8 | turned[:, i]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(raw), j, np.int32)), pa.array(top >> (-length % 8)), pa.array(list(map(bytes, turned)), pa.binary()),
                ], ["trie", "top", "turned"])

    spread_rows = prints.select("fp").mapInArrow(spread, "trie int, top bigint, turned binary")
    sizes = spread_rows.groupBy("trie", "top").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))
    keyed = spread_rows.join(sizes, ["trie", "top"])
    own = F.pmod(F.xxhash64("turned"), F.col("blocks")).cast("int")
    met = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: other != own))
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(met))
    keyed = keyed.select("trie", "top", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "turned")
    key = ["trie", "top", "i", "j"]
    keyed = keyed.repartition(*key).sortWithinPartitions(*key, "turned")

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: (group, trie, turned), whole groups in order."""
        group = np.array([r[0] for r in rows])
        keys = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), bits // 8)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(rows)]])
        forest = Forest(len(rows))
        wide = keys.view(np.uint64)
        beside = np.flatnonzero((np.bitwise_count(wide[1:] ^ wide[:-1]).sum(1, dtype=np.int64) <= budget) & (group[1:] == group[:-1]))
        forest.add(beside, beside + 1)
        for u, v in trie_links(keys, begins, min(length for _, length in segments), budget, forest):
            forest.add(u, v)
        away = np.flatnonzero(forest.root != np.arange(len(rows)))
        if not len(away):
            return None
        back = np.array([bits - segments[r[1]][0] for r in rows])

        def prints_of(at: np.ndarray) -> pa.Array:
            out = np.empty((len(at), bits // 8), np.uint8)
            for turn in np.unique(back[at]):
                out[back[at] == turn] = _turned(keys[at[back[at] == turn]], int(turn))
            return pa.array(list(map(bytes, out)), pa.binary())

        return pa.RecordBatch.from_arrays([prints_of(away), prints_of(forest.root[away])], ["a", "b"])

    def tasks(batches):
        held, group, last = [], -1, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, "turned"))):
                if row[:4] != last:
                    group, last = group + 1, row[:4]
                    if len(held) >= BLOCK_ROWS:
                        out = found(held)
                        held = []
                        if out is not None:
                            yield out
                held.append((group, row[0], row[4]))
        if held:
            out = found(held)
            if out is not None:
                yield out

    return keyed.mapInArrow(tasks, "a binary, b binary")


def near_groups(prints: DataFrame, bits: int, budget: int, segments: list[tuple[int, int]]) -> DataFrame:
    """(fp, root) of every distinct fingerprint in column fp: root is the same for all that links connect."""
    distinct = cut_lineage(prints.select("fp").distinct())
    roots = components(near_links(distinct, bits, budget, segments))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


#: Three parts of 64 bits: two differing bits leave one of them whole.
THIRDS = [(0, 22), (22, 21), (43, 21)]


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of all that links connect).

    3-word shingles, 64 bits, links at 2 or fewer differing bits. Empty and null texts have fingerprint zero
    and are linked like others; null ids take part, but are nobody's smallest id. Repeated rows stay.
    """
    prints = cut_lineage(with_fingerprints(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"))
    groups = near_groups(prints, 64, 2, THIRDS)
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    smallest = groups.join(smallest, "fp")
    ids = cut_lineage(smallest.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(smallest.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Wide fingerprints, and tops for near_groups() over them.
WIDE_BITS, WIDE_TRIES = 512, [(16 * i, 16) for i in range(32)]
#: Least similarity of near copies: the share of their distinct shingles that both texts have.
SIMILAR = 0.8
#: Differing bits of a candidate. Fingerprints of distinct shingles differ in 78 of 512 bits at SIMILAR, with a
#: standard deviation of 8.
WIDE_BUDGET = 120
#: Tries, and the least hashes that name one. A pair at SIMILAR shares none with probability (1 - 0.8^6)^32 = 6e-5.
BANDS, BAND_ROWS = 32, 6
#: Bytes of shingle hashes of one block of a unit, and pairs that are verified before the forest is asked again.
BLOCK_BYTES, _CHECKED = 48 << 20, 2048
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(lower_words(data), size))


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys: two sets of similarity J share a given one with probability J^BAND_ROWS. None for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1024):
            np.minimum(least, (hashes[i:i + 1024, None] * _FACTORS[0] + _FACTORS[1]).min(0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _with_sets(docs: DataFrame, sid: str, fp: str, keys: str, size: str) -> DataFrame:
    """Adds a digest of every text's shingle set, the set's wide fingerprint, its band keys and its size."""
    columns = docs.columns

    def rows(batches):
        for batch in pieces(batches, "_data"):
            sets = [shingle_set(d or b"") for d in batch.column("_data").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.select(names).columns, pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([fingerprint(s, WIDE_BITS) for s in sets], pa.binary()), pa.array(list(map(band_keys, sets)), pa.list_(pa.int64())),
                pa.array(list(map(len, sets)), pa.int64()),
            ], [*names, "_sid", "_fp", "_keys", "_size"])

    names = [f"_c{i}" for i in range(len(columns))]
    given = docs.select(*(quoted(c).alias(n) for c, n in zip(columns, names)), utf8("text").alias("_data"))
    schema = given.drop("_data").schema.add("_sid", "binary").add("_fp", "binary").add("_keys", ArrayType(LongType())).add("_size", LongType())
    found = given.mapInArrow(rows, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip([*columns, sid, fp, keys, size], [*names, "_sid", "_fp", "_keys", "_size"])))


def _units(sets: DataFrame) -> DataFrame:
    """(sid, units): for each set the units in which it meets others, with the number of their blocks.

    Sets with one band key in common meet. All keys whose least member is the same are one unit, so that two copies
    meet once and a large group a few times, not once for each key.
    """
    slim = cut_lineage(sets.select("sid", "size", F.explode("keys").alias("key")))
    least = slim.groupBy("key").agg(F.min("sid").alias("unit"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(slim.join(least, "key").select("unit", "sid", "size").distinct())
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    sizes = members.groupBy("unit").agg(blocks.alias("blocks"))
    # At most one unit for each band.
    return members.join(sizes, "unit").groupBy("sid").agg(F.collect_list(F.struct("unit", "blocks")).alias("units"))


class _Overlaps:
    """Similarities of the sets of one block, counted over numbers of their distinct hashes."""

    def __init__(self, sets: list[bytes]):
        hashes = np.frombuffer(b"".join(sets), np.uint64)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
        self.starts = np.cumsum(self.sizes) - self.sizes
        distinct, self.numbers = np.unique(hashes, return_inverse=True)
        self.marked = np.zeros(len(distinct), bool)

    def similar(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which pairs share SIMILAR or more of their distinct hashes, exactly."""
        out = np.zeros(len(u), bool)
        x, y = self.sizes[u], self.sizes[v]
        # In whole numbers: 5 * both >= 4 * either; both is at most the smaller size.
        todo = np.flatnonzero(5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
        todo = todo[np.argsort(u[todo], kind="stable")]
        for part in np.split(todo, np.flatnonzero(np.diff(u[todo])) + 1):
            if not len(part):
                continue
            one, others = u[part[0]], v[part]
            own = self.numbers[self.starts[one]:self.starts[one] + self.sizes[one]]
            self.marked[own] = True
            lengths = self.sizes[others]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(self.starts[others] - ends + lengths, lengths)
            both = np.add.reduceat(self.marked[self.numbers[at]], ends - lengths, dtype=np.int64)
            self.marked[own] = False
            out[part] = 5 * both >= 4 * (self.sizes[one] + lengths - both)
        return out


def _similar_links(work: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links of each unit and pair of blocks (columns unit, i, j; sid, fp, hashes).

    A candidate of the trie is verified on the shingles in the same task before it links; rows that are connected
    already are not compared. So what a task holds is two blocks, and what it gives is at most one row for each set.
    """
    key = ["unit", "i", "j"]
    rows = work.repartition(*key).sortWithinPartitions(*key, "fp", "sid")

    def found(held: list[tuple]) -> pa.RecordBatch | None:
        group = np.array([r[0] for r in held])
        keys = np.frombuffer(b"".join(r[1] + r[2] for r in held), np.uint8).reshape(len(held), WIDE_BITS // 8 + 16)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(held)]])
        forest, overlaps = Forest(len(held)), _Overlaps([r[3] for r in held])

        def link(u: np.ndarray, v: np.ndarray) -> None:
            for k in range(0, len(u), _CHECKED):
                a, b = u[k:k + _CHECKED], v[k:k + _CHECKED]
                apart = forest.root[a] != forest.root[b]
                a, b = a[apart], b[apart]
                good = overlaps.similar(a, b)
                forest.add(a[good], b[good])

        # Most of a group of copies is connected by its first row and by neighbours in order.
        heads, rest = np.repeat(begins[:-1], np.diff(begins)), np.arange(len(held))
        link(heads[rest != heads], rest[rest != heads])
        beside = np.flatnonzero(group[1:] == group[:-1])
        link(beside, beside + 1)
        for u, v in trie_links(keys, begins, 0, WIDE_BUDGET, forest, WIDE_BITS):
            link(u, v)
        away = np.flatnonzero(forest.root != np.arange(len(held)))
        if not len(away):
            return None
        sids = np.array([r[2] for r in held], object)
        return pa.RecordBatch.from_arrays([pa.array(sids[away], pa.binary()), pa.array(sids[forest.root[away]], pa.binary())], ["a", "b"])

    def tasks(batches):
        held, size, group, last = [], 0, -1, None
        for batch in batches:
            for unit, i, j, sid, fp, hashes in zip(*(batch.column(c).to_pylist() for c in (*key, "sid", "fp", "hashes"))):
                if (unit, i, j) != last:
                    group, last = group + 1, (unit, i, j)
                    if len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                        out = found(held)
                        held, size = [], 0
                        if out is not None:
                            yield out
                held.append((group, fp, sid, hashes))
                size += len(hashes)
        if held:
            out = found(held)
            if out is not None:
                yield out

    return rows.mapInArrow(tasks, "a binary, b binary")


def similar_groups(sets: DataFrame) -> DataFrame:
    """(sid, root) of every set that has links: root is the same for all that links of SIMILAR or more connect.

    ``sets``: distinct (sid, fp, keys, size) with one text (data) each. The shingles of a set that meets others are
    hashed once and go to each of its units; a unit over BLOCK_ROWS sets or BLOCK_BYTES of hashes is cut into blocks
    that meet in pairs.
    """
    def hashed(batches):
        for batch in pieces(batches, "data", 4 << 20):
            hashes = pa.array([shingle_set(d or b"").tobytes() for d in batch.column("data").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.select(["sid", "fp", "units"]).columns, hashes], ["sid", "fp", "units", "hashes"])

    met = sets.join(_units(sets), "sid").select("sid", "fp", "units", "data")
    met = met.mapInArrow(hashed, "sid binary, fp binary, units array<struct<unit:binary,blocks:int>>, hashes binary")
    met = met.withColumn("u", F.explode("units")).select("sid", "fp", "hashes", "u.unit", "u.blocks")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: other != own))
    met = met.withColumn("own", own).withColumn("other", F.explode(others))
    links = _similar_links(met.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "fp", "hashes"))
    return components(links).select(F.col("node").alias("sid"), "root")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest doc_id, null ids last.

    Texts link when they share SIMILAR or more of their distinct 5-word shingles. Texts with fewer words count as
    one shingle, texts without words are one group. Of rows that repeat the smallest id one stays.
    """
    sid = fresh_name(docs.columns)
    fp = fresh_name(docs.columns, [sid])
    keys = fresh_name(docs.columns, [sid, fp])
    size = fresh_name(docs.columns, [sid, fp, keys])
    row = fresh_name(docs.columns, [sid, fp, keys, size])
    prints = cut_lineage(_with_sets(docs, sid, fp, keys, size).withColumn(row, F.monotonically_increasing_id()))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row).alias("row"))
    first = cut_lineage(prints.groupBy(F.col(sid).alias("sid")).agg(F.min(rank).alias("rank")))
    heads = prints.join(first.select(F.col("rank.row").alias(row)), row, "left_semi")
    sets = heads.select(F.col(sid).alias("sid"), F.col(fp).alias("fp"), F.col(keys).alias("keys"), F.col(size).alias("size"), utf8("text").alias("data"))
    groups = similar_groups(sets)
    rooted = first.join(groups, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    kept = rooted.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    return prints.join(cut_lineage(kept), row, "left_semi").select(*(quoted(c) for c in docs.columns))
