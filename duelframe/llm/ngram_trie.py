"""Language-model scores from an n-gram trie in Elias-Fano form, cut into shards by context."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from duelframe.llm.common import cut_lineage, lower_words, pieces, utf8
from duelframe.llm.elias_fano import EliasFano, encode

#: The end of a text, and the context of its first word; words hold no space.
END = b" "
#: Bytes of text whose tokens are numbered together.
BATCH_BYTES = 16 << 20
#: Training tokens for each shard of the trie and for each bucket of the vocabulary.
SHARD_TOKENS = 3 << 19
#: Classes of words into which the followers of a context with more than SHARD_TOKENS are divided at most.
CLASSES = 4096
_FLOOR = 0.1


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _expand(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@dataclass
class Vocabulary:
    """Totals of the training tokens: N, V and, by class of words, counts and numbers of words (CLASSES numbers each)."""

    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of (c + 0.1) / (N + 0.1 (V + 1))."""
        return np.log10((count + _FLOOR) / (self.tokens + _FLOOR * (self.words + 1)))

    def parts(self, count: np.ndarray) -> np.ndarray:
        """Into how many parts the followers of contexts of this count are divided."""
        return np.clip(-(-count // SHARD_TOKENS), 1, CLASSES)

    def mass(self, parts: int, part: int) -> float:
        """Base probability of all words of one part; unknown words are in the last one."""
        mine = (np.arange(CLASSES) * parts // CLASSES) == part
        extra = _FLOOR if part == parts - 1 else 0.0
        return float((self.class_tokens[mine].sum() + _FLOOR * self.class_words[mine].sum() + extra) / (self.tokens + _FLOOR * (self.words + 1)))


def _kind(ids: np.ndarray) -> np.ndarray:
    """Class of a word, from its id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)


@dataclass
class NumberedCorpus:
    """Texts as word numbers, ids and counts of the words, and totals. All tables are stored."""

    vocabulary: Vocabulary
    shards: int
    corpus: DataFrame
    numbers: DataFrame


_CORPUS = "batch bigint, train array<boolean>, lengths array<bigint>, tokens binary, bucket int, words binary, counts binary"


def number_tokens(docs: DataFrame, train: Column, buckets: int) -> DataFrame:
    """Stored batches of documents as local word numbers, and the words of each batch by bucket.

    One row per batch with doc_id, train, lengths (with the end) and tokens, and one row per batch and bucket
    with the batch's distinct words in order and how often each occurs in training texts. The last token of
    every text is END. Rows of a batch hold about BATCH_BYTES of text, or one text.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", T.ArrayType(kind)), *T.StructType.fromDDL(_CORPUS)])

    def rows(batches):
        part, n = TaskContext.get().partitionId(), 0
        arrow = None
        for piece in pieces(batches, "data", BATCH_BYTES):
            local: dict[bytes, int] = {}
            tokens, lengths = [], []
            for data in piece.column("data").to_pylist():
                words = lower_words(data)
                words.append(END)
                tokens.append(np.fromiter((local.setdefault(w, len(local)) for w in words), np.int32, len(words)))
                lengths.append(len(words))
            flat = np.concatenate(tokens)
            learned = np.repeat(piece.column("train").to_numpy(zero_copy_only=False), lengths)
            counts = np.bincount(flat[learned], minlength=len(local)).astype(np.int32)
            # The commonest words get the smallest local numbers, bucket by bucket.
            names = list(local)
            where = (_hash(names) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((np.arange(len(names)), where))
            place = np.empty(len(names), np.int32)
            place[order] = np.arange(len(names))
            batch = part << 32 | n
            n += 1
            arrow = piece.schema.field("doc_id").type
            one = {
                "doc_id": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), piece.column("doc_id")), "batch": pa.array([batch]),
                "train": pa.array([piece.column("train").to_pylist()], pa.list_(pa.bool_())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "tokens": pa.array([_squeeze(place[flat])], pa.binary()), "bucket": pa.array([-1], pa.int32()),
                "words": pa.array([None], pa.binary()), "counts": pa.array([None], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(one.values()), list(one))
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            found = [(b, order[edges[b]:edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]
            size = len(found)
            many = {
                "doc_id": pa.nulls(size, pa.list_(arrow)), "batch": pa.array([batch] * size), "train": pa.nulls(size, pa.list_(pa.bool_())),
                "lengths": pa.nulls(size, pa.list_(pa.int64())), "tokens": pa.nulls(size, pa.binary()), "bucket": pa.array([b for b, _ in found], pa.int32()),
                "words": pa.array([zlib.compress(b"\n".join(names[i] for i in own), 1) for _, own in found], pa.binary()),
                "counts": pa.array([_squeeze(counts[own]) for _, own in found], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(many.values()), list(many))

    given = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), utf8("text").alias("data"))
    return cut_lineage(given.mapInArrow(rows, schema))


def number_words(corpus: DataFrame, buckets: int) -> DataFrame:
    """For each batch and bucket the ids and training counts of its words; one row per bucket has its totals.

    A bucket's words are summed over all batches by one task; ids interleave the buckets, commoner words first.
    Words without training tokens have the id -1.
    """
    def merge(held: list[tuple[int, list[bytes], np.ndarray]], bucket: int) -> Iterator[tuple]:
        total: dict[bytes, int] = {}
        for _, words, counts in held:
            for w, c in zip(words, counts.tolist()):
                if c:
                    total[w] = total.get(w, 0) + c
        ids = {w: i * buckets + bucket for i, w in enumerate(sorted(total, key=lambda w: (-total[w], w)))}
        kinds = _kind(np.fromiter(ids.values(), np.int64, len(ids)))
        values = np.fromiter((total[w] for w in ids), np.int64, len(ids))
        yield (-1, bucket, _squeeze(np.bincount(kinds, values, CLASSES).astype(np.int64)), _squeeze(np.bincount(kinds, minlength=CLASSES).astype(np.int64)))
        for batch, words, _ in held:
            yield (
                batch, bucket, _squeeze(np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))),
                _squeeze(np.fromiter((total.get(w, 0) for w in words), np.int64, len(words))),
            )

    def rows(batches):
        names, types = ["batch", "bucket", "ids", "counts"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

        def out(held, bucket):
            for row in merge(held, bucket):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        held, last = [], None
        for batch in batches:
            for bucket, number, words, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "words", "counts"))):
                if bucket != last and held:
                    yield from out(held, last)
                    held = []
                last = bucket
                held.append((number, zlib.decompress(words).split(b"\n"), _expand(counts, np.int32)))
        if held:
            yield from out(held, last)

    words = corpus.filter("bucket >= 0").select("bucket", "batch", "words", "counts").repartition("bucket").sortWithinPartitions("bucket", "batch")
    return cut_lineage(words.mapInArrow(rows, "batch bigint, bucket int, ids binary, counts binary"))


def _per_key(batches, key: str, columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each key together; the input is sorted by key."""
    held, last = [], None
    for batch in batches:
        for value, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
            if value != last and held:
                yield last, held
                held = []
            last = value
            held.append(row)
    if held:
        yield last, held


_PARTS = ["a", "b", "c", "d", "e"]
_PAIRS = "shard int, batch bigint, kind int, " + ", ".join(f"{x} binary" for x in _PARTS)
_PAIR_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
_BASE, _ASK = 0, 1


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_PAIR_TYPES)], ["shard", "batch", "kind", *_PARTS])


def _pairs(numbered: NumberedCorpus) -> DataFrame:
    """Word pairs of each batch by shard, with the documents in which they stand and how often.

    A shard takes a context and one part of its followers. Each batch also gives one row of kind _BASE: known
    tokens and base score of each document.
    """
    vocabulary, shards = numbered.vocabulary, numbered.shards

    def rows(batches):
        for batch, held in _per_key(batches, "batch", ["bucket", "train", "lengths", "tokens", "ids", "counts"]):
            texts = [r for r in held if r[3] is not None]
            maps = sorted((r for r in held if r[3] is None), key=lambda r: r[0])
            _, train, lengths, packed, *_ = texts[0]
            ids, counts = (np.concatenate([_expand(m[k], np.int64) for m in maps]) for k in (4, 5))
            tokens, lengths = _expand(packed, np.int32), np.array(lengths, np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            before = np.empty_like(tokens)
            before[1:] = tokens[:-1]
            before[starts] = tokens[-1]  # every text ends with END
            known = np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)
            base = np.add.reduceat(vocabulary.base(counts)[tokens], starts)
            yield _emit([(int(batch) % shards, batch, _BASE, known.tobytes(), base.tobytes(), None, None, None)])
            # A document's number and whether it is learned from.
            doc = np.repeat((np.arange(len(lengths)) * 2 + np.array(train, np.int64)).astype(np.int32), lengths)
            used = ids[before] >= 0
            w, v, doc = before[used], tokens[used], doc[used]
            del before, tokens, used, known, base
            if not len(w):
                continue
            parts = vocabulary.parts(counts[w])
            part = np.where(ids[v] < 0, parts - 1, _kind(ids[v]) * parts // CLASSES)
            context, follower = ids[w] * CLASSES + part, ids[v]
            del parts, part
            order = np.lexsort((doc, follower, context))
            context, follower, doc = context[order], follower[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1]) | (doc[1:] != doc[:-1])]))
            times = np.diff(np.append(at, len(order)))
            context, follower, doc, own, count = context[at], follower[at], doc[at], counts[w[order[at]]], counts[v[order[at]]]
            del order, w, v, at
            shard = ((context * 0x9E3779B1 ^ context >> 7) & 0x7FFFFFFF) % shards
            by = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[by], np.arange(shards + 1))
            del shard
            out = []
            for s in np.flatnonzero(np.diff(edges)):
                x = by[edges[s]:edges[s + 1]]
                first = np.concatenate([[True], context[x][1:] != context[x][:-1]])
                runs = np.diff(np.append(np.flatnonzero(first), len(x)))
                head = np.stack([context[x][first], runs, own[x][first]])
                out.append((int(s), batch, _ASK, zlib.compress(head.tobytes(), 1), _squeeze(follower[x]), _squeeze(doc[x].astype(np.int32)), _squeeze(times[x].astype(np.int32)), _squeeze(count[x])))
            yield _emit(out)

    empty = [F.lit(None).cast("binary").alias(c) for c in ("ids", "counts")]
    texts = numbered.corpus.filter("bucket < 0").select("batch", "bucket", "train", "lengths", "tokens", *empty)
    maps = numbered.numbers.filter("batch >= 0").select(
        "batch", "bucket", F.lit(None).cast("array<boolean>").alias("train"), F.lit(None).cast("array<bigint>").alias("lengths"),
        F.lit(None).cast("binary").alias("tokens"), "ids", "counts")
    both = texts.unionByName(maps).repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(rows, _PAIRS)
    return both.repartition("shard").sortWithinPartitions("shard", "batch", "kind")


def _unpack(row: tuple) -> tuple[np.ndarray, ...]:
    """context, follower, document, whether it is learned from, times, count of the follower, count of the context."""
    a, b, c, d, e = row
    head = np.frombuffer(zlib.decompress(a), np.int64).reshape(3, -1)
    doc = _expand(c, np.int32)
    return (
        np.repeat(head[0], head[1]), _expand(b, np.int64), doc >> 1, (doc & 1).astype(bool), _expand(d, np.int32), _expand(e, np.int64),
        np.repeat(head[2], head[1]),
    )


#: Codes of log10 values: 65,536 even steps.
_LEAST, _MOST = -8.0, 9.0


def _codes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((values - _LEAST) / (_MOST - _LEAST) * 65535), 0, 65535).astype(np.uint16)


_DECODED = _LEAST + np.arange(65536) / 65535 * (_MOST - _LEAST)


def build_trie(context: np.ndarray, follower: np.ndarray, times: np.ndarray, count: np.ndarray, own: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """Levels of one shard: contexts, pointers, followers, and codes of probabilities.

    Absolute discounting with the shard's own discount n1 / (n1 + 2 n2): a follower seen c times after a context
    of count h has (c - D) / h + L p1 and another word L p1. L gives the words of the context's part, taken
    together, the share that the part has in training. Codes hold log10 of the ratio to p1, so that unseen
    followers share one code. Followers of each context lie above the last one of the context before (one
    sequence that never falls).
    """
    order = np.lexsort((follower, context))
    context, follower, times, count, own = (x[order] for x in (context, follower, times, count, own))
    del order
    fresh = np.concatenate([[True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])]) if len(context) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    times = np.add.reduceat(times, at) if len(at) else times
    context, follower, count, own = (x[at] for x in (context, follower, count, own))
    n1, n2 = int((times == 1).sum()), int((times == 2).sum())
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(context)))
    parts = vocabulary.parts(own[first])
    sizes = {(int(k), int(c)): vocabulary.mass(int(k), int(c)) for k, c in zip(parts[parts > 1], context[first][parts > 1] % CLASSES)}
    mass = np.array([sizes.get((int(k), int(c)), 1.0) for k, c in zip(parts, context[first] % CLASSES)]) if sizes else np.ones(len(first))
    rest = discount * runs / own[first] / mass
    p1 = 10.0 ** vocabulary.base(count)
    ratio = (times - discount) / np.repeat(own[first], runs) / p1 + np.repeat(rest, runs)
    last = follower[np.append(first[1:], len(follower)) - 1] if len(first) else follower
    lift = np.concatenate([[0], np.cumsum(last + 1)])
    raised = follower + np.repeat(lift[:-1], runs)
    levels = [*encode(context[first]), *encode(np.append(first, len(context))), *encode(raised), *encode(lift), _codes(np.log10(rest)), _codes(np.log10(ratio))]
    size = np.array([len(levels), *(x.nbytes for x in levels)], np.int64)
    return size.tobytes() + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in levels)


class Trie:
    """A shard in a mapped file."""

    def __init__(self, path_or_file):
        raw = np.memmap(path_or_file, np.uint8, "r")
        sizes = raw[8:8 + 8 * int(raw[:8].view(np.int64)[0])].view(np.int64)
        at, parts = 8 + 8 * len(sizes), []
        kinds = [np.uint64, np.uint64, np.uint64, np.uint32] * 4 + [np.uint16, np.uint16]
        for n, kind in zip(sizes.tolist(), kinds):
            parts.append(raw[at:at + n].view(kind))
            at += n + -n % 8
        self.contexts, self.pointers, self.followers, self.lift = (EliasFano(*parts[4 * k:4 * k + 4]) for k in range(4))
        self.rest, self.seen = parts[16], parts[17]

    def gains(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """log10 of p(follower | context) / p1(follower); 0 for unknown contexts.

        A follower is searched relative to its context: what the levels add to the context's followers is added
        to it, and its successor must lie between the context's pointers.
        """
        out = np.zeros(len(context))
        if not self.contexts.n:
            return out
        each, back = np.unique(context, return_inverse=True)
        at = self.contexts.successor(each.astype(np.uint64))
        found = at < self.contexts.n
        found[found] = self.contexts.access(at[found]) == each[found].astype(np.uint64)
        at = np.where(found, at, 0)
        begin, end, lift = self.pointers.access(at), self.pointers.access(at + 1), self.lift.access(at)
        known = found[back]
        out[known] = _DECODED[self.rest[at[back][known]]]
        ask = np.flatnonzero(known & (follower >= 0))
        c = back[ask]
        want = follower[ask].astype(np.uint64) + lift[c]
        place = self.followers.successor(want)
        inside = (place >= begin[c].astype(np.int64)) & (place < end[c].astype(np.int64))
        ask, place, want = ask[inside], place[inside], want[inside]
        hit = self.followers.access(place) == want
        out[ask[hit]] = _DECODED[self.seen[place[hit]]]
        return out


def number_corpus(docs: DataFrame, train: Column) -> NumberedCorpus:
    """Numbers the words of all texts and counts them in the rows that ``train`` admits.

    The number of buckets and shards follows the size of the texts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size / 5 // SHARD_TOKENS) + 1
    corpus = number_tokens(docs, train, shards)
    numbers = number_words(corpus, shards)
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in numbers.filter("batch < 0").select("ids", "counts").toLocalIterator():
        tokens += _expand(bytes(row[0]), np.int64)
        words += _expand(bytes(row[1]), np.int64)
    return NumberedCorpus(Vocabulary(int(tokens.sum()), int(words.sum()), tokens, words), shards, corpus, numbers)


def _shard_trie(held: list[tuple], vocabulary: Vocabulary) -> bytes:
    """The trie of a shard from the training documents' part of its pairs."""
    learned = []
    for row in held:
        context, follower, _, train, times, count, own = _unpack(row)
        train &= follower >= 0
        context, follower, times, count, own = (x[train] for x in (context, follower, times, count, own))
        at = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])])) if len(context) else np.zeros(0, np.int64)
        if len(at):
            learned.append((context[at], follower[at], np.add.reduceat(times, at), count[at], own[at]))
    if not learned:
        empty = np.zeros(0, np.int64)
        return build_trie(empty, empty, empty, empty, empty, vocabulary)
    columns = [list(x) for x in zip(*learned)]
    del learned
    # One column after the other, so that the parts are freed as they are joined.
    return build_trie(*(np.concatenate(columns.pop(0)) for _ in range(5)), vocabulary)


def store_tries(numbered: NumberedCorpus) -> DataFrame:
    """The model as a stored table (shard, trie): the levels of every shard as bytes."""
    vocabulary = numbered.vocabulary

    def build(batches):
        for shard, held in _per_key(batches, "shard", ["kind", *_PARTS]):
            trie = _shard_trie([r[1:] for r in held if r[0] == _ASK], vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([trie], pa.binary())], ["shard", "trie"])

    return cut_lineage(_pairs(numbered).mapInArrow(build, "shard int, trie binary"))


def score_corpus(numbered: NumberedCorpus) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of every row of the numbered corpus.

    Pairs are shuffled once, to the shard of their context. There the shard's trie is built from the training
    documents, mapped from a file, and asked for all documents; what comes back is one sum per document, batch
    and shard. A shard holds the pairs of about SHARD_TOKENS tokens; a context beyond that is divided by
    classes of its followers.
    """
    vocabulary = numbered.vocabulary

    def answer(batches):
        for shard, held in _per_key(batches, "shard", ["kind", "batch", *_PARTS]):
            with tempfile.TemporaryFile() as mapped:
                mapped.write(_shard_trie([r[2:] for r in held if r[0] == _ASK], vocabulary))
                mapped.flush()
                trie = Trie(mapped)
                for kind, batch, *rest in held:
                    if kind == _BASE:
                        yield _emit([(shard, batch, _BASE, *rest)])
                        continue
                    context, follower, doc, _, times, *_ = _unpack(rest)
                    sums = np.bincount(doc, trie.gains(context, follower) * times)
                    at = np.flatnonzero(np.bincount(doc))
                    yield _emit([(shard, batch, _ASK, _squeeze(at.astype(np.int32)), sums[at].astype(np.float32).tobytes(), None, None, None)])

    met = _pairs(numbered).mapInArrow(answer, _PAIRS)
    texts = numbered.corpus.filter("bucket < 0").select("batch", "doc_id", "train", "lengths")
    kind = numbered.corpus.schema["doc_id"].dataType.elementType
    arrow = to_arrow_type(kind)

    def total(batches):
        for _, held in _per_key(batches, "batch", ["doc_id", "train", "lengths", "kind", "a", "b"]):
            ids, train, lengths = next(r[:3] for r in held if r[2] is not None)
            score = np.zeros(len(lengths))
            for r in sorted((r for r in held if r[2] is None), key=lambda r: (r[3], r[4])):
                if r[3] == _BASE:
                    known, base = np.frombuffer(r[4], np.int64), np.frombuffer(r[5], np.float64)
                else:
                    score[_expand(r[4], np.int32)] += np.frombuffer(r[5], np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow), pa.array(train, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(known), pa.array(base), pa.array(base + score)],
                ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    left = texts.select("batch", "doc_id", "train", "lengths", F.lit(-1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in "ab"))
    right = met.select("batch", F.lit(None).cast(T.ArrayType(kind)).alias("doc_id"), F.lit(None).cast("array<boolean>").alias("train"), F.lit(None).cast("array<bigint>").alias("lengths"), "kind", "a", "b")
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("train boolean, n_tokens bigint, n_known bigint, base_score double, score double")])
    return left.unionByName(right).repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(total, schema)
