"""BPE with word ends: a segment tree over the ranks of neighbouring pairs names the next merge of a word."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import pieces, quoted, utf8

#: Chunks between white space whose ids a task remembers, and characters of them; beyond either, it starts anew.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16 << 20
#: Pairs up to which the trees of many words are kept side by side as a matrix; its cells at most.
SIDE_BY_SIDE, CELLS = 4096, 1 << 21
_NONE = np.iinfo(np.int64).max

# Code points newer than the tables of the vocabulary's library, which takes them for neither letters
# nor numbers, and the lower case that it knows of capitals newer than this Python's tables.
_NOT_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1"
    r"\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191"
    r"\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81"
    r"\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E"
    r"\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_NOT_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
    ord("Σ"): ord("σ"),
}
_NEWER = regex.compile("[\u03a3\u1c89\ua7cb-\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")
# The words of a chunk.
_LETTER, _NUMBER = rf"[\p{{L}}--[{_NOT_LETTERS}]]", rf"[\p{{N}}--[{_NOT_NUMBERS}]]"
_FORM = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{0}+|{1}|[^\s{0}{1}]+"
_WORDS, _PLAIN_WORDS = (regex.compile(_FORM.format(*c)) for c in ((_LETTER, _NUMBER), (r"\p{L}", r"\p{N}")))
_PLAIN_BELOW = "՘"  #: the first of _NOT_LETTERS


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Ids of bytes inside and at the end of a word, merges sorted by pair, special strings, pieces by id."""

    inside: np.ndarray
    final: np.ndarray
    pairs: np.ndarray  #: left id << 32 | right id, rising
    ranks: np.ndarray
    joined: np.ndarray  #: the id that the merge of each rank makes
    special: dict[str, int]
    pieces: tuple[str, ...]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NONE where they do not merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], _NONE)


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file of this kind: lower case, white space dropped, bytes as symbols, word ends, no decoder."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, end = given["model"], given["model"]["end_of_word_suffix"]
    steps = [n["type"] for n in given["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not end or steps != ["NFC", "Replace", "Lowercase"] or given["decoder"] is not None:
        raise ValueError(f"{path} is not a lower-case BPE with word ends and without decoder")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in given["added_tokens"]):
        raise ValueError(f"{path} has special strings that are not matched as they stand")
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(pairs, kind="stable")
    special = {t["content"]: t["id"] for t in given["added_tokens"]}
    by_id = {i: p for p, i in (ids | special).items()}
    symbols = byte_symbols()
    return Vocabulary(
        np.array([ids[s] for s in symbols], np.int32), np.array([ids[s + end] for s in symbols], np.int32),
        pairs[order], order.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int32),
        special, tuple(by_id.get(i, "") for i in range(max(by_id) + 1)),
    )


def merge_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word by one segment tree.

    Leaf i holds the rank of the pair that begins at symbol i (none: infinite), with its place; a node holds the
    least of its two children, so that the root is the leftmost pair of lowest rank. A merge changes three leaves:
    the pair itself, the one it swallows and the one before.
    """
    n = len(word)
    if not n:
        return []
    symbols = vocabulary.inside[np.frombuffer(word, np.uint8)].tolist()
    symbols[-1] = int(vocabulary.final[word[-1]])
    if n == 1:
        return symbols
    known = dict(zip(vocabulary.pairs.tolist(), vocabulary.ranks.tolist())) if n > SIDE_BY_SIDE else None

    def rank(a: int, b: int) -> int:
        if known is not None:
            return known.get(a << 32 | b, _NONE)
        return int(vocabulary.rank(np.array([a]), np.array([b]))[0])

    width = 1 << (n - 2).bit_length()
    none = (_NONE, 0)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = (rank(symbols[i], symbols[i + 1]), i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def update(i: int, value: tuple[int, int]) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                return
            tree[k] = least

    while tree[1][0] != _NONE:
        found, i = tree[1]
        j = after[i]
        symbols[i] = int(vocabulary.joined[found])
        after[i] = k = after[j]
        before[k] = i
        if j < width:
            update(j, none)
        update(i, (rank(symbols[i], symbols[k]), i) if k < n else none)
        if before[i] >= 0:
            update(before[i], (rank(symbols[before[i]], symbols[i]), before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def _side_by_side(words: list[bytes], width: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids (in one row after the other) and their number for words of 2 to ``width`` + 1 bytes, one tree a row."""
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    rows, ends = np.arange(m), np.cumsum(lengths)
    symbols = np.full((m, width + 2), -1, np.int32)
    places = np.arange(lengths.sum()) - np.repeat(ends - lengths, lengths)
    symbols[np.repeat(rows, lengths), places] = vocabulary.inside[np.frombuffer(b"".join(words), np.uint8)]
    symbols[rows, lengths - 1] = vocabulary.final[[w[-1] for w in words]]
    after = np.broadcast_to(np.arange(1, width + 3, dtype=np.int32), symbols.shape).copy()
    before = np.broadcast_to(np.arange(-1, width + 1, dtype=np.int32), symbols.shape).copy()
    # A leaf: rank << 16 | place, so that the least is the leftmost of the lowest.
    tree = np.full((m, 2 * width), _NONE)
    leaves = tree[:, width:]
    pair = symbols[:, 1:width + 1] >= 0
    ranks = vocabulary.rank(symbols[:, :width][pair], symbols[:, 1:width + 1][pair])
    leaves[pair] = np.where(ranks == _NONE, _NONE, ranks << 16 | np.nonzero(pair)[1])
    level = width
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    flat, sym, nxt, prv, step = tree.reshape(-1), symbols.reshape(-1), after.reshape(-1), before.reshape(-1), width + 2
    at = rows[tree[:, 1] != _NONE]
    while len(at):
        root, line = flat[at * (2 * width) + 1], at * step
        i, made = root & 0xFFFF, vocabulary.joined[root >> 16]
        j = nxt[line + i].astype(np.int64)
        k, p = nxt[line + j].astype(np.int64), prv[line + i].astype(np.int64)
        sym[line + i], sym[line + j] = made, -1
        nxt[line + i], prv[line + k] = k, i
        follows, leads = sym[line + k], sym[line + np.maximum(p, 0)]
        right = np.where(follows >= 0, vocabulary.rank(made, np.maximum(follows, 0)), _NONE)
        left = np.where(p >= 0, vocabulary.rank(leads, made), _NONE)
        base = at * (2 * width)
        # The last symbol begins no pair; its leaf, where it exists, is infinite already.
        nodes = np.concatenate([base[j < width] + width + j[j < width], base + width + i, base[p >= 0] + width + p[p >= 0]])
        offset = np.concatenate([base[j < width], base, base[p >= 0]])
        values = [np.where(r == _NONE, _NONE, r << 16 | x) for r, x in ((right, i), (left, np.maximum(p, 0)))]
        flat[nodes] = np.concatenate([np.full(int((j < width).sum()), _NONE), values[0], values[1][p >= 0]])
        nodes -= offset
        for _ in range(width.bit_length() - 1):
            nodes >>= 1
            flat[offset + nodes] = np.minimum(flat[offset + 2 * nodes], flat[offset + 2 * nodes + 1])
        at = at[flat[base + 1] != _NONE]
    kept = symbols >= 0
    return symbols[kept], kept.sum(1)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word: of all neighbouring pairs the leftmost of the lowest rank merges, until none has a rank."""
    out: list[list[int]] = [[] for _ in words]
    groups: dict[int, list[int]] = {}
    for w, word in enumerate(words):
        n = len(word)
        if n < 2 or n - 1 > SIDE_BY_SIDE:
            out[w] = merge_word(word, vocabulary)
        else:
            groups.setdefault(1 << (n - 2).bit_length(), []).append(w)
    for width, members in groups.items():
        most = max(CELLS // width, 1)
        for s in range(0, len(members), most):
            part = members[s:s + most]
            ids, counts = _side_by_side([words[w] for w in part], width, vocabulary)
            flat, end = ids.tolist(), 0
            for w, count in zip(part, counts.tolist()):
                out[w] = flat[end:end + count]
                end += count
    return out


def chunks_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """Normalised text between white space; a special string is a chunk of its own, with a blank before it.

    Special strings are found in the text as it stands; what lies between them is composed (NFC) and lowered one
    character at a time.
    """
    if any(s in text for s in vocabulary.special):
        out = []
        by_length = sorted(vocabulary.special, key=len, reverse=True)
        for part in regex.split("(" + "|".join(map(regex.escape, by_length)) + ")", text):
            out += [" " + part] if part in vocabulary.special else _plain_chunks(part)
        return out
    return _plain_chunks(text)


def _plain_chunks(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _NEWER.search(text):
            text = text.translate(_LOWER)
    text = text.lower()
    # str.split() also takes these four separators for white space.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in regex.split(r"\s+", text) if c]
    return text.split()


def words_of(chunk: str) -> list[str]:
    return (_PLAIN_WORDS if chunk.isascii() or max(chunk) < _PLAIN_BELOW else _WORDS).findall(chunk)


class _Numbers(dict):
    """Numbers chunks in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class _Memory:
    """Ids of the chunks seen so far: where each begins in one array, and how many it has."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Merges the words of the chunks that were numbered since the last call."""
        fresh = list(islice(self.numbers, len(self.starts), None))
        if not fresh:
            return
        words = _Numbers()
        special = self.vocabulary.special
        split = [None if c[0] == " " else [words[w] for w in words_of(c)] for c in fresh]
        merged = merge_words([w.encode() for w in words], self.vocabulary)
        lists = [[special[c[1:]]] if s is None else [i for w in s for i in merged[w]] for c, s in zip(fresh, split)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))])
        self.chars += sum(map(len, fresh))

    def encode(self, texts: list[str]) -> pa.ListArray:
        chunks = [chunks_of(t, self.vocabulary) for t in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
        self.learn()
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and ``ids`` (array of int) for the whole ``text`` of every row.

    Special strings of the file are found in texts and keep their ids; none is added. Null and empty texts have no
    ids; repeated rows stay. A task merges each distinct word once while it remembers it, and nothing is shuffled.
    ``vocabulary`` is the path of a tokenizer file that every executor has. Characters that Unicode added after
    the tables of this Python and that compose with others stay as they are.
    """
    names = [f"_c{i}" for i in range(len(carry))]

    def rows(batches):
        memory = _Memory(read_vocabulary(vocabulary))
        for batch in pieces(batches, "_data", 4 << 20):
            ids = memory.encode([d.decode("utf-8", "replace") for d in batch.column("_data").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, ids], [*names, "ids"])

    given = docs.select(*(quoted(c).alias(n) for c, n in zip(carry, names)), utf8("text").alias("_data"))
    schema = given.drop("_data").schema.add("ids", docs.sparkSession.range(0).select(F.array(F.lit(0))).schema[0].dataType)
    return given.mapInArrow(rows, schema).select(*(F.col(n).alias(c) for c, n in zip(carry, names)), "ids")


def decode(ids: Column, vocabulary: str) -> Column:
    """Pieces of a list of ids, word ends and symbols of bytes as they stand in the file, joined by blanks.

    Unknown ids are left out. Null for null.
    """
    # No piece holds a line feed or a tabulator: they have symbols of their own.
    table = F.split(F.lit("\n".join(read_vocabulary(vocabulary).pieces)), "\n")
    return F.array_join(F.filter(F.transform(ids, lambda i: F.get(table, i)), lambda p: p != ""), " ")
