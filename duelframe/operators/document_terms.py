"""In how many texts each word and character term occurs, counted in tasks over pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of one piece; a longer text is a piece of its own. Rows of one batch of results.
PIECE_BYTES, MOST_ROWS = 8 << 20, 200_000
#: Grams of pieces that a task keeps to add them up; with more than half as many different ones it gives them out.
KEPT_GRAMS = 1_500_000
_BYTES = np.arange(256)
#: Bytes of words for character terms: all but white space of ASCII; and of word terms: letters, digits, _ and what is not ASCII.
DARK = ~np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
WORD = np.isin(_BYTES, list(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) | (_BYTES >= 128)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column(0)).to_numpy().astype(np.int64)) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def words(texts: pa.Array, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of bytes that are ``inside``, of ``least`` or more characters: their numbers text after text, where each text ends, distinct runs."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    held = inside[data]
    first = held.copy()
    first[1:] &= ~held[:-1]
    opens = bounds[:-1][bounds[:-1] < len(data)]
    first[opens] = held[opens]
    starts = np.flatnonzero(first)
    # Without the bytes between them the runs lie side by side, as Arrow keeps strings.
    offsets = np.append(np.cumsum(held)[starts] - 1, np.count_nonzero(held))
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[held]))
    if least > 1:
        long = pc.greater_equal(pc.utf8_length(runs), least)
        runs, starts = runs.filter(long), starts[long.to_numpy(zero_copy_only=False)]
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy(), np.searchsorted(starts, bounds[1:]), coded.dictionary


def distinct(codes: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The different numbers (below ``size``) of each text: a number counts where it was noted last."""
    last, start = np.zeros(size, np.int64), 0
    for end in ends.tolist():
        own, start = codes[start:end], end
        places = np.arange(len(own))
        last[own] = places
        yield own[last[own] == places]


def texts_with(codes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    count = np.zeros(size, np.int64)
    for own in distinct(codes, ends, size):
        count[own] += 1
    return count


def grams(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Character 3-5-grams of space-padded words: their numbers word after word, where each word ends, distinct grams.

    Each length is numbered from that of one less and the next character, so a number is exact.
    """
    text = " " + "  ".join(runs.to_pylist()) + " "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(runs).to_numpy() + 2
    owner = np.repeat(np.arange(len(runs)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(points))
    number, owners, codes, terms = points.copy(), [], [], []
    for n in (2, 3, 4, 5):
        at = np.flatnonzero(left >= n)
        key = number[at] << 21 | points[at + n - 1]
        if n > 2:
            coded = pa.array(key).dictionary_encode()
            key = coded.indices.to_numpy().astype(np.int64)
            place = np.empty(len(coded.dictionary), np.int64)
            place[key] = at
            owners.append(owner[at])
            codes.append(key + len(terms))
            terms += [text[p:p + n] for p in place.tolist()]
        number[at] = key
    owners, codes = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(owners, kind="stable")
    return codes[order], np.cumsum(np.bincount(owners, minlength=len(runs))), terms


def texts_with_grams(codes: np.ndarray, ends: np.ndarray, runs: pa.Array) -> tuple[list[str], np.ndarray]:
    if not len(runs):
        return [], np.zeros(0, np.int64)
    numbers, stops, terms = grams(runs)
    begins = np.append(0, stops[:-1])
    sizes = stops - begins
    count, last = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for own in distinct(codes, ends, len(runs)):
        many = sizes[own]
        places = np.arange(many.sum())
        held = numbers[places + np.repeat(begins[own] - (np.cumsum(many) - many), many)]
        last[held] = places
        count[held[last[held] == places]] += 1
    return terms, count


def texts_with_two(codes: np.ndarray, ends: np.ndarray, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Neighbouring words of a text."""
    key = codes[:-1].astype(np.int64) << 32 | codes[1:]
    apart = np.ones(len(key), bool)
    borders = ends[(ends > 0) & (ends < len(codes))] - 1
    apart[borders] = False
    coded = pa.array(key[apart]).dictionary_encode()
    both = coded.dictionary.to_numpy()
    # In the order of the first word: rows that are alike and lie together are written in fewer bytes.
    order = np.argsort(both)
    count = texts_with(coded.indices.to_numpy(), np.append(0, np.cumsum(apart))[np.maximum(ends - 1, 0)], len(both))
    both = both[order]
    terms = pc.binary_join_element_wise(runs.take(pa.array(both >> 32)), runs.take(pa.array(both & 0xFFFFFFFF)), pa.scalar(" ", pa.large_string()))
    return terms, count[order]


def _rows(kind: str, terms: list[str] | pa.Array, count: np.ndarray | pa.Array) -> Iterator[pa.RecordBatch]:
    columns = [pa.repeat(kind, len(count)), pa.array(terms, pa.large_string()).cast(pa.string()), pa.array(count)]
    table = pa.RecordBatch.from_arrays(columns, ["kind", "term", "df"])
    yield from (table.slice(i, MOST_ROWS) for i in range(0, len(count), MOST_ROWS))


def _added(kept: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(kept).group_by("term", use_threads=False).aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"])


def document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, df), from lowered texts with a space for white space, and also for what is no word, beyond ASCII.

    Words and pairs of words are rows of their piece; grams, which come again in most pieces, are added up first.
    """
    kept: list[pa.Table] = []

    def given_out(least: int) -> Iterator[pa.RecordBatch]:
        if sum(t.num_rows for t in kept) > least:
            kept[:] = [_added(kept)]
            if kept[0].num_rows > least // 2:
                grams_ = kept.pop().combine_chunks()
                yield from _rows("char", grams_["term"].combine_chunks(), grams_["df"].combine_chunks())

    for piece in pieces(batches):
        codes, ends, runs = words(piece.column(1), WORD, 2)
        yield from _rows("word", runs, texts_with(codes, ends, len(runs)))
        if len(codes):
            yield from _rows("word", *texts_with_two(codes, ends, runs))
        terms, count = texts_with_grams(*words(piece.column(0), DARK, 1))
        kept.append(pa.table({"term": pa.array(terms, pa.large_string()), "df": count}))
        yield from given_out(KEPT_GRAMS)
    yield from given_out(0)
