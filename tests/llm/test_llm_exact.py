"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as P
from duelframe.llm import queries as Q
from duelframe.llm import simhash_trie as S
from duelframe.llm import warc as W
from duelframe.llm.byte_bpe import _fold_long, fold_merges, fold_words, read_ranks
from duelframe.llm.common import lower_words
from duelframe.llm.components import Forest, components
from duelframe.llm.elias_fano import EliasFano, encode
from duelframe.llm.embedding_tiles import link_embeddings
from duelframe.llm.line_dedup import SPREAD_WORDS, RUN_WORDS, dedup_lines
from duelframe.llm.quality_fm import FactorisationMachine, STATISTICS, BUCKETS
from duelframe.llm.spaced_seeds import find_overlaps
from duelframe.llm.toxicity_mil import noisy_or
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    result = compare(spark, duck(SF), name, Q.QUERIES[name], Q.SQL[name], SF)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_bpe_equals_library(spark, texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})
    for r in Q.op1_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_folds_agree(spark):
    ranks, rng = read_ranks(VOCABULARY), random.Random(3)
    words = ["".join(rng.choice("aehtionué 漢") for _ in range(rng.randint(1, 90))) for _ in range(150)]
    for w in words:
        if w.encode() not in ranks:
            assert _fold_long(w.encode(), ranks) == fold_merges(w.encode()[:], ranks)
    rows = fold_words(spark.createDataFrame([(w,) for w in words[:40]] + [(None,), ("",)], "word string"), VOCABULARY).collect()
    assert all(r.ids == (None if r.word is None else fold_merges(r.word.encode(), ranks) if r.word else []) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    seq = EliasFano(*encode(values))
    assert (seq.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), np.array([0, 1 << 41], np.uint64)])
    assert (seq.successor(asked) == np.searchsorted(values, asked)).all()


def test_language_model(spark, texts):
    """Counts and base scores are exact; the trie's score is that of the formula up to the steps of its codes."""
    words = {i: lower_words(t.encode()) + [b" "] for i, t in texts.items()}
    learned = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 10]
    c, pairs = Counter(), Counter()
    for w in learned:
        c.update(w)
        pairs.update(zip([b" "] + w[:-1], w))
    n, v, followers = sum(c.values()), len(c), Counter(a for a, _ in pairs)
    n1, n2 = (sum(x == k for x in pairs.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)

    def p1(w):
        return (c[w] + 0.1) / (n + 0.1 * (v + 1))

    rows = Q.op2_ngram_trie(spark, SF).collect()
    assert len(rows) == len(words)
    gain = 0.0
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w), rel=1e-9)
        want = sum(math.log10((max(pairs[a, x] - d, 0) + d * followers[a] * p1(x)) / c[a] if c[a] else p1(x)) for a, x in zip([b" "] + w[:-1], w))
        assert abs(r.score - want) < 2e-4 * len(w)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
    # the followers of a context share its whole probability
    context = max((a for a in followers), key=lambda a: followers[a])
    seen = sum((pairs[context, x] - d + d * followers[context] * p1(x)) / c[context] for x in c if pairs[context, x])
    rest = d * followers[context] / c[context] * (sum(p1(x) for x in c if not pairs[context, x]) + 0.1 / (n + 0.1 * (v + 1)))
    assert seen + rest == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_classifiers_held_out(spark, sf):
    by = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [(r.predicted, by[r.doc_id].quality) for r in Q.op3_quality_fm(spark, sf).collect() if r.held_out and r.doc_id in by]
    assert np.mean([a == b for a, b in good]) > 0.95
    toxic = [(r.predicted, by[r.doc_id].toxic, r.score) for r in Q.op10_toxicity_mil(spark, sf).collect() if r.held_out and r.doc_id in by]
    assert np.mean([a == b for a, b, _ in toxic]) > 0.9
    assert np.mean([s for _, b, s in toxic if b == 1]) > 5 * np.mean([s for _, b, s in toxic if b == 0])


def test_factorisation_identity():
    rng, k = np.random.default_rng(1), BUCKETS + len(STATISTICS)
    fm = FactorisationMachine(0.3, rng.normal(size=k), rng.normal(size=(k, 4)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    index, x = np.array([1, 5, 9, 700]), rng.normal(size=4)
    want = 0.3 + fm.weights[index] @ x + sum(fm.factors[index[i]] @ fm.factors[index[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert fm.margin(index, x)[0] == pytest.approx(want)
    assert noisy_or(np.array([0.5, 0.5])) == pytest.approx(0.75) and noisy_or(np.zeros(0)) == 0


def _archive(n=6, packed=True):
    out = []
    for i in range(n):
        r = W.record_bytes(i, f"http://a/{i}", b"payload %d " % i * 50, W._sha1(b"x"), None, False, 7)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(pack.compress(r) + pack.flush() if packed else r)
    return out


def _salvaged(data):
    class Slow(io.RawIOBase):
        def __init__(self):
            self.inner = io.BytesIO(data)

        def read(self, n=-1):
            return self.inner.read(97)

    return list(W.salvage(Slow()))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = _archive(packed=packed)
    assert [x.headers["warc-record-id"] for x in _salvaged(b"".join(parts))] == [f"<urn:page:{i}>" for i in range(6)]
    at = len(parts[0]) + len(parts[1])
    broken = bytearray(b"".join(parts))
    broken[at + len(parts[2]) // 2] ^= 0x55  # inside the third record
    got = _salvaged(bytes(broken))
    assert [type(x).__name__ for x in got] == ["Record", "Record", "Gap", "Record", "Record", "Record"]
    assert (got[2].start, got[2].end) == (at, at + len(parts[2])) and got[2].reason
    noise = b"noise WARC/ \x1f\x8b\x08 noise" + parts[0] + b"\x00" * 50 + parts[1] + parts[2][:-9]
    got = _salvaged(noise)
    assert [type(x).__name__ for x in got] == ["Gap", "Record", "Gap", "Record", "Gap"]
    assert sum(x.end - x.start for x in got) == len(noise)
    assert _salvaged(b"") == []


def test_salvage_in_spark(spark, tmp_path):
    parts = _archive()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(parts[0] + b"junk" + parts[1])
    rows = W.read_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert [(r.start, r.gap is not None) for r in rows] == [(0, False), (len(parts[0]), True), (len(parts[0]) + 4, False)]


def _brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _brute_components(160, links)
    assert got == {i: want[i] for a, b in links for i in (a, b)}
    forest = Forest(160)
    forest.add(*np.array(links[:-1]).T)
    assert forest.root.tolist() == want


def test_simhash_equals_brute_force(spark, texts):
    ids = sorted(texts)
    prints = []
    for i in ids:
        w = lower_words(texts[i].encode())
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = _brute_components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op5_simhash_trie(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", ids[w]) for d, p, w in zip(ids, prints, want)}


@pytest.mark.parametrize("bits,budget,segments,rows", [(64, 2, S.THIRDS, 400), (64, 2, S.THIRDS, 60), (512, 80, S.WIDE_TRIES, 120)])
def test_trie_links(spark, monkeypatch, bits, budget, segments, rows):
    """Clusters of close fingerprints, in one block and in many."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(rows)
    base = rng.integers(0, 256, (4, bits // 8), np.uint8)
    keys = set()
    for k in range(rows):
        key = base[k % 4].copy()
        for b in rng.integers(0, bits, rng.integers(0, 5 if bits == 64 else 90)):
            key[b // 8] ^= 1 << (b % 8)
        keys.add(key.tobytes())
    keys = sorted(keys)
    wide = [int.from_bytes(k, "big") for k in keys]
    links = [(i, j) for i in range(len(keys)) for j in range(i) if (wide[i] ^ wide[j]).bit_count() <= budget]
    want = _brute_components(len(keys), links)
    got = {bytes(r.fp): bytes(r.root) for r in S.near_groups(spark.createDataFrame([(bytearray(k),) for k in keys], "fp binary"), bits, budget, segments).collect()}
    same = sum((got[a] == got[keys[w]]) for a, w in zip(keys, want))
    assert len(set(got.values())) == len(set(want)) if bits == 64 else same > 0.97 * len(keys)
    if bits == 64:
        assert all(got[a] == keys[w] for a, w in zip(keys, want))
    found = set()
    order = np.array([np.frombuffer(k, np.uint8) for k in keys])
    for u, v in S.trie_links(order, np.array([0, len(keys)]), 0, budget):
        found |= {(max(a, b), min(a, b)) for a, b in zip(u.tolist(), v.tolist())}
    assert found == set(links)


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(5)
    item = [f"t{rng.randint(0, 10**6)}" for _ in range(45)]
    short = [f"s{i}" for i in range(7)]
    near, far, gap = item.copy(), item.copy(), item.copy()
    for i in (5, 17, 30):
        near[i] = "other"
    for i in range(0, 45, 3):
        far[i] = "other"
    docs = [
        (1, " ".join(["a"] * 30 + item)), (2, "x " + " ".join(near).upper()), (3, " ".join(far)), (4, " ".join(item[:9])),
        (5, " ".join(item[13:])), (6, "b " + " ".join(short)), (7, "b " + " ".join(short[:4])), (8, " ".join(item[:20] + gap[24:])),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "t1 t2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.matched, r.compared) for r in find_overlaps(frame, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 1), (6, 2)}
    assert got[(1, 1)] == (30, 32, 32) and got[(5, 1)] == (-13, 32, 32) and got[(6, 2)] == (1, 7, 7)


def test_overlaps_find_all_passages(spark, texts):
    items = {r.item_id: " ".join(w.decode() for w in lower_words(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = {i: " ".join(w.decode() for w in lower_words(t.encode())) for i, t in texts.items()}
    want = {(i, k) for i, t in plain.items() for k, x in items.items() if f" {x} " in f" {t} "}
    assert want <= {(r.doc_id, r.item_id) for r in Q.op6_spaced_seeds(spark, SF).collect()}


def _lines_of(text):
    found = [(n, tuple(x.split())) for n, x in enumerate(text.split("\n"))]
    return [f for f in found if f[1]]


def _repeated_lines(texts, least):
    """Lines (document, line number) in a run of ``least`` words that equals one at an earlier place: all documents are compared."""
    lines = {i: _lines_of(t) for i, t in texts.items()}
    gone = set()
    for i in lines:
        for j in (j for j in lines if j <= i):
            x, y = lines[i], lines[j]
            for shift in range(1 if i == j else -len(y) + 1, len(x)):
                run = []
                for a in range(max(shift, 0), min(len(x), len(y) + shift) + 1):
                    if a < min(len(x), len(y) + shift) and x[a][1] == y[a - shift][1]:
                        run.append(a)
                        continue
                    if sum(len(x[k][1]) for k in run) >= least:
                        gone |= {(i, x[k][0]) for k in run}
                    run = []
    return gone


def _check_line_dedup(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = dedup_lines(frame).collect()
    gone = {(r.doc_id, n) for r in rows for s in r.removed for n in range(s["first"], s["last"] + 1)}
    gone = {(i, n) for i, n in gone if texts[i].split("\n")[n].split()}
    assert _repeated_lines(texts, RUN_WORDS + SPREAD_WORDS) <= gone <= _repeated_lines(texts, RUN_WORDS)
    return {r.doc_id: r.text for r in rows}


def test_line_dedup_finds_every_repeat(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{k}x{rng.randint(0, 99)}" for _ in range(rng.choice([1, 4, 9, 14, 25]))) for k in range(24)]
    texts = {}
    for i in range(90):
        out = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randrange(len(pool))
            out += pool[a:a + rng.randint(1, 9)] + [""] * rng.randint(0, 1) + [f"own {i} {j} {rng.random()}" for j in range(rng.randint(0, 2))]
        texts[i] = "\n".join(out)
    got = _check_line_dedup(spark, texts)
    # Something is left of each line.
    everything = "\n".join(got.values())
    assert all(line in everything for t in texts.values() for line in t.split("\n"))


def test_line_dedup_beyond_the_first_occurrence(spark):
    """The first document with a passage's beginning holds no more of it; the second holds what the third repeats."""
    one, two = (" ".join(f"{n}{k}" for k in range(words)) for n, words in (("a", 30), ("b", 25)))
    texts = {1: one + "\nmore of the first", 2: f"{one}\n{two}\nother tail", 3: f"head\n{one}\n{two}\nlast tail", 4: f"{two}\n{one}\n{two}\n{one}"}
    got = _check_line_dedup(spark, texts)
    assert got[3] == "head\nlast tail" and got[1] == texts[1]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(600):
        x = centres[i % 6] + rng.normal(size=24) * (0.02 if i % 3 else 0.16)
        rows.append((i, [float(np.float32(v)) for v in x], i % 6 % 2))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ids, label = [r[0] for r in rows], np.array([r[2] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    norms = np.linalg.norm(x, axis=1)
    near = ((x @ x.T) / np.outer(norms, norms) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = _brute_components(len(rows), list(zip(*np.nonzero(near))))
    assert near.sum() > 1000
    assert got == {i: (int(n), ids[w], ids[w] == i) for i, n, w in zip(ids, near.sum(1), want)}
