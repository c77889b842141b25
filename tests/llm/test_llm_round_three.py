"""Hard negatives, the Merkle manifest and BPE with word ends against plain forms and libraries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duelframe.llm import hard_negatives as H
from duelframe.llm import queries as Q
from duelframe.llm.merkle_manifest import verify_documents
from duelframe.llm.word_bpe import _Memory, decode, encode, merge_word, merge_words, read_vocabulary
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest"])
def test_equals_sql(spark, name):
    result = compare(spark, duck(SF), name, Q.QUERIES[name], Q.SQL[name], SF)
    assert result.startswith("ok") and "TYPES" not in result, result


# -- hard negatives ------------------------------------------------------------------------------------------

def _plain_negatives(rows, positives=5, negatives=10):
    """All products, by the contract's words."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    ints = {i: (label, [math.floor(256.0 * x) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a, (label, v) in ints.items():
        if a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, other) for j, (other, w) in ints.items() if j != a and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(a, p, r, n, ps, ns) for r, (ns, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def _mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return sorted(map(tuple, H.mine_negatives(df, F.col("id") % 100 == 0).collect()))


def _vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, size))
    x = middle[rng.integers(0, 7, n)] * 0.6 + rng.normal(size=(n, size)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), int(rng.integers(0, 4)), list(map(float, v))) for i, v in enumerate(x)]


def test_negatives_equal_all_products(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 150)
    monkeypatch.setattr(H, "ANCHORS", 4)
    rows = _vectors(900, 21, 3)
    # A hot vector under two labels, repeated ids, other lengths, nulls, zeros and components that are no numbers.
    rows += [(1000 + i, i % 2, rows[7][2]) for i in range(120)] + rows[:30] + [(5, 3, rows[9][2])]
    rows += [(2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [None] * 21), (2003, 1, [float("nan")] * 21), (2004, 1, [float("inf")] * 21)]
    rows += [(2100, 1, [0.0] * 21), (2200, 1, [1.0, 2.0]), (2201, 1, [1.0, 1.5]), (2202, 2, [0.5, 1.0]), (2300, 2, []), (2301, 2, []), (2302, 3, []), (None, 1, rows[0][2])]
    assert _mined(spark, rows) == _plain_negatives(rows)


def test_negatives_of_large_components(spark):
    rows = [(i, i % 3, [float((i * 37 + k * 11) % 19 - 9) * 10.0 ** (i % 7) for k in range(5)]) for i in range(0, 300, 5)]
    assert _mined(spark, rows) == _plain_negatives(rows)
    absurd = [(0, 0, [1e307, 1.0]), (1, 0, [1e300, 2.0]), (2, 1, [1.0, 5.0]), (3, 1, [1e305, -1e300]), (100, 1, [1.0, 4.0]), (101, 1, [2.0, 2.0])]
    for row in _mined(spark, absurd):
        assert all(-(1 << 63) <= v < 1 << 63 for v in row)
    assert _mined(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 40), st.floats(0.05, 1.2), st.floats(0.1, 3))
def test_index_finds_every_pair_above_the_thresholds(seed, size, share, spread):
    rng = np.random.default_rng(seed)
    x, y = (np.floor(256 * rng.normal(size=(n, size)) * spread ** np.arange(size)[None, :] ** 0.3) for n in (6, 80))
    least = share * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
    cuts = [*range(0, size, H.STEP), size]
    reach = (H._tails(x, cuts) / np.maximum(least[:, None], 1e-300)).max(0)
    found = {(int(i), int(j)): s for part in H.Index(y, cuts, reach).matches(x, least) for i, j, s in zip(*part)}
    product = x @ y.T
    assert found == {(int(i), int(j)): product[i, j] for i, j in zip(*np.nonzero(product >= least[:, None]))}


# -- Merkle manifest -----------------------------------------------------------------------------------------

def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def _siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return out


def _plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], _sha("".join(map(_field, r))), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = []
    for k in keys:
        groups[k].sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees.append(_tree([m[1] for m in groups[k]]))
    top, out = _tree([t[-1][0] for t in trees]), []
    lower = {a: a + 32 for a in range(65, 91)}
    for t, k in enumerate(keys):
        for i, (doc, leaf, r) in enumerate(groups[k]):
            beside, folded = _siblings(trees[t], i) + _siblings(top, t), leaf
            if zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 0:
                folded = _sha("".join(map(_field, (*r[:4], r[4] and r[4].translate(lower)))))
            for a, b in beside:
                folded = _sha("".join(a) + folded + "".join(b))
            proof = _sha("".join("".join(a) + "".join(b) for a, b in beside))
            out.append((doc, leaf, trees[t][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def _rows(n, sources):
    rng = random.Random(n)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "Ünïcode TEXT", f"Text {i}", "abc"])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    _rows(700, ["a"] * 6 + ["b", None, "Ä", "", "z"]), _rows(33, ["only"]), _rows(1, [None]), [],
    [(i, f"s{i:03}", "en", 1, "X") for i in range(280)],
    _rows(40, ["a", None]) * 3 + [(None, "a", None, None, None)] * 20 + [(None, None, "x", 3, "y")],
    [(i, "hot", "en", i, "Word " * 40000) for i in range(5)],
], ids=["many", "one source", "one row", "none", "sources of one", "repeated", "long"])
def test_manifest_equals_plain_form(spark, rows, monkeypatch):
    monkeypatch.setattr("duelframe.llm.merkle_manifest.STRETCH", 64)
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1))
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    assert sorted(map(tuple, verify_documents(df, tampered).collect()), key=str) == _plain_manifest(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


# -- BPE with word ends --------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  \n\t ", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|><|endoftext", "ΑΣ ΣΑΣ Σ", "İI ẞß", "é ẛ̣", "Hello, DON'T we'Ll I'm",
    "a\x1cb\x85c d᠎e​f", "一二三 ABC123 ½Ⅻ² 😀👍🏽", "x" * 5000, "!" * 4098, "ab" * 3000, "\x00\x01", "ᲉꟋꟜ\U00010d50\U00016ea0",
    "a\U00011de0b\U000123ffc", "it's'll''ve", "A" * 17 + " " + "b" * 16 + " " + "c" * 15,
]


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_word_bpe_equals_the_library(spark):
    documents = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = [(i, t) for i, t in enumerate(ODD + documents)]
    df = spark.createDataFrame(texts * 2, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode(df, PATH, ["doc_id"]).withColumn("back", decode(F.col("ids"), PATH)).collect()
    assert len(got) == 2 * len(texts)
    library = _library()
    for row in got:
        wanted = library.encode(dict(texts)[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == wanted
        assert row["back"] == library.decode(wanted, skip_special_tokens=False)
    assert encode(df.limit(0), PATH, ["doc_id"]).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdefinthou'ABΣé漢<|>12 ́\x1c"), max_size=40), max_size=8))
def test_any_text_equals_the_library(texts):
    got = _Memory(read_vocabulary(PATH)).encode(texts).to_pylist()
    assert got == [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("inthe raswo"), min_size=1, max_size=70), max_size=12))
def test_trees_side_by_side_equal_one_tree(words):
    vocabulary = read_vocabulary(PATH)
    words = [w.encode() for w in words]
    assert merge_words(words, vocabulary) == [merge_word(w, vocabulary) for w in words]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("duelframe.llm.word_bpe.REMEMBERED", 3)
    memory = _Memory(read_vocabulary(PATH))
    texts = ["one two three four", "five one", "six", "one seven"]
    once = [memory.encode([t]).to_pylist()[0] for t in texts]
    assert once == _Memory(read_vocabulary(PATH)).encode(texts).to_pylist()


# -- embeddings of any magnitude -----------------------------------------------------------------------------

def test_embeddings_of_extreme_magnitudes(spark):
    from duelframe.llm.embedding_tiles import link_embeddings

    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [-3.0, 0.5, 1.0]]
    rows = [(i, [v * scale for v in base[i % 3]], 1) for i, scale in enumerate([1.0, 1.0, 1.0, 1e200, 1e-200, 1e300, 1e-300, 1e308 / 4, 1e-160])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (2, 2) if i % 3 == 2 else (5, 0) for i in range(9)}
