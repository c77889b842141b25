"""Near copies of the pipeline against exact similarities of all pairs."""

import random

import numpy as np
import pytest

from duelframe.llm import simhash_trie as S


def _similarity(x, y):
    both = len(np.intersect1d(x, y))
    return both / max(1, len(x) + len(y) - both)


@pytest.mark.parametrize("block", [4096, 40])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block):
    """Copies of 0.7 to 0.9, chains of them, one large group around a text, and texts that repeat few shingles."""
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    rng = random.Random(11)
    texts = []
    for k in range(40):
        words = [f"k{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        texts.append(words)
        for _ in range(rng.choice((1, 2, 3)) if k else 110):
            words = (texts[0] if not k else words).copy()
            for _ in range(round(len(words) * rng.uniform(0.015, 0.045))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(words)
    loop = [f"l{i}" for i in range(6)] * 60
    texts += [loop + [f"m{i}" for i in range(20)], loop + [f"n{i}" for i in range(20)]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    sets = [S.shingle_set(t.encode()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and _similarity(sets[i], sets[j]) >= 0.8:
                high, low = max(root[i], root[j]), min(root[i], root[j])
                root = [low if r == high else r for r in root]
    want = {i for i, r in enumerate(root) if i == r}
    assert {r.doc_id for r in S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
