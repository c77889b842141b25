"""Seeds and excerpts of benchmark texts."""

import random
from itertools import combinations

import pytest

from duelframe.llm import spaced_seeds as S


@pytest.mark.parametrize("length", range(S.SHORTEST, 26))
def test_masks_hit_every_tolerated_pattern(length):
    """All places of a fifth of the tokens. Runs of 26 and more hold a shorter run that agrees as well."""
    masks = S.MASKS if length >= S.LONG else S.SHORT_MASKS
    seeds = [sum(1 << (o + at) for o in mask) for mask in masks for at in range(-mask[0], length - mask[-1])]
    for changed in combinations(range(length), length // 5):
        pattern = sum(1 << i for i in changed)
        assert any(not pattern & seed for seed in seeds), changed


def test_excerpts_and_short_items(spark):
    rng = random.Random(3)
    item = [f"t{i}" for i in range(59)]
    bench = {1: item, 2: [f"u{i}" for i in range(12)], 3: ["one"], 4: ["v1", "v2"], 5: ["w1", "w2", "w3", "w4"], 6: [f"x{i}" for i in range(18)]}
    docs, want = {}, set()

    def add(tokens, *items):
        docs[len(docs)] = [f"a{rng.random()}" for _ in range(20)] + tokens + [f"b{rng.random()}" for _ in range(20)]
        want.update((len(docs) - 1, i) for i in items)

    for n in (13, 16, 20, 24, 25):
        for at in range(0, 59 - n + 1, 3):
            add(item[at:at + n], 1)
    add(item[5:15])
    add(item[9:30] + item[34:], 1)
    add([t if i % 3 else "no" for i, t in enumerate(item)])
    for i in range(12):
        add(bench[2][:i] + ["no"] + bench[2][i + 1:], 2)
    for changed in combinations(range(18), 3):
        if not rng.randrange(20):
            add([t if i not in changed else "no" for i, t in enumerate(bench[6])], 6)
    add(["one"], 3)
    add(["v1", "v2"], 4)
    add(["v1", "x", "v2"])
    add(["w1", "w2", "w3", "w4"], 5)
    add(["w1", "w2", "w3"])
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in bench.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.matched, r.compared) for r in S.find_overlaps(frame, items, S.EXCERPT).collect()}
    assert set(got) == want
    assert got[(0, 1)] == (20, 13, 13)
    assert {r.doc_id for r in S.clean_documents(frame, items).collect()} == set(docs) - {d for d, _ in want}
