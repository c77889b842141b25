"""The multiple-instance fit against a plain gradient, and what it finds on held-out texts."""

import numpy as np
import pytest

from duelframe.llm import queries as Q
from duelframe.llm import toxicity_mil as T


@pytest.mark.parametrize("sf, recall, alarms", [("sf0.1", 0.9, 0.01), ("sf0.01", 0.6, 0.01)])
def test_held_out(spark, sf, recall, alarms):
    folder = f"/root/testdata/{sf}"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").collect()}
    rows = [(r.predicted, toxic[r.doc_id]) for r in Q.op10_toxicity_mil(spark, folder).collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([p for p, y in rows if y]) >= recall
    assert np.mean([p for p, y in rows if not y]) <= alarms


def _bags(seed=4, n=60, size=9):
    rng = np.random.default_rng(seed)
    index, lengths, per_bag, y = [], [], [], []
    for i in range(n):
        toxic = i % 3 == 0
        per_bag.append(rng.integers(1, 5))
        y.append(float(toxic))
        for s in range(per_bag[-1]):
            found = set(rng.choice(np.arange(2, size), rng.integers(1, 4), replace=False).tolist())
            if toxic and s == 0:
                found |= {int(rng.integers(0, 2))}
            lengths.append(len(found))
            index += sorted(found)
    return np.array(index), np.array(lengths), np.array(per_bag), np.array(y), size


def _loss(weights, index, lengths, per_bag, y, least):
    """Minus log-likelihood of noisy-or by plain loops, with the penalty."""
    out, at, sentence = least * np.abs(weights).sum(), 0, 0
    for n, toxic in zip(per_bag, y):
        clean = 1.0
        for _ in range(n):
            z = T.FIT_BIAS + weights[index[at:at + lengths[sentence]]].sum()
            clean *= 1 - 1 / (1 + np.exp(-z))
            at, sentence = at + lengths[sentence], sentence + 1
        out -= np.log(1 - clean) if toxic else np.log(clean)
    return out


def test_fit_is_an_optimum_of_the_plain_loss():
    *bags, size = _bags()
    weights = T.fit_instances(*bags, size, steps=4000)
    best = _loss(weights, *bags, 0.5)
    assert (weights[:2] > 3).all() and (weights[2:] < 1).all()
    for j in range(size):
        for step in (-1e-2, 1e-2):
            moved = weights.copy()
            moved[j] += step
            assert _loss(moved, *bags, 0.5) >= best - 1e-6


def test_noisy_or_equals_products():
    rng = np.random.default_rng(1)
    p = rng.random(30) * 0.2
    assert T.noisy_or(p) == pytest.approx(1 - np.prod(1 - p), abs=1e-12)


def test_gain_of_one_class_is_one():
    index, lengths, per_bag, y, size = _bags()
    part = np.arange(len(y)) % 3
    assert T.choose_gain(index, lengths, per_bag, np.zeros(len(y)), size, part) == 1.0
    assert T.choose_gain(index, lengths, per_bag, y, size, part) in T.GAINS
