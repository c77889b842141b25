"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import pieces, quoted, utf8
from duelframe.llm.samples import labelled_sample

STEM = 5
#: Bias of a sentence while weights are learned, and of the model: at the first, weak evidence counts, at the second,
#: thousands of clean sentences do not add up to a toxic text. A gain on the weights, chosen on held-back texts, links them.
FIT_BIAS, BIAS = -6.0, -11.0
GAINS = (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0)
#: Parts of the sample, each held back once; a false alarm weighs as much as so many misses, in shares of the classes.
PARTS, ALARM, TOXIC_FROM = 3, 4, 0.3
#: Ends of sentences become line feeds, other ASCII marks become spaces, A-Z become a-z; lengths stay.
_PLAIN = bytes(
    10 if c in b".!?\n\r" else 32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c
    for c in range(256)
)


def sentences(data: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence in byte offsets; sentences without words are left out."""
    out, start = [], 0
    for part in data.translate(_PLAIN).split(b"\n"):
        words = part.split()
        if words:
            out.append((start, start + len(part), words))
        start += len(part) + 1
    return out


def features(words: list[bytes]) -> set[bytes]:
    """Distinct words and, for longer ones, their first STEM bytes behind a mark."""
    return {*words, *(b"^" + w[:STEM] for w in words if len(w) > STEM)}


@dataclass
class InstanceModel:
    """A sentence is toxic with probability sigmoid(BIAS + sum of its features' weights)."""

    weights: dict[bytes, float]

    def sentence_scores(self, found: list[tuple[int, int, list[bytes]]]) -> np.ndarray:
        get = self.weights.get
        z = np.array([sum(get(f, 0.0) for f in features(words)) for _, _, words in found], float) + BIAS
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(p: np.ndarray) -> float:
    """The probability that at least one sentence is toxic; 0 without any."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit_instances(index: np.ndarray, lengths: np.ndarray, per_bag: np.ndarray, y: np.ndarray, size: int, steps: int = 200, least: float = 0.5) -> np.ndarray:
    """Proximal gradient on the log-likelihood of noisy-or with an absolute-value penalty; gives the weights.

    ``index`` holds the feature numbers (below ``size``) of all sentences one after the other, ``lengths`` how
    many each sentence has, ``per_bag`` how many sentences each document has (one at least). The penalty
    ``least`` is the evidence, in documents, that a feature needs to get any weight. The bias stays at FIT_BIAS.
    """
    weights = np.zeros(size)
    if not len(y) or not y.any():
        return weights
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    bag_begins = np.concatenate([[0], np.cumsum(per_bag)[:-1]])
    toxic = np.repeat(y, per_bag) == 1
    pace = 1 / (0.25 * np.bincount(index, minlength=size) * np.sqrt(lengths.mean()) + 2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(FIT_BIAS + np.add.reduceat(weights[index], begins), -40, 40)))
        whole = np.clip(-np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), bag_begins)), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p in a clean text, -p (1 - P) / P in a toxic one
        dz = np.where(toxic, -p * np.repeat((1 - whole) / whole, per_bag), p)
        moved = weights - pace * np.bincount(index, np.repeat(dz, lengths), size)
        weights = np.sign(moved) * np.maximum(np.abs(moved) - pace * least, 0)
    return weights


def choose_gain(index: np.ndarray, lengths: np.ndarray, per_bag: np.ndarray, y: np.ndarray, size: int, part: np.ndarray) -> float:
    """The largest of GAINS that parts texts best when they are held back: found toxic texts against ALARM times false alarms.

    Each ``part`` of the texts is scored by weights learned from the others. 1 without texts of both classes.
    """
    sentence_bag = np.repeat(np.arange(len(y)), per_bag)
    feature_bag = np.repeat(sentence_bag, lengths)
    scores = np.zeros((len(GAINS), len(y)))
    for k in np.unique(part):
        out = part == k
        if not y[~out].any() or y[~out].all():
            continue
        rest = ~out
        weights = fit_instances(index[rest[feature_bag]], lengths[rest[sentence_bag]], per_bag[rest], y[rest], size)
        sums = np.add.reduceat(weights[index[out[feature_bag]]], np.cumsum(lengths[out[sentence_bag]]) - lengths[out[sentence_bag]])
        begins = np.cumsum(per_bag[out]) - per_bag[out]
        for g, gain in enumerate(GAINS):
            p = 1 / (1 + np.exp(-np.clip(BIAS + gain * sums, -40, 40)))
            scores[g, out] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), begins))
    if not y.any() or y.all():
        return 1.0
    found = scores >= TOXIC_FROM
    worth = found[:, y == 1].mean(1) - ALARM * found[:, y == 0].mean(1)
    return GAINS[int(np.flatnonzero(worth == worth.max())[-1])]


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = 2500) -> InstanceModel:
    """Learns ``labels.toxic`` from whole texts of at most ``rows_per_class`` labelled rows of each class.

    Tasks turn the sample into features; the driver gets those of 2 x ``rows_per_class`` texts. The model
    keeps the features with weight, of these texts only. Without toxic rows nothing is learned and every
    score stays small.
    """
    def rows(batches):
        for batch in pieces(batches, "data"):
            bags = [[list(features(words)) for _, _, words in sentences(d or b"")] for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("y"), pa.array([xxhash.xxh64_intdigest(d or b"") % PARTS for d in batch.column("data").to_pylist()], pa.int64()),
                pa.array([[len(f) for f in bag] for bag in bags], pa.list_(pa.int64())),
                pa.array([[w for f in bag for w in f] for bag in bags], pa.list_(pa.binary())),
            ], ["y", "part", "lengths", "found"])

    sample = labelled_sample(docs, labels, "toxic", learn, rows_per_class, [utf8("text").alias("data")])
    got = sample.select(F.col("y").cast("int").alias("y"), "data").mapInArrow(rows, "y int, part bigint, lengths array<bigint>, found array<binary>").toArrow().combine_chunks()
    per_bag = pc.list_value_length(got.column("lengths")).to_numpy()
    got, per_bag = got.filter(pa.array(per_bag > 0)), per_bag[per_bag > 0]
    named = pc.list_flatten(got.column("found")).combine_chunks().dictionary_encode()
    named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
    lengths, index = pc.list_flatten(got.column("lengths")).to_numpy(), named.indices.to_numpy()
    sample = index, lengths, per_bag, got.column("y").to_numpy().astype(float), len(named.dictionary)
    weights = choose_gain(*sample, got.column("part").to_numpy()) * fit_instances(*sample)
    used = np.flatnonzero(weights)
    return InstanceModel(dict(zip(named.dictionary.take(pa.array(used)).to_pylist(), weights[used].tolist())))


def score_toxicity(docs: DataFrame, model: InstanceModel, carry: list[str], offending: float = 0.3) -> DataFrame:
    """The columns ``carry``, ``score``, ``n_sentences`` and ``offending``, for every row and whole text.

    ``offending`` lists the sentences with a score of at least ``offending``: start and end in characters and
    the score, in the order of the text. Null and empty texts have no sentence and the score 0.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def rows(batches):
        for batch in pieces(batches, "data"):
            scores, numbers, where = [], [], []
            for data in batch.column("data").to_pylist():
                data = data or b""
                found = sentences(data)
                p = model.sentence_scores(found)
                scores.append(noisy_or(p))
                numbers.append(len(found))
                where.append([
                    {"start": len(data[:a].decode("utf-8", "ignore")), "end": len(data[:b].decode("utf-8", "ignore")), "score": float(s)}
                    for (a, b, _), s in zip((found[i] for i in np.flatnonzero(p >= offending)), p[p >= offending])
                ])
            kept = batch.select([f"c{i}" for i in range(len(carry))])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(scores, pa.float64()), pa.array(numbers, pa.int64()), pa.array(where, spans)],
                [*kept.schema.names, "score", "n_sentences", "offending"],
            )

    given = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(carry)), utf8("text").alias("data"))
    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    scored = given.mapInArrow(rows, f"{types}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>")
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "score", "n_sentences", "offending")
