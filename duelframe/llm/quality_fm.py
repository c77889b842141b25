"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import lower_words, pieces, quoted, utf8
from duelframe.llm.samples import labelled_sample

BUCKETS = 1 << 13
FACTORS = 8
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = (
    "length", "words", "word_length", "upper", "digits", "marks", "distinct", "commonest", "repeats", "lines", "line_words", "marked_ends", "bare_marks", "n_chars",
)


def statistics(data: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Fourteen numbers about the form of a text, each within a small fixed range; all 0 for an empty text."""
    size, n = len(data), len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    upper = size - len(data.translate(None, _UPPER))
    digits = size - len(data.translate(None, _DIGITS))
    marks = size - len(data.translate(None, _MARKS))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lines = data.count(b"\n") + 1
    return [
        np.log1p(size) / 10, np.log1p(n) / 10, min(size / n, 50) / 10, upper / size, digits / size, marks / size,
        len(counts) / n, max(counts.values()) / n, repeats / n, min(lines / n, 1.0), np.log1p(n / lines) / 5,
        sum(w[-1] in _MARKS for w in words) / n, sum(not w.translate(None, _MARKS) for w in words) / n,
        np.log1p(max(n_chars or 0, 0)) / 10,
    ]


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hash buckets of the words."""
    return np.unique(np.fromiter((zlib.crc32(w) for w in set(words)), np.int64) % BUCKETS).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    for batch in pieces(batches, "data"):
        found, stats = [], []
        for data, n_chars in zip(batch.column("data").to_pylist(), batch.column("n_chars").to_pylist()):
            words = lower_words(data or b"")
            found.append(word_buckets(words))
            stats.append(statistics(data or b"", words, n_chars))
        yield batch.select(carry), found, np.array(stats, float).reshape(len(found), len(STATISTICS))


@dataclass
class FactorisationMachine:
    """bias + <w, x> + the sum over pairs i<j of <v_i, v_j> x_i x_j.

    Word buckets have the value 1/sqrt(their number), statistics are standardised. Size is fixed:
    (BUCKETS + 14) x (1 + FACTORS) numbers.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def sparse(self, buckets: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([np.full(len(buckets), 1 / np.sqrt(max(len(buckets), 1))), np.clip((stats - self.mean) / self.scale, -5, 5)])
        return np.concatenate([buckets, BUCKETS + np.arange(len(stats))]), x

    def margin(self, index: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Linear time: the pair sum is half of (sum of v x) squared less the sum of squares."""
        vx = self.factors[index] * x[:, None]
        total = vx.sum(0)
        return self.bias + self.weights[index] @ x + 0.5 * float((total * total - (vx * vx).sum(0)).sum()), total

    def probability(self, buckets: np.ndarray, stats: np.ndarray) -> float:
        z, _ = self.margin(*self.sparse(buckets, stats))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_machine(buckets: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.1, ridge: float = 1e-4) -> FactorisationMachine:
    """Adagrad on the logistic loss, rows in an order drawn once per epoch with a fixed seed; classes weigh the same."""
    rng = np.random.default_rng(7)
    mean, scale = (stats.mean(0), stats.std(0)) if len(stats) else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    n = BUCKETS + len(STATISTICS)
    fm = FactorisationMachine(0.0, np.zeros(n), rng.normal(0, 0.05, (n, FACTORS)), mean, scale)
    gw, gv, gb = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    share = {c: 0.5 * len(y) / max((y == c).sum(), 1) for c in (0, 1)}
    rows = [fm.sparse(b, s) for b, s in zip(buckets, stats)]
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            index, x = rows[r]
            z, total = fm.margin(index, x)
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[r]) * share[int(y[r])]
            dw = g * x + ridge * fm.weights[index]
            v = fm.factors[index]
            dv = g * x[:, None] * (total - v * x[:, None]) + ridge * v
            gw[index] += dw * dw
            gv[index] += dv * dv
            gb += g * g
            fm.weights[index] -= rate * dw / np.sqrt(gw[index])
            fm.factors[index] -= 0.5 * rate * dv / np.sqrt(gv[index])
            fm.bias -= rate * g / np.sqrt(gb)
    return fm


def _input(docs: DataFrame) -> list[Column]:
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return [utf8("text").alias("data"), n_chars.alias("n_chars")]


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = 2500) -> FactorisationMachine:
    """Learns ``labels.quality`` from at most ``rows_per_class`` labelled rows of each class.

    The features of these rows are computed by tasks; the sample (2 x ``rows_per_class`` rows of at most
    BUCKETS small integers) comes to the driver. Without rows of both classes every score is the share of
    good rows, or 0.5 without any row.
    """
    def rows(batches):
        for kept, found, stats in _features(batches, ["y"]):
            yield pa.RecordBatch.from_arrays(
                [kept.column("y"), pa.array([f.tolist() for f in found], pa.list_(pa.int32())), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                ["y", "buckets", "stats"],
            )

    sample = labelled_sample(docs, labels, "quality", learn, rows_per_class, _input(docs))
    got = sample.select(F.col("y").cast("int").alias("y"), "data", "n_chars").mapInArrow(rows, "y int, buckets array<int>, stats array<double>").toArrow()
    # A fixed order, as tasks may end in any.
    table = got.to_pylist()
    table.sort(key=lambda r: (r["y"], r["buckets"], r["stats"]))
    y = np.array([r["y"] for r in table], float)
    if len(set(y)) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        empty = fit_machine([], np.zeros((0, len(STATISTICS))), np.zeros(0))
        empty.factors[:] = 0
        empty.bias = float(np.log(p / (1 - p)))
        return empty
    return fit_machine([np.array(r["buckets"], np.int64) for r in table], np.array([r["stats"] for r in table]), y)


def score_quality(docs: DataFrame, model: FactorisationMachine, carry: list[str], name: str = "score") -> DataFrame:
    """The columns ``carry`` and one called ``name``: the probability of good quality, for every row and whole text.

    Null texts are scored as empty ones, null n_chars as 0. Neither language, source, id nor labels are read.
    """
    def rows(batches):
        for kept, found, stats in _features(batches, [f"c{i}" for i in range(len(carry))]):
            scores = pa.array([model.probability(b, s) for b, s in zip(found, stats)], pa.float64())
            yield pa.RecordBatch.from_arrays([*kept.columns, scores], [*kept.schema.names, "score"])

    given = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(carry)), *_input(docs))
    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    scored = given.mapInArrow(rows, f"{types}, score double")
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), F.col("score").alias(name))
