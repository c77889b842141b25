"""Hard negatives by threshold joins: an inverted index without the dimensions that a bound covers, falling thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage, shared_folder

#: Rows and anchors that meet in one unit of work.
ROWS, ANCHORS = 8192, 8192
#: Cells of the partial scores that a task holds, and pairs whose dimensions it gathers at once.
CELLS, _PAIRS = 1 << 22, 1 << 15
#: Dimensions of one list of the index.
STEP = 8
#: How far into a window the threshold falls, step by step.
FALLS = (0.1, 0.3, 1.0)
#: Components from this size on are multiplied as whole numbers of any length; below, sums of up to 2^12 are exact doubles.
LARGE = float(1 << 20)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(256 x) of each component, as doubles; products beyond the range of doubles stay at its end."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.clip(256.0 * flat, -np.finfo(np.float64).max, np.finfo(np.float64).max)
    return np.floor(scaled).reshape(len(column), -1)


def _tails(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of each row from each cut on (rows by cuts)."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1] if x.shape[1] else np.zeros((len(x), 0))
    squares = np.concatenate([squares, np.zeros((len(x), 1))], axis=1)
    return np.sqrt(squares[:, cuts])


class Index:
    """Lists of the rows for each block of dimensions; of a row, dimensions are left out that cannot make a match.

    ``reach``: for each cut, the largest share of its threshold that a query can get from a unit of norm beyond the
    cut. A row whose norm beyond a cut times that stays below 1 is not in the lists from there on: a pair that
    meets only there stays below the threshold.
    """

    def __init__(self, y: np.ndarray, cuts: list[int], reach: np.ndarray):
        self.cuts = cuts
        tails = _tails(y, cuts)
        with np.errstate(invalid="ignore"):
            needed = ~(tails * reach[None, :] * (1 + 1e-9) < 1)
        # The last cut behind which something is needed; lists up to it.
        last = np.where(needed.any(1), len(cuts) - np.argmax(needed[:, ::-1], axis=1), 0)
        last = np.minimum(last, len(cuts) - 1)
        self.rows = np.argsort(-last, kind="stable")
        self.y, self.tails = y[self.rows], tails[self.rows]
        self.listed = [int((last > b).sum()) for b in range(len(cuts) - 1)]

    def matches(self, x: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) with score >= least[query].

        Partial scores are summed list by list; a pair whose partial score and product of remaining norms stay
        below the threshold is pruned. Once few pairs are left, only theirs are summed on.
        """
        n, cuts = self.listed[0] if self.listed else len(self.y), self.cuts
        tails = _tails(x, cuts)
        got = np.zeros((len(x), n))
        alive = np.ones((len(x), n), bool)
        done = 0
        for b, m in enumerate(self.listed):
            if not m:
                break
            got[:, :m] += x[:, cuts[b]:cuts[b + 1]] @ self.y[:m, cuts[b]:cuts[b + 1]].T
            # Rows that lists no longer hold keep the bound of their own cut.
            alive[:, :m] = got[:, :m] + tails[:, b + 1, None] * self.tails[None, :m, b + 1] * (1 + 1e-9) >= least[:, None]
            done = b + 1
            if 8 * int(alive.sum()) < alive.size:
                break
        begun = np.minimum(np.searchsorted(-np.array(self.listed), -np.arange(n), side="left"), done) if self.listed else np.zeros(n, np.int64)
        i, j = np.nonzero(alive)
        for s in range(0, len(i), _PAIRS):
            u, v = i[s:s + _PAIRS], j[s:s + _PAIRS]
            score, at = got[u, v], begun[v]
            for b in range(len(cuts) - 1):
                todo = at <= b
                part = slice(cuts[b], cuts[b + 1])
                score[todo] += np.einsum("ij,ij->i", x[u[todo], part], self.y[v[todo], part])
                near = score + tails[u, b + 1] * self.tails[v, b + 1] * (1 + 1e-9) >= least[u]
                near |= at > b + 1
                u, v, score, at = u[near], v[near], score[near], at[near]
            hit = score >= least[u]
            yield u[hit], self.rows[v[hit]], score[hit]


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of whole numbers of any length, held to 64 bits."""
    def whole(a: np.ndarray) -> np.ndarray:
        return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)

    if not (len(x) and len(y) and x.shape[1]):
        return np.zeros((len(x), len(y)), object)
    return np.clip(whole(x) @ whole(y).T, _LEAST, _MOST)


def fill_windows(
    x: np.ndarray, anchors: np.ndarray, kinds: np.ndarray, windows: list[list[tuple[int, int]]],
    y: np.ndarray, ids: np.ndarray, labels: np.ndarray, need: int, same: bool,
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor's place, window's place, row places, scores): the first ``need`` rows of each window (lo, hi), all if fewer.

    Rows are those of the anchor's label (``same``; but itself) or of other labels; higher scores come first, ties by
    smaller id. The thresholds start high in the windows and fall only for anchors with windows that are not
    full yet.
    """
    size = x.shape[1]
    order = np.argsort(-(y * y).sum(0), kind="stable") if len(y) else np.arange(size)
    u, v = x[:, order], y[:, order]
    cuts = [*range(0, size, STEP), size]
    large_x = (np.abs(x) >= LARGE).any(1) if size else np.zeros(len(x), bool)
    large_y = (np.abs(y) >= LARGE).any(1) if size else np.zeros(len(y), bool)
    plain = np.flatnonzero(~large_y)
    top_y = np.linalg.norm(v[plain], axis=1).max() if len(plain) else 0.0

    def ranked(a: int, at: np.ndarray, scores: list) -> tuple[np.ndarray, list]:
        fits = (labels[at] == kinds[a]) & (ids[at] != anchors[a]) if same else labels[at] != kinds[a]
        at, scores = at[fits], [s for s, f in zip(scores, fits) if f]
        by = sorted(range(len(at)), key=lambda k: (-scores[k], ids[at[k]]))
        return at[by], [scores[k] for k in by]

    def cut(a: int, w: int, at: np.ndarray, scores: list, floor: float) -> tuple[np.ndarray, list]:
        lo, hi = windows[a][w]
        kept = [k for k, s in enumerate(scores) if max(lo, floor) <= s <= hi][:need]
        return at[kept], [scores[k] for k in kept]

    # Large components are few or absurd: their pairs are multiplied in whole numbers, without bounds.
    for a in np.flatnonzero(large_x).tolist():
        at, scores = ranked(a, np.arange(len(y)), _exact(x[a:a + 1], y)[0].tolist())
        for w in range(len(windows[a])):
            yield a, w, *cut(a, w, at, scores, -np.inf)
    beside = np.flatnonzero(large_y)
    norms = np.linalg.norm(u, axis=1)
    small = np.flatnonzero(~large_x)
    chunk = max(1, CELLS // max(len(plain), 1))
    for s in range(0, len(small), chunk):
        part = small[s:s + chunk]
        if len(beside):
            wide = _exact(x[part], y[beside])
            for k, a in enumerate(part.tolist()):
                at, scores = ranked(a, beside, wide[k].tolist())
                for w in range(len(windows[a])):
                    yield a, w, *cut(a, w, at, scores, -np.inf)
        # Bounds of every window by Cauchy-Schwarz; empty ones need no search.
        pending = {}
        for a in part.tolist():
            most = norms[a] * top_y * (1 + 1e-9) + 1
            spans = [(w, max(lo, -most), min(hi, most)) for w, (lo, hi) in enumerate(windows[a])]
            spans = [x for x in spans if x[1] <= x[2]]
            if spans:
                pending[a] = spans
        for fall in FALLS:
            if not pending or not len(plain):
                break
            asked = np.array(list(pending))
            levels = {a: [hi - (hi - lo) * fall for _, lo, hi in spans] for a, spans in pending.items()}
            least = np.array([min(levels[a]) for a in asked.tolist()])
            tails = _tails(u[asked], cuts)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(least[:, None] > 0, tails / np.maximum(least[:, None], 1e-300), np.inf).max(0)
            parts = list(Index(v[plain], cuts, reach).matches(u[asked], least))
            i, j, score = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            j = plain[j]
            fits = (labels[j] == kinds[asked[i]]) & (ids[j] != anchors[asked[i]]) if same else labels[j] != kinds[asked[i]]
            i, j, score = i[fits], j[fits], score[fits]
            by = np.lexsort((ids[j], -score, i))
            i, j, score = i[by], j[by], score[by]
            bounds = np.searchsorted(i, np.arange(len(asked) + 1))
            for k, a in enumerate(asked.tolist()):
                rows, falling = j[bounds[k]:bounds[k + 1]], -score[bounds[k]:bounds[k + 1]]
                open_ = []
                for span, level in zip(pending[a], levels[a]):
                    w = span[0]
                    lo, hi = windows[a][w]
                    first = int(np.searchsorted(falling, -float(hi), side="left"))
                    end = int(np.searchsorted(falling, -max(float(lo), level if fall < 1 else -np.inf), side="right"))
                    if end - first < need and fall < 1:
                        open_.append(span)
                    elif end > first:
                        end = min(end, first + need)
                        yield a, w, rows[first:end], -falling[first:end]
                if open_:
                    pending[a] = open_
                else:
                    del pending[a]


def _search(anchors: DataFrame, rows: DataFrame, group: Column, need: int, same: bool) -> DataFrame:
    """(anchor_id, key, carried, id, score): the first rows of every window of every anchor, over all rows.

    ``anchors``: id, label, x, windows (key, carried, lo, hi); ``rows``: id, label, x. Both are cut by hash into blocks of
    about ANCHORS and ROWS within ``group``; two blocks meet in one unit, which gives at most ``need`` rows for each
    window. The first of these over all units are the first of all.
    """
    spark = rows.sparkSession
    anchors, rows = anchors.withColumn("g", group), rows.withColumn("g", group)
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("row_blocks"))
    asked = anchors.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("anchor_blocks"))
    # Written, so that its size is known when the joins are planned.
    path = shared_folder(spark, "blocks")
    sizes.join(asked, "g").write.parquet(path)
    sizes = spark.read.parquet(path)

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    near = anchors.join(sizes, "g").select("g", block("anchor_blocks").alias("i"), every("row_blocks").alias("j"), F.lit(0).alias("side"), "id", "label", "x", "windows")
    far = rows.join(sizes, "g").select("g", every("anchor_blocks").alias("i"), block("row_blocks").alias("j"), F.lit(1).alias("side"), "id", "label", "x")
    work = near.unionByName(far, allowMissingColumns=True).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "id")
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "key", "carried", "id", "score")])

    def solve(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = unit["x"].combine_chunks().value_lengths().to_numpy()
        side = unit["side"].to_numpy()
        for size in np.unique(lengths[side == 0]):
            held = unit.filter(pa.array(lengths == size))
            m = int((held["side"].to_numpy() == 0).sum())
            x = held["x"].combine_chunks()
            matrix = _matrix(x) if size else np.zeros((len(held), 0))
            ids, labels = held["id"].to_numpy(), held["label"].to_numpy()
            windows = held["windows"].slice(0, m).to_pylist()
            bounds = [[(w["lo"], w["hi"]) for w in ws] for ws in windows]
            out = []
            for a, w, at, scores in fill_windows(matrix[:m], ids[:m], labels[:m], bounds, matrix[m:], ids[m:], labels[m:], need, same):
                found = windows[a][w]
                out += [(int(ids[a]), found["key"], found["carried"], int(ids[m + r]), int(s)) for r, s in zip(at, scores)]
                if len(out) >= _PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    def units(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j"))))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if held and keys[start] != last:
                        yield from solve(pa.Table.from_batches(held))
                        held = []
                    last = keys[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        if held:
            yield from solve(pa.Table.from_batches(held))

    found = work.mapInArrow(units, "anchor_id bigint, key bigint, carried bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "id"))
    return cut_lineage(found.withColumn("rank", place).filter(F.col("rank") <= need))


def mine_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows``: vec_id (bigint), label (bigint) and embedding; ``anchor`` marks anchors. Components become floor(256 x), a score is
    the whole-number inner product; higher scores come first, ties by smaller vec_id. An anchor's positives are its
    first ``positives`` other rows of the same label; for each of them the first ``negatives`` rows of other labels are
    returned whose score is at least 30 % and at most 90 % of the positive's. All, where there are fewer. So a
    negative positive score has none, and a score of zero those of zero.

    Rows with a null id, label or vector or with a null or non-finite component take no part; vectors of different
    length do not meet. Rows that repeat a vec_id count once: the least by label and vector. Scores are held to 64
    bits. Every anchor is compared with every row but by blocks: work grows with anchors times rows.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    once = valid.groupBy(F.col("vec_id").cast("bigint").alias("id")).agg(F.min(F.struct(F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("x"))).alias("r"))
    once = cut_lineage(once.select("id", "r.label", "r.x"))
    asked = once.filter(anchor)

    def window(key: Column, carried: Column, lo: Column, hi: Column) -> Column:
        return F.struct(*(c.cast("bigint").alias(n) for c, n in ((key, "key"), (carried, "carried"), (lo, "lo"), (hi, "hi"))))

    whole = F.array(window(F.lit(0), F.lit(0), F.lit(_LEAST), F.lit(_MOST)))
    first = _search(asked.withColumn("windows", whole), once, F.col("label"), positives, True)
    p = F.col("score")
    # Bounds in whole numbers, without overflow: ceil(3 p / 10) and floor(9 p / 10).
    tens, ones = F.expr("score div 10"), p % 10
    lo, hi = 3 * tens + F.ceil(3 * ones / 10), 9 * tens + F.floor(9 * ones / 10)
    windows = first.filter(p >= 0).groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(window(F.col("id"), p, lo, hi)).alias("windows"))
    found = _search(asked.join(windows, "id"), once, F.lit(0), negatives, False)
    return found.select(
        "anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("carried").alias("positive_score"), F.col("score").alias("negative_score"))
