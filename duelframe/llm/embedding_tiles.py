"""Near copies among embeddings: tiles of PCA-ordered vectors, compared by leading dimensions first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage
from duelframe.llm.components import Forest, components

#: Vectors of one tile; a task compares two tiles.
TILE = 2048
#: Pairs whose further dimensions are gathered at once.
_PAIRS = 1 << 15


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length as a matrix of doubles, each times a power of two that brings its largest magnitude near 1.

    Cosines stay as they are, and squares neither overflow nor vanish.
    """
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    _, exponents = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -exponents[:, None])


def principal_axes(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Length and axes (columns, by falling spread) of the second moments of all unit vectors of the commonest length.

    Tasks add up squares and products; the driver gets length x length sums, whatever the number of rows.
    """
    common = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return 0, np.zeros((0, 0))
    d = common["d"]

    def sums(batches):
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())], ["i", "j", "v"])

    rows = vectors.filter(F.size("x") == d).select("x").mapInArrow(sums, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    moments = np.zeros((d, d))
    moments[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    _, axes = np.linalg.eigh(moments)
    return d, axes[:, ::-1].copy()


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i of x, j of y; i < j if ``same``) with cosine >= ``least``.

    Products of the leading dimensions are summed block by block; the rest of a product is at most the product
    of the two suffix norms, so that a pair ends as soon as sum and bound stay below ``least``. What is left
    is decided by the cosine of the given vectors in double precision.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    d = u.shape[1]
    cuts = [c for c in (8, 16, 32, 64, 128, 256, 512, 1024, 2048) if c < d] + [d]
    slack = 1e-9

    def rest(w, c):
        return np.sqrt(np.maximum((w[:, c:] ** 2).sum(1), 0))

    first = u[:, :cuts[0]] @ v[:, :cuts[0]].T
    alive = first + rest(u, cuts[0])[:, None] * rest(v, cuts[0])[None, :] >= least - slack
    if same:
        alive = np.triu(alive, 1)
    tails = [(a, b, rest(u, b), rest(v, b)) for a, b in zip(cuts, cuts[1:])]
    all_i, all_j = np.nonzero(alive)
    for s in range(0, len(all_i), _PAIRS):
        i, j = all_i[s:s + _PAIRS], all_j[s:s + _PAIRS]
        got = first[i, j]
        for a, b, ru, rv in tails:
            got = got + np.einsum("ij,ij->i", u[i, a:b], v[j, a:b])
            near = got + ru[i] * rv[j] >= least - slack
            i, j, got = i[near], j[near], got[near]
        exact = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= least
        if exact.any():
            yield i[exact], j[exact]


def link_embeddings(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vec_id, embedding, label.

    Rows link when their labels are equal and not null and their cosine is at least ``least``. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors of different
    length. Repeated vectors are one class: its rows link with each other, and only classes are compared. Null
    ids take part, but are nobody's smallest id. Repeated rows stay and count as other vectors.

    Two unit vectors with that cosine are at most r = sqrt(2 - 2 ``least``) apart, so that on the first two
    axes they lie in equal or neighbouring cells of width r. Cells are cut by hash into tiles of about TILE
    vectors; each pair of neighbouring tiles is one unit of work. Units emit sums of links and a spanning
    forest, not pairs. Where the first two axes spread vectors little, all tiles of a label meet.
    """
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", "label", x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = cut_lineage(
        rows.filter("valid").groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    d, axes = principal_axes(classes)
    width = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-6

    def place(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("x").to_pylist()])
            cell = np.zeros((batch.num_rows, 2), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = _matrix(batch.column("x").take(pa.array(at)))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                lead = (v @ axes if size == d else v)[:, :2]
                cell[at, :lead.shape[1]] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[:, 0]), pa.array(cell[:, 1])], [*batch.schema.names, "g1", "g2"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("cid", "n", "label", "x").mapInArrow(place, f"cid bigint, n bigint, label {kind}, x array<double>, g1 bigint, g2 bigint")
    placed = cut_lineage(placed.withColumn("d", F.size("x")))
    at = ["label", "d", "g1", "g2"]
    cells = cut_lineage(placed.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    ahead = cells.select(*at, "tiles", F.explode(steps).alias("s")).select(
        "label", "d", F.col("g1").alias("f1"), F.col("g2").alias("f2"), F.col("tiles").alias("mine"),
        (F.col("g1") + F.col("s.a")).alias("g1"), (F.col("g2") + F.col("s.b")).alias("g2"))
    units = ahead.join(cells, at).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)))
    own = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    units = units.withColumn("j", F.explode(F.sequence(F.when(own, F.col("i")).otherwise(0), F.col("tiles") - 1)))
    units = cut_lineage(units.select(*at, "f1", "f2", "i", "j", F.monotonically_increasing_id().alias("unit")))
    tiled = placed.join(cells, at).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    near = units.select("label", "d", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("i").alias("tile"), "unit", F.lit(0).alias("side"))
    far = units.filter(~(own & (F.col("i") == F.col("j")))).select(*at, F.col("j").alias("tile"), "unit", F.lit(1).alias("side"))
    work = tiled.join(near.unionByName(far), [*at, "tile"]).select("unit", "side", "cid", "n", "x")
    work = work.repartition("unit").sortWithinPartitions("unit", "side", "cid")

    def compare(unit: pa.Table) -> pa.RecordBatch | None:
        side, cid = unit["side"].to_numpy(), unit["cid"].to_numpy()
        n, v = unit["n"].to_numpy(), _matrix(unit["x"].combine_chunks())
        m = int((side == 0).sum())
        same = m == len(side)
        turn = axes if v.shape[1] == d else np.eye(v.shape[1])
        shift = 0 if same else m
        forest, links = Forest(len(cid)), np.zeros(len(cid), np.int64)
        for i, j in close_pairs(v[:m], v[shift:], turn, least, same):
            j = j + shift
            links += np.bincount(i, n[j], len(cid)).astype(np.int64) + np.bincount(j, n[i], len(cid)).astype(np.int64)
            forest.add(i, j)
        linked = np.flatnonzero(links)
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([pa.array(cid[linked]), pa.array(cid[forest.root[linked]]), pa.array(links[linked])], ["a", "b", "links"])

    def units_of(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            out = compare(pa.Table.from_batches(held))
            held.clear()
            return out

        for batch in batches:
            unit = batch.column("unit").to_numpy()
            for part in np.split(np.arange(len(unit)), np.flatnonzero(np.diff(unit)) + 1):
                if not len(part):
                    continue
                if held and unit[part[0]] != last:
                    out = done()
                    if out is not None:
                        yield out
                last = unit[part[0]]
                held.append(batch.slice(int(part[0]), len(part)))
        if held:
            out = done()
            if out is not None:
                yield out

    found = cut_lineage(work.mapInArrow(units_of, "a bigint, b bigint, links bigint"))
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.select("cid", "label", "x", "least", "n").join(links, "cid", "left").join(roots, "cid", "left")
    known = cut_lineage(known.select("label", "x", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(known.join(smallest, "root").select("label", "x", "n_links", "component_id"))
    linked = rows.filter("valid").join(named, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
