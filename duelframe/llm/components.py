"""Connected components: a forest within a task, stars over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage


class Forest:
    """Components of the numbers 0..n-1 under links that come in arrays; each points to its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further

    def grow(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Adds the links and tells which of them joined two components: a spanning forest of what is new."""
        used, at = np.zeros(len(u), bool), np.arange(len(u))
        while True:
            a, b = self.root[u[at]], self.root[v[at]]
            at, a, b = at[a != b], a[a != b], b[a != b]
            if not len(at):
                return used
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            taken = order[np.concatenate([[True], np.diff(high[order]) > 0])]
            used[at[taken]] = True
            self.root[high[taken]] = low[taken]
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternates large stars (every larger neighbour goes to the smallest one) and small stars (every smaller
    neighbour does) until nothing changes: a logarithmic number of rounds in practice. Minima are combined
    before they are shuffled and stored, so that the join of a node with very many neighbours is one that
    adaptive execution may split. Null ends and loops are left out.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.*").filter(F.col("u") != F.col("v")).distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
