"""Merkle manifest of a table: levels stored as parent-linked nodes, proofs folded by a recursive query."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage, shared_folder

#: Nodes that become one.
ARITY = 16
#: Leaves whose climbers meet one copy of a node; nodes above more leaves are stored once for each such stretch.
STRETCH = 4096
#: The tree above the groups' own trees.
TOP = -1
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest_of(text: Column) -> Column:
    """SHA-256 of a text or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(digests: Column) -> Column:
    """Lower-case hex of one or more digests in a row."""
    return F.lower(F.hex(digests))


def leaf_text(fields: list[Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and its value; a null field as a dash."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx`` (from 0 inside each group), ``pos`` (from 0 over all), ``n`` (the group's size) and ``tree`` (the group's number).

    Groups and rows ascend, nulls first. Rows are cut into ranges; each task numbers its own range, and only
    the sizes of (range, group) are summed over ranges, so that a group of any size spreads. ``order`` must tell
    all rows apart that may be many.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = cut_lineage(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", group).orderBy(*keys[1:])
    ranged = cut_lineage(ranged.withColumn("rn", F.row_number().over(within).cast("bigint") - 1))
    sizes = cut_lineage(ranged.groupBy("part", group).agg(F.count(F.lit(1)).alias("k")))
    parts = sizes.groupBy("part").agg(F.sum("k").alias("k"))
    # One row for each range.
    parts = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col(group).asc_nulls_first())
    every = Window.partitionBy(group)
    sizes = sizes.join(parts, "part").select(
        "part", group,
        (F.col("before") + F.sum("k").over(inside) - F.col("k")).alias("_from"),
        (F.sum("k").over(every.orderBy("part")) - F.col("k")).alias("base"),
        F.sum("k").over(every).alias("n"),
    )
    # A group begins where its first rows lie; the number of beginnings up to there is its own.
    heads = sizes.filter("base = 0").groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    heads = heads.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("trees"))
    trees = sizes.filter("base = 0").join(heads, "part").select(
        F.col(group).alias("_named"), (F.col("trees") + F.row_number().over(inside) - 1).alias("tree"))
    sizes = sizes.join(trees, F.col(group).eqNullSafe(F.col("_named")))
    sizes = cut_lineage(sizes.select(F.col("part").alias("_part"), F.col(group).alias("_group"), "_from", "base", "n", "tree"))
    placed = ranged.join(sizes, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.select(
        *rows.columns, (F.col("base") + F.col("rn")).alias("idx"), (F.col("_from") + F.col("rn")).alias("pos"), "n", "tree")


@dataclass(frozen=True)
class Manifest:
    """Folders of a stored manifest and the number of trees.

    runs: tree, idx, n (leaves of the tree), lo, hi, kids, digest, leaves (up to ARITY leaves with what each carries).
    nodes: tree, level, idx, stretch (the key), digest, kids (digests of the children in a row), and the parent's
    p_tree, p_level, p_idx with the node's place among its children; no parent: the root.
    """

    runs: str
    nodes: str
    trees: int


def _linked(level: DataFrame, trees: int) -> DataFrame:
    """The parent of each node; ``n``: nodes of its tree at its level."""
    alone = F.col("n") == 1
    top = alone & (F.col("tree") != TOP)
    last = alone & ((F.col("tree") == TOP) | F.lit(trees == 1))
    number = F.when(top, F.col("tree")).otherwise(F.col("idx"))

    def unless_last(value: Column) -> Column:
        return F.when(~last, value)

    return level.select(
        "*",
        unless_last(F.when(top, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint")).alias("p_tree"),
        unless_last(F.when(top, F.lit(1)).otherwise(F.col("level") + 1)).alias("p_level"),
        unless_last(F.floor(number / ARITY)).alias("p_idx"),
        (number % ARITY).cast("int").alias("place"),
    )


def _joined(level: DataFrame, number: int) -> DataFrame:
    """The next level: each run of ARITY consecutive nodes becomes one."""
    parts = F.sort_array(F.collect_list(F.struct("idx", "digest")))
    runs = level.groupBy("tree", F.floor(F.col("idx") / ARITY).alias("up")).agg(
        F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), parts.alias("kids"))
    kids = F.aggregate("kids", F.lit(b""), lambda got, k: F.concat(got, k["digest"]))
    return runs.select(
        "tree", F.lit(number).alias("level"), F.col("up").alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"), "lo", "hi",
        kids.alias("kids"),
    ).withColumn("digest", digest_of(hex_of(F.col("kids"))))


def store_manifest(leaves: DataFrame, group: str, order: list[str], carry: list[str]) -> Manifest:
    """Builds the trees of ``leaves`` (column ``leaf``: 32 bytes) in the shared folder.

    In each group, leaves ascend by ``order``; while a tree has several nodes, every ARITY consecutive ones (the last
    run: fewer, even one) become the digest of their hex texts. The groups' last nodes, ordered by group with null
    first, form the top tree in the same way. ``carry`` are the columns that each leaf keeps beside it.
    """
    spark, folder = leaves.sparkSession, shared_folder(leaves.sparkSession, "manifest")
    placed = numbered(leaves.select(*dict.fromkeys([group, *order, "leaf", *carry])), group, order)
    parts = F.sort_array(F.collect_list(F.struct("idx", *dict.fromkeys(["leaf", *carry]))))
    runs = placed.groupBy("tree", F.floor(F.col("idx") / ARITY).alias("up")).agg(
        F.max("n").alias("n"), F.floor(F.min("pos") / STRETCH).alias("lo"), parts.alias("leaves"))
    kids = F.aggregate("leaves", F.lit(b""), lambda got, k: F.concat(got, k["leaf"]))
    runs = runs.select("tree", F.col("up").alias("idx"), "n", "lo", F.col("lo").alias("hi"), kids.alias("kids"), "leaves")
    # A lone leaf is its tree's last node itself.
    runs = runs.withColumn("digest", F.when(F.col("n") == 1, F.col("kids")).otherwise(digest_of(hex_of(F.col("kids")))))
    runs.write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    first = runs.select("tree", F.lit(1).alias("level"), "idx", F.ceil(F.col("n") / ARITY).alias("n"), "lo", "hi", "digest", "kids")

    def levels(level: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
        """All levels from this one on, and the last node of each tree."""
        all_levels = [level]
        number = 1
        while not level.filter("n > 1").isEmpty():
            number += 1
            path = f"{folder}/levels/{name}-{number}"
            _joined(level.filter("n > 1"), number).write.parquet(path)
            level = spark.read.parquet(path)
            all_levels.append(level)
        tops = all_levels[0].filter("n = 1")
        for more in all_levels[1:]:
            tops = tops.unionByName(more.filter("n = 1"), allowMissingColumns=True)
        return all_levels, tops

    own, tops = levels(first, "own")
    trees = runs.filter("idx = 0").count()
    stored = own
    if trees > 1:
        base = tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("bigint").alias("n"), "lo", "hi", "digest")
        path = f"{folder}/levels/top-1"
        _joined(base, 1).write.parquet(path)
        stored = own + levels(spark.read.parquet(path), "top")[0]
    nodes = None
    for level in stored:
        level = level.select("tree", "level", "idx", F.col("n").cast("bigint").alias("n"), "lo", "hi", "digest", "kids")
        nodes = level if nodes is None else nodes.unionByName(level)
    nodes = _linked(nodes, trees).withColumn("stretch", F.explode(F.sequence("lo", "hi"))).drop("n", "lo", "hi")
    nodes.write.parquet(f"{folder}/nodes")
    return Manifest(f"{folder}/runs", f"{folder}/nodes", trees)


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


#: A climber stands at a node (tree, level, idx); it has folded the digests of its leaves up to there.
_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT run_tree, run, stretch, leaves, folded, siblings, subroot, digest, p_tree, p_level, p_idx, place FROM {start}
  UNION ALL
  SELECT c.run_tree, c.run, c.stretch, c.leaves,
    transform(c.folded, f -> unhex(sha2(lower(concat(
      hex(substring(n.kids, 1, 32 * c.place)), hex(f), hex(substring(n.kids, 32 * c.place + 33)))), 256))),
    concat(c.siblings, substring(n.kids, 1, 32 * c.place), substring(n.kids, 32 * c.place + 33)),
    coalesce(c.subroot, CASE WHEN n.p_tree IS NULL OR n.p_tree <> n.tree THEN n.digest END),
    n.digest, n.p_tree, n.p_level, n.p_idx, n.place
  FROM climb c JOIN {nodes} n
    ON c.p_tree = n.tree AND c.p_level = n.level AND c.p_idx = n.idx AND c.stretch = n.stretch
)
SELECT leaves, folded, siblings, subroot, digest AS root FROM climb WHERE p_tree IS NULL
"""


def climb(manifest: Manifest, spark: SparkSession, start: str) -> DataFrame:
    """For each leaf what it carries, with subroot, root, proof and folded: the root that the digest ``start`` leads to.

    ``start`` is a carried column of 32 bytes. A recursive query ascends from the leaves: each step joins climbers with
    their parents, appends the siblings and folds the digests. The leaves of one run (at most ARITY) share all
    siblings above it and ascend in one row, each with a digest of its own. Climbers of one stretch meet a node's
    own copy for it, so that no node, not even the root, is one key for all. The proof is the hex of the
    siblings, level by level, left to right.
    """
    runs, nodes = spark.read.parquet(manifest.runs), spark.read.parquet(manifest.nodes)
    first = nodes.filter((F.col("level") == 1) & (F.col("tree") != TOP)).drop("kids", "level", "digest")

    def folded(leaf: Column, i: Column) -> Column:
        left, right = F.substring("kids", F.lit(1), 32 * i), F.substring("kids", 32 * i + 33, F.lit(32 * ARITY))
        return F.when(F.col("n") == 1, leaf[start]).otherwise(
            digest_of(F.concat(hex_of(left), hex_of(leaf[start]), hex_of(right))))

    alone = F.col("p_tree").isNull() | (F.col("p_tree") != F.col("tree"))
    begin = runs.join(first, ["tree", "idx"]).select(
        F.col("tree").alias("run_tree"), F.col("idx").alias("run"), "stretch", "leaves", F.transform("leaves", folded).alias("folded"),
        F.lit(b"").alias("siblings"), F.when(alone, F.col("digest")).alias("subroot"), "digest", "p_tree", "p_level", "p_idx", "place",
    )
    path = f"{shared_folder(spark, 'climb')}"
    with _any_number_of_rows(spark):
        spark.sql(_CLIMB, start=begin, nodes=nodes.filter((F.col("level") > 1) | (F.col("tree") == TOP))).write.parquet(path)
    ended = spark.read.parquet(path)
    ended = ended.select("siblings", "subroot", "root", "leaves", F.posexplode(F.arrays_zip("leaves", "folded")).alias("i", "own"))
    beside = F.aggregate(F.filter("leaves", lambda leaf, i: i != F.col("i")), F.lit(b""), lambda got, k: F.concat(got, k["leaf"]))
    return ended.select("own.leaves.*", "subroot", "root", hex_of(F.concat(beside, F.col("siblings"))).alias("proof"), F.col("own.folded").alias("folded"))


def verify_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of doc_id, source, lang, n_chars, text.

    The manifest is that of the rows as they are. Where ``tampered`` holds, the leaf whose hash is folded along the
    stored siblings has the text's A-Z in lower case; verified says whether the fold gives the root. Nulls are
    fields of their own kind; null ids and null sources come first; empty texts are no nulls. Rows that repeat a
    doc_id are leaves of their own, ordered by their hash. An empty table gives no rows.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    leaves = docs.select(
        F.col("source"), F.col("doc_id"), digest_of(leaf_text([*fields, F.col("text")])).alias("leaf"),
        F.when(tampered, digest_of(leaf_text([*fields, lowered]))).alias("start"),
    ).withColumn("start", F.coalesce("start", "leaf")).withColumn("row", F.monotonically_increasing_id())
    # The order of equal rows is what was stored.
    leaves = cut_lineage(leaves)
    climbed = climb(store_manifest(leaves, "source", ["doc_id", "leaf", "row"], ["doc_id", "leaf", "start"]), docs.sparkSession, "start")
    return climbed.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"),
        F.col("folded").eqNullSafe(F.col("root")).alias("verified"),
    )
