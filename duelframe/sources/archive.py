"""CSV archives of experiment packages: discovery, loading, manifest."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import bind
from ..operators.clean import DataError, count_check
from ..session import cut_lineage

# ---- fixed values: columns of the archive, expected counts per subset -----------
RENAMED = {"clickability_test_id": "test_id", "eyecatcher_id": "image_id"}
REQUIRED_RAW = "clickability_test_id headline clicks impressions eyecatcher_id created_at".split()
SUBSETS = ("exploratory", "confirmatory", "holdout")
PUBLISHED = {
    "exploratory": (4873, 22666), "confirmatory": (22743, 105551), "holdout": (4871, 22600),
}
# ---- end of fixed values ---------------------------------------------------------


#: Bytes of a stretch whose lines share a digest.
CHUNK = 1 << 20


def discover_files(spark: SparkSession, folder: str, patterns: dict[str, str], parts: bool = False) -> dict[str, list[str]]:
    """The files of each subset that is present. Several matches are an error unless the archive comes in ``parts``."""
    found = {}
    for subset, pattern in patterns.items():
        listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
        paths = sorted(r["path"] for r in listing.collect())
        if len(paths) > 1 and not parts:
            raise DataError(f"more than one file matches {pattern!r}: {paths[:2]}")
        if paths:
            found[subset] = paths
    return found


def _ranges(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict]:
    """(file, size, block, value): every line of the files, split by Spark into byte ranges; and for each range where it begins
    and whether inside a quoted field.

    A first pass adds up bytes and quotation marks per range. Only one row for each range is summed up over a file.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    )
    marks = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(marks).alias("marks"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(
        "file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
        (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1).alias("open"),
    )
    # The tasks that follow need the lines of a range in their order, so the sums come along as one value: a few bytes for each range.
    return lines, {(r["file"], r["block"]): (r["start"], r["open"]) for r in ranges.collect()}


def _placed(batches, known):
    """(piece of a batch, whether a range begins with it, offsets of its lines, whether each begins inside quotes, whether the piece ends so)."""
    at, open_, last = 0, False, None
    for batch in batches:
        values = batch.column("value")
        sizes = np.asarray(pc.binary_length(values)) + 1
        odd = np.asarray(pc.count_substring(values, '"')) % 2
        # Neighbouring lines of one range are a run; few ranges meet in a batch.
        files, blocks = (pc.run_end_encode(batch.column(c)).run_ends.to_numpy() for c in ("file", "block"))
        cuts = [0, *np.union1d(files, blocks).tolist()] if batch.num_rows else []
        for i, j in zip(cuts, cuts[1:]):
            name = batch.column("file")[i].as_py(), batch.column("block")[i].as_py()
            fresh = name != last
            if fresh:
                (at, open_), last = known[name], name
            offsets = at + np.cumsum(sizes[i:j]) - sizes[i:j]
            turned = np.cumsum(odd[i:j])
            quoted = (turned - odd[i:j] + open_) % 2 == 1
            at, open_ = at + int(sizes[i:j].sum()), bool((turned[-1] + open_) % 2)
            yield batch.slice(i, j - i), fresh, offsets, quoted, open_


def physical_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, size, block, offset, quoted, value): every line of the files, read by many tasks.

    ``offset``: where the line begins in its file; ``quoted``: it begins inside a quoted field.
    """
    lines, known = _ranges(spark, paths)

    def placed(batches):
        for piece, _, offsets, quoted, _ in _placed(batches, known):
            yield pa.RecordBatch.from_arrays([
                piece.column("file"), piece.column("size"), piece.column("block"), pa.array(offsets), pa.array(quoted), piece.column("value"),
            ], ["file", "size", "block", "offset", "quoted", "value"])

    return lines.mapInArrow(placed, "file string, size bigint, block bigint, offset bigint, quoted boolean, value string")


def whole_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, offset, record) of files, as ``records`` of their lines, in one pass behind the first.

    A task puts the records of its byte range together as it reads. Only what crosses the border of a range, two pieces
    of a record at most, meets the pieces of the ranges beside it.
    """
    lines, known = _ranges(spark, paths)
    names = ["file", "offset", "record", "begins", "ends"]

    def rows(file, offsets, values, begins, ends):
        n = len(offsets)
        return pa.RecordBatch.from_arrays([
            pa.array([file] * n, pa.string()), pa.array(offsets, pa.int64()), values, pa.array(np.full(n, begins)), pa.array(np.full(n, ends))], names)

    def joined(batches):
        # What is left of the record that the last piece did not end: its file, offset, texts, and whether it began in this range.
        held = None

        def let_go(ends):
            return rows(held[0], [held[1]], pa.array(["\n".join(held[2])], pa.string()), held[3], ends)

        for piece, fresh, offsets, quoted, open_ in _placed(batches, known):
            file, values = piece.column("file")[0].as_py(), piece.column("value")
            if fresh and held:
                yield let_go(False)
                held = None
            starts = np.flatnonzero(~quoted)
            lead = int(starts[0]) if len(starts) else len(offsets)
            if lead:
                texts = values.slice(0, lead).to_pylist()
                held = (file, held[1], held[2] + texts, held[3]) if held else (file, int(offsets[0]), texts, False)
            if held and (len(starts) or not open_):
                yield let_go(True)
                held = None
            if not len(starts):
                continue
            if open_:
                held = (file, int(offsets[starts[-1]]), values.slice(int(starts[-1])).to_pylist(), True)
            ends = np.append(starts, len(offsets))[: len(starts) + (not open_)]
            if len(ends) > 1:
                parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.cast(pa.string()))
                yield rows(file, offsets[ends[:-1]], pc.binary_join(parts, "\n"), True, True)
        if held:
            yield let_go(False)

    found = lines.mapInArrow(joined, "file string, offset bigint, record string, begins boolean, ends boolean")
    # Stored once: the records and the few pieces of others both read it.
    found = cut_lineage(found)
    whole = found.filter("begins and ends").select("file", "offset", "record")
    # A record that no piece ends is the last of its file, and is kept as it is.
    order = Window.partitionBy("file").orderBy("offset")
    pieces = found.filter("not (begins and ends)").withColumn("k", F.sum(F.col("begins").cast("int")).over(order))
    met = pieces.groupBy("file", "k").agg(
        F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("offset", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.unionByName(cut_lineage(met.select("file", "offset", text.alias("record"))))


def records(lines: DataFrame) -> DataFrame:
    """(file, offset, record) of physical lines: quoted line breaks stay inside their record.

    A line that neither begins nor ends inside a quoted field is a record where it lies; only the lines of records with
    line breaks are brought together, by the number of record beginnings before them.
    """
    odd = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    marked = lines.withColumn("odd", odd)
    whole = marked.filter(~F.col("quoted") & ~F.col("odd")).select("file", "offset", F.col("value").alias("record"))
    parts = marked.filter(F.col("quoted") | F.col("odd"))
    # Sums of beginnings per range first, then inside ranges: no window holds a whole file.
    begins = (~F.col("quoted")).cast("int")
    totals = parts.groupBy("file", "block").agg(F.sum(begins).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("file", "block").orderBy("offset")
    numbered = parts.withColumn("k", F.sum(begins).over(inside)).join(totals, ["file", "block"])
    joined = numbered.groupBy("file", (F.col("k") + F.col("earlier")).alias("k")).agg(
        F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda v: v["value"]), "\n")
    return whole.unionByName(joined.select("file", "offset", text.alias("record")))


def _parsed(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Every record of the files as a struct ``r`` of texts, and its names."""
    ended = F.col("record").endswith("\r") | F.col("record").endswith("\n")
    bare = F.when(ended, F.regexp_replace("record", "\r$", "")).otherwise(F.col("record"))
    found = whole_records(spark, paths).withColumn("record", bare)
    heads = found.filter("offset = 0").select("record").distinct().limit(2).collect()
    if len(heads) != 1:
        raise DataError(f"{paths[0]} and the other parts have {'no header' if not heads else 'different headers'}")
    names = next(csv.reader([heads[0]["record"]]))
    rows = found.filter((F.col("offset") > 0) & (F.col("record") != ""))
    return rows.select(fields("record", names).alias("r")), names


def fields(record: str, names: Sequence[str]) -> Column:
    """The texts of a record as a struct; empty ones are null. Without quotation marks, commas alone divide it."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = lambda parts, i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    plain = bind(F.split(record, ",", -1), lambda parts: F.struct(*[text(parts, i).alias(n) for i, n in enumerate(names)]))
    quoted = F.from_csv(record, schema.toDDL(), {"quote": '"', "escape": '"'})
    return F.when(F.contains(F.col(record), F.lit('"')), quoted).otherwise(plain)


def read_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All columns as text: quoted line breaks and quotes kept, types decided later. Files of any size are read by many tasks."""
    return _opened(_parsed(spark, [paths] if isinstance(paths, str) else list(paths))[0])


def _opened(parsed: DataFrame) -> DataFrame:
    """A column for each field. As rows of one: fields taken from the struct would parse a record again for each of them."""
    return parsed.select(F.inline(F.array("r")))


def load_subset(
    spark: SparkSession, path: list[str] | str, subset: str, expected: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """One subset with checked columns and, where given, checked counts (tests, packages)."""
    parsed, names = _parsed(spark, [path] if isinstance(path, str) else list(path))
    missing = [c for c in REQUIRED_RAW if c not in names]
    if missing:
        raise DataError(f"{path} lacks {missing}; it has {sorted(names)}")
    wanted = REQUIRED_RAW + [c for c in ("problem",) if c in names]
    df = _opened(parsed).select(*wanted).withColumnsRenamed(RENAMED).withColumn("subset", F.lit(subset))
    if expected and subset in expected:
        tests, packages = expected[subset]
        wanted_counts = spark.createDataFrame(
            [(subset, tests, packages)], "subset string, tests long, packages long"
        )
        # Only the tests are counted here.
        tests_of = parsed.select(F.col("r")[{v: k for k, v in RENAMED.items()}["test_id"]].alias("test_id"), F.lit(subset).alias("subset"))
        result = count_check(tests_of, wanted_counts).first()
        if result is None or not result["matches"]:
            raise DataError(f"{path} does not have the expected counts: {result}")
    return df


def load_all(
    spark: SparkSession, files: dict[str, list[str]], expected: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    if not files:
        raise DataError("no archive file found")
    parts = [load_subset(spark, p, s, expected) for s, p in sorted(files.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_digests(lines: DataFrame) -> DataFrame:
    """(file, bytes, digest): a digest tree over the lines of each file, whatever ranges they were read in.

    SHA-256 of each line, of the lines' digests of each stretch of CHUNK bytes, and of those in order after the file's
    size. A line belongs to the stretch in which it begins.
    """
    def joined(column: str, order: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(order, column)))
        return F.sha2(F.array_join(F.transform(listed, lambda v: v[column]), "").cast("binary"), 256)

    hashed = lines.select("file", "size", "offset", F.sha2(F.col("value").cast("binary"), 256).alias("line"))
    chunks = hashed.groupBy("file", "size", F.floor(F.col("offset") / CHUNK).alias("chunk")).agg(joined("line", "offset").alias("part"))
    files = chunks.groupBy("file", "size").agg(joined("part", "chunk").alias("all"))
    return files.select("file", F.col("size").alias("bytes"), F.sha2(F.concat(F.col("size").cast("string"), F.lit(":"), "all").cast("binary"), 256).alias("digest"))


def manifest(spark: SparkSession, files: dict[str, list[str]], expected: dict[str, tuple[int, int]] = PUBLISHED) -> DataFrame:
    """Per subset: files, bytes, a digest over its files in order of their names, and records against the expected packages."""
    parts = None
    for subset, paths in sorted(files.items()):
        lines = cut_lineage(physical_lines(spark, [paths] if isinstance(paths, str) else paths))
        digests = file_digests(lines)
        listed = F.array_sort(F.collect_list(F.struct("file", "digest")))
        content = digests.agg(
            F.count(F.lit(1)).alias("n_files"), F.sum("bytes").cast("long").alias("bytes"),
            F.sha2(F.array_join(F.transform(listed, lambda v: v["digest"]), "").cast("binary"), 256).alias("digest"))
        rows = records(lines).filter((F.col("offset") > 0) & (F.regexp_replace("record", "\r$", "") != "")).agg(F.count(F.lit(1)).alias("data_rows"))
        wanted = F.lit(expected.get(subset, (None, None))[1]).cast("long")
        tag = lambda df: df.withColumn("subset", F.lit(subset))
        part = tag(content).join(tag(rows), "subset").withColumn("expected_packages", wanted)
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("rows_match", F.col("data_rows") == F.col("expected_packages"))
