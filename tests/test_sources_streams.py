"""Files in and out, and real streams against their batch twins."""

import csv
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from duelframe.functions.lexicons import DEFAULT_LEXICONS
from duelframe.operators import drift, ranking
from duelframe.operators.clean import DataError, build_arms
from duelframe.operators.scoring import HAND_MODEL
from duelframe.sources import archive, resources, sinks, tables
from duelframe.streaming import activity_streams as S

SF_DIR = "/root/testdata/sf0.001"
HEADER = "clickability_test_id,headline,clicks,impressions,eyecatcher_id,created_at,lede\n"


def _csv(folder, name, rows=2, header=HEADER):
    body = "".join(
        f't{i},"Say ""hi"", reader {i}",5,200,img,2014-11-20 06:43:16{".005" if i % 2 else ""},"<p>two\nlines</p>"\n' for i in range(rows)
    )
    path = folder / name
    path.write_text(header + body)
    return str(path)


def test_archive(spark, tmp_path):
    path = _csv(tmp_path, "a-exploratory-1.csv")
    patterns = {"exploratory": "a-exploratory-*.csv", "holdout": "a-holdout-*.csv"}
    files = archive.discover_files(spark, str(tmp_path), patterns)
    assert set(files) == {"exploratory"}
    df = archive.load_all(spark, files, {"exploratory": (2, 2)})
    assert sorted(r["headline"] for r in df.collect()) == ['Say "hi", reader 0', 'Say "hi", reader 1']
    assert build_arms(df).count() == 2
    found = archive.manifest(spark, files, {"exploratory": (2, 2)}).first()
    assert found["data_rows"] == 2 and found["rows_match"] and len(found["digest"]) == 64 and found["n_files"] == 1
    with pytest.raises(DataError):
        archive.load_subset(spark, path, "exploratory", {"exploratory": (3, 2)})
    _csv(tmp_path, "a-exploratory-2.csv")
    with pytest.raises(DataError):
        archive.discover_files(spark, str(tmp_path), patterns)
    with pytest.raises(DataError):
        archive.load_subset(spark, _csv(tmp_path, "b.csv", 1, HEADER.replace("clicks", "hits")), "x")
    with pytest.raises(DataError):
        archive.load_all(spark, {})


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of a few bytes, so that records and quoted line breaks lie across them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_ranges_equals_csv_module(spark, tmp_path, small_ranges, end):
    rng, parts = random.Random(len(end)), []
    pieces = ["a", "é漢", '"', ",", "\n", " ", "word word", "\n\n", '""']
    for k in range(3):
        rows = [["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(3)] for _ in range(25)]
        path = tmp_path / f"part-{k}.csv"
        with open(path, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["x", "y", "z"])
            # A filled last field: a row of empty fields is a blank record.
            writer.writerows([r[:2] + [f"{i}{r[2]}"] for i, r in enumerate(rows)])
        with open(path, newline="", encoding="utf-8") as given:
            parts += list(csv.reader(given))[1:]
    paths = [str(tmp_path / f"part-{k}.csv") for k in range(3)]
    lines = archive.physical_lines(spark, paths)
    assert lines.select("block").distinct().count() > 10
    got = sorted([v or "" for v in r] for r in archive.read_csv(spark, paths).collect())
    assert got == sorted(parts)


def test_records_are_joined_in_the_tasks_that_read_them(spark, tmp_path, small_ranges):
    path = tmp_path / "part-0.csv"
    path.write_text('x,y\n1,"a\n' + "long line\n" * 30 + 'end"\n2,"b\n\nc"\n3,d\n4,"open\nto the end\n')
    lines = archive.physical_lines(spark, [str(path)])
    as_rows = lambda df: sorted((r["offset"], r["record"]) for r in df.collect())
    met = archive.whole_records(spark, [str(path)])
    assert as_rows(met) == as_rows(archive.records(lines)) and met.count() == 5


def test_a_record_is_parsed_once_and_without_quotes_only_divided(spark, tmp_path):
    names, texts = ["x", "y", "z"], ["1,2,3", ",,", " a , ,b ", "1", "1,2,3,4,5", "a\rb,c", "#1,2,3", "é,漢,", '"a,b",2,3', 'a"b,2,3', '"a\n""b""",,""']
    rows = spark.createDataFrame([(t,) for t in texts], "record string")
    plain = F.from_csv("record", "x string, y string, z string", {"quote": '"', "escape": '"'})
    got = rows.select(archive.fields("record", names).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    df = archive.load_subset(spark, _csv(tmp_path, "a.csv"), "exploratory")
    plan = build_arms(df)._jdf.queryExecution().optimizedPlan().toString()
    # Whole records and those put together from pieces: one parse each.
    assert plan.count("from_csv") <= 2


def test_digest_is_that_of_the_bytes_not_of_the_ranges(spark, tmp_path, small_ranges):
    path = _csv(tmp_path, "one.csv", 30)
    few = archive.file_digests(archive.physical_lines(spark, [path])).first()["digest"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    assert archive.file_digests(archive.physical_lines(spark, [path])).first()["digest"] == few
    lines = open(path, "rb").read().split(b"\n")[:-1]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    part = sha("".join(map(sha, lines)).encode())
    size = sum(map(len, lines)) + len(lines)
    assert few == sha(f"{size}:{sha(part.encode())}".encode())
    data = bytearray(open(path, "rb").read())
    data[-2] ^= 1
    open(path, "wb").write(data)
    assert archive.file_digests(archive.physical_lines(spark, [path])).first()["digest"] != few


def test_parts_must_have_one_header(spark, tmp_path):
    paths = [_csv(tmp_path, "a.csv"), _csv(tmp_path, "b.csv", 2, HEADER.replace("lede", "other"))]
    with pytest.raises(DataError):
        archive.read_csv(spark, paths)


def test_resources(spark, tmp_path):
    assert resources.load_lexicons(resources.lexicon_frame(spark, DEFAULT_LEXICONS)) == DEFAULT_LEXICONS
    resources.write_model(spark, HAND_MODEL, str(tmp_path / "m"))
    assert resources.read_model(spark, str(tmp_path / "m")) == HAND_MODEL
    (tmp_path / "bad.json").write_text(json.dumps({"version": "v"}))
    with pytest.raises(ValueError):
        resources.read_model(spark, str(tmp_path / "bad.json"))
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"text": "a", "why": "b"}]}))
    assert resources.read_corpus(spark, str(tmp_path / "c.json")).first().asDict() == {"text": "a", "why": "b"}


def test_rankings_are_saved(spark, tmp_path):
    lines = tables.lines(spark, SF_DIR).drop("doc_id").filter("ranking_id < 3000000")
    ranked = ranking.rank_line_sets(lines).select("ranking_id", "position", "text", "rank", "score", "pairwise")
    sinks.save_rankings(sinks.with_feature_maps(ranked), str(tmp_path), "hand-1", 1)
    items, saved = (spark.read.parquet(str(tmp_path / t)) for t in ("ranking_items", "rankings"))
    assert saved.agg(F.sum("n_lines")).first()[0] == items.count() > 0
    assert len(items.first()["features"]) == 52
    sinks.append_rows(saved, str(tmp_path), "log")
    sinks.append_rows(saved, str(tmp_path), "log")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * saved.count()
    sinks.write_report({"rankings": saved}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "rankings")).count() == saved.count()


@pytest.fixture(scope="module")
def event_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events") / "in")
    tables.activity(spark, SF_DIR).coalesce(1).write.parquet(folder)
    return folder


def _stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def _drain(df, tmp_path, mode="append", name="out", each=None):
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
    writer = writer.foreachBatch(each) if each else writer.format("memory").queryName(name)
    query = writer.start()
    query.awaitTermination()


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_windows_match_the_batch(spark, event_folder, tmp_path):
    batch = spark.read.parquet(event_folder)
    last = batch.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    for name, fn in (("rates", S.rate_counts), ("funnel", S.funnel_counts), ("sessions", S.sessions)):
        _drain(fn(_stream(spark, event_folder)), tmp_path, name=name)
        got, want = _rows(spark.table(name)), _rows(fn(batch))
        assert got <= want, name
        # Only windows that the watermark has not closed yet may be missing.
        open_rows = want - got
        assert len(open_rows) < 0.05 * len(want)
        at = 1 if name == "sessions" else 0
        assert all((last - r[at]).total_seconds() < 90000 for r in open_rows)


def test_live_users_and_dedup(spark, event_folder, tmp_path):
    batch = spark.read.parquet(event_folder)
    _drain(S.live_users(_stream(spark, event_folder)), tmp_path, "complete", "users")
    assert _rows(spark.table("users")) == _rows(S.live_users(batch))
    doubled = _stream(spark, event_folder).union(_stream(spark, event_folder))
    _drain(S.known_once(doubled), tmp_path, name="once")
    assert spark.table("once").count() == batch.count()


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "late")
    for i, ts in enumerate(
        # Late rows are judged by the watermark of the batch before the current one.
        ["2024-01-01 00:00:00", "2024-01-03 00:00:00", "2024-01-03 00:00:01", "2024-01-01 00:00:05"]
    ):
        spark.createDataFrame([(i, ts)], "event_id long, t string").select(
            "event_id", F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("landed").alias("name")
        ).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    _drain(S.funnel_counts(stream, "1 hour"), tmp_path, name="late")
    assert [r["n"] for r in spark.table("late").collect()] == [1]


def test_exact_rate_limit(spark, tmp_path):
    folder = str(tmp_path / "burst")
    spark.range(50).select(
        F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id")).alias("ts"),
    ).coalesce(1).write.parquet(folder)
    spark.range(50, 120).select(
        F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id")).alias("ts"),
    ).coalesce(1).write.mode("append").parquet(folder)
    _drain(S.exact_rate_limit(_stream(spark, folder)), tmp_path, name="limited")
    allowed = sorted(r["event_id"] for r in spark.table("limited").filter("allowed").collect())
    # Thirty pass, the rest waits until the first ones leave the window of sixty seconds.
    assert allowed == [*range(30), *range(60, 90)]


def test_drift_runs_are_appended(spark, event_folder, tmp_path):
    train = spark.read.parquet(event_folder).select("value")
    live = _stream(spark, event_folder).select("value", F.to_date("ts").alias("day"))
    out = str(tmp_path / "runs")
    _drain(live, tmp_path, name="drift", each=S.drift_writer(train, "day", out))
    saved = spark.read.parquet(out)
    batch = spark.read.parquet(event_folder).select("value", F.to_date("ts").alias("day"))
    assert saved.count() == drift.windowed_psi(train, batch, "day").count()
