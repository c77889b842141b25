"""Records with long heads, and archives that lack a record."""

import io

import pytest
from pyspark.sql import functions as F

from duelframe.llm import warc as W

LONG_URL = "http://a.com/" + "x" * (1 << 20)


def test_plain_record_with_long_head():
    record = W.record_bytes(1, LONG_URL, b"text", b"sha1:A", None, False, 4)
    found = list(W.salvage(io.BytesIO(record + record)))
    assert [(x.headers["warc-target-uri"], x.payload) for x in found] == [(LONG_URL, b"text")] * 2
    found = list(W.salvage(io.BytesIO(b"WARC/1.1\r\nno colon\r\n" + b"y" * 300000)))
    assert [(x.start, x.reason) for x in found] == [(0, "header line without colon")]


def test_round_trip_with_long_url(spark):
    rows = [(1, "http://b.com", "z" * 2000), (2, LONG_URL, "z" * 2000), (3, LONG_URL, None)]
    back = W.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in back) == [
        (1, 2000, "revisit", 2), (2, 2000, "response", None), (3, 0, "response", None)]


def test_missing_records_are_an_error(spark, tmp_path):
    rows = [(1, "http://b.com", "z")]
    archives = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}")
    assert W.read_archives(archives, whole=True).count() == 1
    with pytest.raises(Exception, match="1 records were read, 2 were written"):
        W.read_archives(archives.withColumn("records", F.col("records") + 1), whole=True).collect()
