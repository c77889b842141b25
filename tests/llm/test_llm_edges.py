"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from duelframe.llm import queries as Q
from duelframe.llm.byte_bpe import decode, encode
from duelframe.llm.embedding_tiles import link_embeddings
from duelframe.llm.line_dedup import dedup_lines
from duelframe.llm.simhash_trie import drop_near_copies, simhash_components
from duelframe.llm.spaced_seeds import clean_documents, find_overlaps
from duelframe.llm.url_rules import judge_urls
from duelframe.llm.warc import archive_round_trip

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30000))
RUN = "\n".join(" ".join(f"p{j}w{i}" for i in range(14)) for j in range(6))
TEXTS = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (3, "   \n\n\t", "en", "s", 6), (4, LONG, "en", "s", len(LONG)),
    (5, "one", "en", "s", 3), (5, "one", "en", "s", 3), (6, RUN + "\nfirst tail", "en", "s", 1), (7, "head\n" + RUN, "en", "s", 1),
    (None, "no id but text é 漢字 😀", None, "s", 5), (None, None, None, None, None), (8, "x" * 200000, "en", "s", -3), (9, "a\r\nb\x00c", "en", "", 6),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "score double, runs int, rid string, data string, row int, _fp string, _key int, label int, predicted int, ids int, removed int, batch int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOCS)


@pytest.fixture(scope="module")
def wide(spark):
    values = (0.5, 1, "r", "d", 2, "f", 3, 4, 5, 6, 7, 8)
    return spark.createDataFrame([(*t, *values) for t in TEXTS], f"{DOCS}, {EXTRA}")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of odd tables and one of empty tables."""
    odd, none = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("none")
    data = {
        "documents": (TEXTS, DOCS),
        "labels": ([(1, 1, 0), (4, 1, 1), (5, 1, 0), (5, 1, None), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, None), (2, ""), (3, RUN.split("\n")[2]), (None, RUN.split("\n")[2]), (4, "a b c")], "item_id long, text string"),
        "pages": ([(1, None, None), (2, "http://a.com/x", ""), (None, "no scheme", "é" * 600), (3, "https://WWW.Example.com/en/q?x", "é" * 600), (3, "https://WWW.Example.com/en/q?x", "é" * 600), (4, "://", "y" * 5000000)], "page_id long, url string, html string"),
        "embeddings": ([(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [1.0, float("inf")], 1), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.01], 2), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.001], 1)], "vec_id long, embedding array<float>, label int"),
        "conversations": ([], "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{odd}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{none}/{name}.parquet")
    return str(odd), str(none)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_odd_tables(spark, tables, name):
    rows = Q.QUERIES[name](spark, tables[0]).collect()
    whole = {"op4": 6, "op7": 6, "op9": 13, "op6": None}.get(name.split("_")[0], len(TEXTS))
    if whole is not None:
        assert len(rows) == whole


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, tables, name):
    assert Q.QUERIES[name](spark, tables[1]).collect() == []


@pytest.mark.parametrize("at", [0, 1])
def test_pipeline_runs(spark, tables, at):
    rows = pipeline.run(spark, tables[at]).collect()
    assert all(r.round_trip for r in rows)
    assert bool(rows) == (at == 0)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_keep_other_columns(spark, wide, tables, name, stage):
    out = stage(spark, wide, tables[0])
    given = [c for c in wide.columns if not (name == "byte_bpe" and c == "ids")]
    assert out.columns[:len(given)] == given
    assert {r.score for r in out.collect()} <= {0.5}


def test_line_dedup_cases(docs):
    rows = {(r.doc_id, r.text): r for r in dedup_lines(docs).collect()}
    assert rows[(7, "head")].removed[0][:2] == (1, 6)
    assert (6, RUN + "\nfirst tail") in rows and (2, None) in rows and (1, "") in rows
    assert sum(1 for r in dedup_lines(docs).collect()) == len(TEXTS)


def test_near_copies_keep_one(docs):
    kept = drop_near_copies(docs).collect()
    assert sum(r.text == "one" for r in kept) == 1
    assert sum(not (r.text or "").strip() for r in kept) == 1 and any(r.doc_id == 1 for r in kept)


def test_simhash_empty_is_zero(docs):
    rows = simhash_components(docs).collect()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(rows) == len(TEXTS) and {r.component_id for r in zero} == {1} and len(zero) == 4


def test_embedding_cases(spark, tables):
    rows = link_embeddings(spark.read.parquet(f"{tables[0]}/embeddings.parquet")).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert got[7] == (3, 7, True) and got[8] == (3, 7, False) and got[9] == (0, 9, True)
    assert got[None] == (3, 7, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11))


def test_overlaps_and_clean(spark, docs, tables):
    bench = spark.read.parquet(f"{tables[0]}/benchmark.parquet")
    found = find_overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(6, 3), (7, 3)}
    assert clean_documents(docs, bench).count() == len(TEXTS) - 2


def test_urls_and_archives(spark, tables):
    pages = spark.read.parquet(f"{tables[0]}/pages.parquet").withColumn("rule", F.lit(1)).withColumn("row", F.lit(2))
    rules = spark.createDataFrame([("example.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("example.com", "/", "allow"), ("example.com", None, "block")], "host string, path string, verdict string")
    rows = judge_urls(pages, rules).collect()
    assert len(rows) == 6 and {r.verdict for r in rows if r.page_id == 3} == {"allow"} and all(r.row == 2 for r in rows)
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    back = archive_round_trip(pages).collect()
    twins = [r for r in back if r.payload_bytes == 1200]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in twins) == [(0, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert max(r.payload_bytes for r in back) == 5000000


def test_bpe_nulls(spark, docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = encode(docs, path, P.PATTERN, ["doc_id", "text"]).withColumn("back", decode(F.col("ids"), path)).collect()
    assert all(bytes(r.back).decode() == (r.text or "") for r in rows)
    odd = spark.createDataFrame([([0, 999999],), (None,), ([],)], "ids array<int>").withColumn("back", decode(F.col("ids"), path)).collect()
    assert [r.back for r in odd][:2] == [None, None] and bytes(odd[2].back) == b""
