"""Document frequencies counted piece by piece against the terms of each text."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duelframe.operators import document_terms as D
from duelframe.operators import tfidf
from duelframe.plans.queries_text import QUERIES

vocabulary = QUERIES["vocabulary"]

SPACES = [9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
TEXTS = [
    None, "", " ", "\n\t ", "a", "a b", "ab", "ab ab ab", " ab cd ", "a_b __ _", "x-y don't it's 3.14 42 7", "nul \0 a\0b \0\0", "the them theme the",
    "İstanbul ΣΑΣ ẞ Ǆ ﬁ", "日本語 中文字 語", "été été ½ ² Ⅷ ①", "👍 a👍b 👍👍👍👍 \U0001d538\U0001d539", "ab", "cd ef", "gh",
    "".join(f" x{chr(c)}y" for c in SPACES), "x" * 50, "long " * 400 + "end",
]


def _plain(texts):
    """Terms text by text, a row for each."""
    return tfidf.term_counts(texts, ["doc_id"], "text").groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df"))


def _same(texts):
    got, want = tfidf.vocabulary(texts, "text", 1), _plain(texts)
    rows = {(r["kind"], r["term"]): r["df"] for r in got.collect()}
    assert rows == {(r["kind"], r["term"]): r["df"] for r in want.collect()}
    return rows


def test_odd_texts(spark):
    rows = _same(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1))
    assert rows["word", "ab"] == 4 and rows["word", "ab ab"] == 1 and ("word", "ab cd") in rows and ("word", "cd gh") not in rows
    assert ("char", "a\0b") in rows and ("char", " 日本") in rows


def test_every_character(spark):
    """Letters, digits and white space are what Spark's own patterns say, beyond ASCII as well."""
    _same(spark.createDataFrame([(c, f"ab{chr(c)}cd") for c in range(0x3400)], "doc_id long, text string"))


@pytest.mark.parametrize("kept", [0, 40, 3000, 1 << 20])
@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_pieces_cut_nothing(size, kept, monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", size)
    monkeypatch.setattr(D, "KEPT_GRAMS", kept)
    monkeypatch.setattr(D, "MOST_ROWS", 7)
    texts = [t.lower() for t in TEXTS if t and t.isascii()] * 2
    whole = pa.array(["", *texts, ""])
    found = {}
    for part in (whole.slice(0, 9), whole.slice(9), whole.slice(0, 0)):
        for rows in D.document_terms([pa.RecordBatch.from_arrays([part, part], ["_dark", "_plain"])]):
            assert rows.num_rows <= 7
            for kind, term, df in zip(*(c.to_pylist() for c in rows.columns)):
                found[kind, term] = found.get((kind, term), 0) + df
    want = {}
    for t in texts:
        words = ["".join(c if D.WORD[ord(c)] else " " for c in t).split()][0]
        words = [w for w in words if len(w) > 1]
        terms = {("word", w) for w in words} | {("word", f"{a} {b}") for a, b in zip(words, words[1:])}
        dark = "".join(c if D.DARK[ord(c)] else " " for c in t).split(" ")
        padded = [f" {w} " for w in dark if w]
        terms |= {("char", p[i:i + n]) for p in padded for n in (3, 4, 5) for i in range(len(p) - n + 1)}
        for term in terms:
            want[term] = want.get(term, 0) + 1
    assert found == want


def test_terms_of_texts_are_not_rows(spark):
    texts = spark.range(300).select(F.lit("one two three").alias("text")).coalesce(1)
    got = tfidf.vocabulary(texts, "text")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["df"] for r in got.collect()} == {300}
    rows = sum(b.num_rows for b in D.document_terms([pa.RecordBatch.from_arrays([pa.array(["one two three"] * 300)] * 2, ["a", "b"])]))
    assert rows == got.count()


def test_grams_of_a_task_are_added_up(monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three"] * 300)] * 2, ["a", "b"])
    rows = [r for b in D.document_terms([batch, batch]) for r in zip(*(c.to_pylist() for c in b.columns))]
    found = [r for r in rows if r[0] == "char"]
    assert len({t for _, t, _ in found}) == len(found) and {n for _, _, n in found} == {600}


def test_texts_in_enough_files_are_read_where_they_lie(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"one two {i % 3} three") for i in range(90)], "doc_id long, text string")
    for name, files in (("one", 1), ("many", 2 * spark.sparkContext.defaultParallelism)):
        texts.repartition(files).write.parquet(str(tmp_path / name / "documents.parquet"))
    one, many = (vocabulary(spark, str(tmp_path / n)) for n in ("one", "many"))
    exchanges = [df._jdf.queryExecution().optimizedPlan().toString().count("Repartition ") for df in (one, many)]
    assert exchanges == [1, 0] and one.exceptAll(many).count() == many.exceptAll(one).count() == 0
