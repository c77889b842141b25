"""Findings of the fourth round."""

import itertools

from pyspark.sql import functions as F

from duelframe.functions import text as T
from duelframe.operators import ranking as R
from duelframe.operators import tfidf
from duelframe.session import cut_lineage
from duelframe.sources import sinks

STRENGTHS = (3.4790476190476185, 5.357380952380951, 3.4790476190476185, 5.574047619047619, 3.9623809523809514)
LINES = [(1, 0, "This is one line"), (1, 1, "Why not two?"), (1, 2, "Three apples, 3 pears"), (1, 3, "This is one line")]


def test_equal_lines_have_equal_scores_wherever_they_stand(spark):
    orders = list(itertools.permutations(STRENGTHS))
    rows = [(k, i, s) for k, order in enumerate(orders) for i, s in enumerate(order)]
    scored = R.aggregate_sets(spark.createDataFrame(rows, "ranking_id long, position long, strength double"))
    assert scored.groupBy("strength").agg(F.countDistinct("score").alias("n")).filter("n > 1").count() == 0
    long = R.borda_scores(R.pairwise_matrix(scored)).withColumnRenamed("i", "position")
    both = scored.select("ranking_id", "position", "score").exceptAll(long.select("ranking_id", "position", "score"))
    assert both.count() == 0


def test_rankings_are_stored_without_their_feature_maps(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(sinks, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    ranked = R.rank_line_sets(spark.createDataFrame(LINES, "ranking_id long, position long, text string"))
    ranked = ranked.select("ranking_id", "position", "text", "rank", "score")
    sinks.save_rankings(ranked, str(tmp_path), "hand-1", 1, widen=sinks.with_feature_maps)
    items, saved = (spark.read.parquet(str(tmp_path / t)) for t in ("ranking_items", "rankings"))
    assert stored == [[*ranked.columns, "created_at"]]
    assert saved.agg(F.sum("n_lines")).first()[0] == items.count() == len(LINES)
    assert {r["position"]: r["features"]["char_count"] for r in items.collect()} == {i: float(len(t)) for _, i, t in LINES}


def test_syllables_are_marked_in_one_pass(spark):
    words = {"the": 1, "table": 2, "tree": 1, "made": 1, "area": 2, "e": 1, "le": 1, "123": 1, "rhythm": 1, "idea": 2, "voie": 1, "hmm": 1, "ae": 1}
    df = spark.createDataFrame([(" ".join(words),), ("",), *((w,) for w in words)], "text string")
    marks = T.syllable_string(F.col("text"))
    got = [tuple(r) for r in df.select(T.syllable_total(marks), T.long_word_total(marks)).collect()]
    assert got == [(sum(words.values()), 0), (0, 0), *((n, 0) for n in words.values())]
    assert [r[0] for r in spark.sql("select explode(array('banana it', 'tomato potato', 'ab ab ab')) as t").select(T.long_word_total(T.syllable_string(F.col("t")))).collect()] == [1, 2, 0]
    plan = df.select(marks.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_orders_are_compared_without_a_row_for_each(spark):
    lines = spark.createDataFrame(LINES, "ranking_id long, position long, text string")
    got = R.order_invariance(lines)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["line"]: r for r in got.collect()}
    assert len(rows) == len(LINES) and {r["n_orders"] for r in rows.values()} == {2 * len(LINES)}
    assert all(r["score_drift"] < 1e-12 and not r["order_changed"] for r in rows.values())


def test_texts_of_repeated_pairs_are_compared_once(spark, monkeypatch):
    rows = [(k, a, b) for k in range(5) for a, b in (("red apple pie", "green apple tart"), ("blue sky", "red apple pie"))]
    pairs = spark.createDataFrame(rows, "test_id long, headline_a string, headline_b string")
    weights = tfidf.headline_weights(tfidf.pair_sides(pairs), tfidf.fit_idf(pairs))
    keys, seen, long = ["test_id", "headline_a", "headline_b"], [], tfidf.difference_terms
    monkeypatch.setattr(tfidf, "difference_terms", lambda p, w, k: seen.append(p.count()) or long(p, w, k))
    got = tfidf.difference_sizes(pairs, weights, keys)
    want = long(pairs, weights, keys).filter("abs(d) > 1e-9").groupBy(*keys, "kind").agg(F.count("*").alias("n_terms"), F.sum(F.expr("d * d")).alias("sq_norm"))
    rounded = lambda df: {(*r[:5], round(r[5], 9)) for r in df.collect()}
    assert rounded(got) == rounded(want) and got.count() == want.count() == 20 and seen == [2]


def test_a_word_is_cut_into_character_terms_once(spark):
    df = spark.createDataFrame([("the cat The cat the",), ("",), ("a a",)], "text string")
    terms = df.select(tfidf.char_terms(F.col("text"), True).alias("once"), tfidf.char_terms(F.col("text")).alias("each")).collect()
    assert [(set(r["once"]) == set(r["each"]), len(r["once"]) == len(set(r["each"]))) for r in terms] == [(True, True)] * 3
    assert [len(r["each"]) for r in terms] == [30, 0, 2]
    assert {(r["kind"], r["term"]): r["df"] for r in tfidf.vocabulary(df, "text", 1).collect()}[("char", " th")] == 1
