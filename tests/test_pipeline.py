"""The whole run on a synthetic archive with a planted signal."""

import pytest
from pyspark.sql import functions as F

from duelframe.functions.features import FEATURE_NAMES
from duelframe.operators import clean, evaluate, learning, pairs, splits, vectors
from duelframe.operators.scoring import headline_strengths
from duelframe.session import cut_lineage

WORDS = "truth secret reason why this that watch amazing simple quick real story moment change proof answer".split()


@pytest.fixture(scope="module")
def run(spark):
    words = F.array(*[F.lit(w) for w in WORDS])
    arms = spark.range(600 * 2 * 3, numPartitions=8).select(
        F.floor(F.col("id") / 6).alias("test_id"), F.floor(F.col("id") / 3).cast("string").alias("image_id"), "id",
        (F.floor(F.rand(7) * 11) + 3).cast("int").alias("k"), (F.rand(8) < 0.35).alias("asks"), F.rand(9).alias("u"),
        (F.floor(F.rand(10) * 5600) + 400).cast("long").alias("impressions"),
    )
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.get(words, F.pmod(F.hash("id", i), F.lit(16)))), " ")
    arms = arms.withColumn("headline", F.concat(text, F.when(F.col("asks"), "?").otherwise("")))
    rate = 1 / (1 + F.exp(-(-0.06 * F.char_length("headline") + 0.35 * F.col("asks").cast("int") - 2.0)))
    noise = F.sqrt(rate * (1 - rate) * F.col("impressions")) * (F.col("u") - 0.5)
    clicks = F.greatest(F.lit(0), F.least(F.col("impressions"), F.round(rate * F.col("impressions") + noise).cast("long")))
    packages = cut_lineage(arms.select(
        "test_id", "image_id", "headline", clicks.alias("clicks"), "impressions",
        F.timestamp_seconds(F.lit(1356998400) + F.col("test_id") * 69120).cast("timestamp_ntz").alias("created_at"),
        F.lit("exploratory").alias("subset"), F.lit(0).alias("problem"), F.lit(1).alias("winner"),
    ))
    built = cut_lineage(clean.build_arms(packages))
    candidates = cut_lineage(pairs.build_pairs(built))
    labelled = cut_lineage(pairs.label_pairs(candidates))
    diffs = cut_lineage(vectors.difference_vectors(splits.with_fold(splits.with_holdout(labelled))))
    names = vectors.kept_features(vectors.feature_support(diffs))
    rows = cut_lineage(learning.select_features(vectors.mirrored(diffs), names))
    return dict(arms=built, candidates=candidates, labelled=labelled, diffs=diffs, names=names, rows=rows)


def test_pairs_stay_inside_an_image(run):
    assert run["labelled"].count() > 500
    sizes = run["arms"].groupBy("test_id", "image_id").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert run["candidates"].count() == sizes


def test_sweep_rises(run):
    kept = [r["pairs"] for r in pairs.alpha_sweep(run["candidates"]).orderBy("alpha").collect()]
    assert kept == sorted(kept) and kept[0] > 0


def test_mirror_is_exact(run):
    total = run["rows"].agg(*[F.sum(F.get("d", F.lit(i))).alias(f"s{i}") for i in range(len(run["names"]))]).first()
    assert max(abs(v) for v in total) < 1e-6
    assert run["rows"].filter("label = 1").count() == run["labelled"].count()


def test_low_support_features_leave(run):
    assert "emoji_count" not in run["names"] and "char_count" in run["names"]
    assert set(run["names"]) <= set(FEATURE_NAMES)


def test_split_is_forward_in_time(run):
    held = run["diffs"].filter("holdout").agg(F.min("created_at")).first()[0]
    assert run["diffs"].filter("not holdout").agg(F.max("created_at")).first()[0] < held
    splits.require_no_overlap(run["diffs"].filter("holdout"), run["diffs"].filter("not holdout"))


def test_baseline_finds_the_signal(run):
    train, test = run["rows"].filter("not holdout"), run["rows"].filter("holdout")
    model = learning.fit_baseline(train, run["names"])
    predicted = learning.predict_differences(test, model)
    got = learning.metrics(predicted, "baseline").first()
    assert got["accuracy"] > 0.60 and got["roc_auc"] > 0.65
    both = predicted.groupBy("test_id", "image_id", "headline_a", "headline_b").agg(F.sum("p").alias("p"))
    assert both.agg(F.max(F.abs(F.col("p") - 1))).first()[0] < 1e-12
    held = run["diffs"].filter("holdout").select("test_id").distinct()
    arms = run["arms"].join(held, "test_id", "left_semi")
    choices = evaluate.group_choices(arms.join(headline_strengths(arms, model), "headline"))
    assert evaluate.lift(choices).first()["lift_vs_mean_pct"] > 0
    chosen = evaluate.selection(choices).first()
    assert chosen["top1_accuracy"] > chosen["top1_baseline_random"]


def test_few_pairs_are_refused(run):
    with pytest.raises(ValueError):
        learning.fit_baseline(run["rows"].limit(100), run["names"])
