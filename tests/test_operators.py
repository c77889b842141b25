"""Operators on small fixtures against brute force or fixed expectations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.functions.stats import two_proportion_z, two_sided_p
from duelframe.operators import activity, clean, drift, evaluate, lifecycle, ordered, pairs, ranking, splits
from duelframe.operators.attribution import mark_spans, marked_lines, note_kinds, notes, top_reasons
from duelframe.operators.scoring import HAND_MODEL, LinearModel, model_from_frame
from duelframe.functions.spans import spans_of, with_spans
from duelframe.plans.queries_ranking import MARK_MODEL
from duelframe.session import cut_lineage


def test_p_values(spark):
    z = [0.0, 0.5, 1.0, 1.96, 3.3, 6.0, 7.5, 9.0, 20.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-6, abs=1e-300)


def test_z_without_variance(spark):
    df = spark.createDataFrame([(0, 100, 0, 50), (100, 100, 50, 50), (30, 100, 10, 100)], "ca long, na long, cb long, nb long")
    z = [r[0] for r in df.select(two_proportion_z(*[F.col(c) for c in df.columns])).collect()]
    assert z[:2] == [0.0, 0.0]
    assert z[2] == pytest.approx(0.2 / math.sqrt(0.2 * 0.8 * 0.02))


def test_prefix_sums_and_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(5)
    values = {"hot": np.round(rng.exponential(3, 4000), 2), "small": np.array([1.0, 1.0, 2.0, 9.0]), "one": np.array([5.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    sums = ordered.prefix_sums(df, ["k"], "v", {"n": F.lit(1)}).collect()
    for r in sums:
        assert r["n_before"] == int((values[r["k"]] < r["v"]).sum())
        assert r["n_total"] == len(values[r["k"]])
    steps = [0, 1, 5, 9, 10]
    for r in ordered.exact_quantiles(df, ["k"], "v", steps, 10).collect():
        assert r["quantile"] == pytest.approx(np.quantile(values[r["k"]], r["step"] / 10))


def _arms(spark, sizes):
    rows = [(t, "img", f"h{t}-{i:04d}", 10 + i % 7, 200) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "test_id int, image_id string, headline string, clicks long, impressions long")
    return df.withColumns({
        "ctr": F.col("clicks") / F.col("impressions"), "created_at": F.lit("2020-01-01").cast("timestamp_ntz"), "subset": F.lit("s"),
    })


def test_pair_draw(spark):
    sizes = {1: 1, 2: 2, 3: 9, 4: 10, 5: 700}
    got = pairs.build_pairs(_arms(spark, sizes)).collect()
    for t, n in sizes.items():
        drawn = [(r["headline_a"], r["headline_b"]) for r in got if r["test_id"] == t]
        total = n * (n - 1) // 2
        assert len(drawn) == len(set(drawn)) == min(total, 40)
        assert all(a < b for a, b in drawn)
        if total <= 40:
            every = itertools.combinations(sorted(f"h{t}-{i:04d}" for i in range(n)), 2)
            assert sorted(drawn) == sorted(every)


def test_pair_draw_is_even(spark):
    groups = spark.range(3000).select(F.col("id").alias("test_id"), F.lit("i").alias("image_id"), F.lit(14).cast("long").alias("n_arms"))
    counts = [r["n"] for r in pairs.pick_pairs(groups).groupBy("i", "j").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 91
    assert min(counts) > 0.6 * 3000 * 40 / 91 and max(counts) < 1.7 * 3000 * 40 / 91


def test_pairs_across_images_are_refused(spark):
    with pytest.raises(ValueError):
        pairs.build_pairs(_arms(spark, {1: 2}), same_image=False)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_temporal_split_with_tied_dates(spark, kind):
    dates = ["2020-01-01"] * 3 + ["2020-01-02"] * 6 + ["2020-01-03"]
    rows = [(f"{i:03d}", d) for i, d in enumerate(dates)] * 2
    df = spark.createDataFrame(rows, "test_id string, d string").select(
        F.col("test_id").cast(kind).alias("test_id"), F.col("d").cast("timestamp_ntz").alias("created_at")
    )
    held = {int(r["test_id"]) for r in splits.holdout_tests(df).filter("holdout").collect()}
    assert held == {8, 9}
    train, test = splits.temporal_split(df)
    assert (train.count(), test.count()) == (16, 4)
    splits.require_no_overlap(train, test)
    with pytest.raises(splits.LeakageError):
        splits.require_no_overlap(df, test)


RAW = "test_id string, image_id string, headline string, clicks string, impressions string, created_at string, subset string"


def test_clean_rules(spark):
    good = ("t", "i", "A line", "5", "200", "2014-11-20 06:43:16.005", "s")
    rows = [
        good, ("t", "i", "A line", "5", "100", "2015-03-12 18:04:35", "s"), ("t", "i", None, "5", "200", good[5], "s"),
        ("t", "i", "  ", "5", "200", good[5], "s"), ("t", "i", "x", "201", "200", good[5], "s"), ("t", "i", "x", "0", "0", good[5], "s"),
        ("t", "i", "x", "many", "200", good[5], "s"), ("t", None, "x", "1", "200", good[5], "s"), ("t", "i", "tiny", "1", "99", good[5], "s"),
    ]
    df = spark.createDataFrame(rows, RAW)
    arms = clean.build_arms(df).collect()
    assert [(r["headline"], r["clicks"], r["impressions"]) for r in arms] == [("A line", 10, 300)]
    assert str(arms[0]["created_at"]).startswith("2014-11-20 06:43:16.005")
    assert [r["remaining"] for r in clean.package_ledger(df).orderBy("seq").collect()] == [9, 7, 4, 3]
    with pytest.raises(clean.DataError):
        clean.clean_packages(df.drop("clicks"))


def test_unparsed_timestamp_stops_the_run(spark):
    df = spark.createDataFrame([("t", "i", "A", "5", "200", "yesterday", "s")], RAW)
    assert clean.unparsed_timestamps(df).count() == 1
    with pytest.raises(Exception, match="does not parse"):
        clean.build_arms(df).collect()


def test_placings_are_not_transitive(spark):
    rows = [(1, 0, 0.60), (1, 1, 0.57), (1, 2, 0.54)]
    placed = ranking.placing_ranges(spark.createDataFrame(rows, "ranking_id long, position long, score double"))
    got = {r["position"]: (r["lo"], r["hi"], r["place_label"]) for r in placed.collect()}
    assert got == {0: (1, 2, "1st–2nd"), 1: (1, 3, "1st–3rd"), 2: (2, 3, "2nd–3rd")}
    assert ranking.verdicts(placed).first()["verdict"] == "several contenders"
    assert {r["position"] for r in ranking.contenders(placed).collect()} == {0, 1}


def test_requests_out_of_bounds_are_refused(spark):
    rows = [(1, 0, "only one")] + [(2, i, f"line {i}") for i in range(6)] + [(3, 0, "x" * 301), (3, 1, "ok")]
    rows += [(4, 0, " a "), (4, 1, "b"), (4, 2, "  ")] + [(5, i, "flood") for i in range(2000)]
    df = spark.createDataFrame(rows, "ranking_id long, position long, text string")
    why = {r["ranking_id"]: r["refused"] for r in ranking.request_check(df).collect()}
    assert why == {1: "too few lines", 2: "too many lines", 3: "line too long", 4: None, 5: "too many lines"}
    assert sorted(r["text"] for r in ranking.split_requests(df).collect()) == ["a", "b"]


def test_equal_lines_share_everything(spark):
    df = spark.createDataFrame([(1, i, "The same line") for i in range(3)], "ranking_id long, position long, text string")
    got = ranking.rank_line_sets(df).orderBy("position").collect()
    assert [r["rank"] for r in got] == [1, 2, 3]
    assert {(r["score"], r["confidence"], r["place_label"]) for r in got} == {(0.5, 0.0, "1st–3rd")}


def test_emoji_note(spark):
    df = spark.createDataFrame([(1, 0, "Plain words here"), (1, 1, "That party \U0001F389")], "ranking_id long, position long, text string")
    got = top_reasons(notes(df)).collect()
    assert [r["position"] for r in got if r["kind"] == "not-measured"] == [1]


def test_marks_do_not_overlap(spark):
    df = with_spans(spark.createDataFrame([("This is your youth, isn't it... \U0001F389",), ("",)], "text string"))
    kinds = {"second_person_count": "helps", "demonstrative_count": "hurts", "ends_ellipsis": "helps"}
    rows = mark_spans(df, kinds).collect()
    marks = [(m["start"], m["end"], m["label"]) for m in rows[0]["marks"]]
    assert marks == [(0, 4, "demonstrative"), (8, 12, "second person"), (28, 31, "terminal punctuation")]
    assert rows[1]["marks"] == []


def test_quantiles_sort_only_the_rows_near_them(spark):
    rng = np.random.default_rng(11)
    cases = {"ties": np.repeat([0.5, 0.25], [9000, 11]), "mixed": np.r_[rng.normal(size=4000), np.zeros(4000)], "one": np.array([3.0]),
             "two": np.array([1.0, 2.0]), "far": np.r_[np.full(50, -1e300), rng.uniform(size=3000), 1e300]}
    rows = [(k, float(v)) for k, values in cases.items() for v in values]
    df = spark.createDataFrame(rows, "m string, p double").repartition(8)
    steps = [0, 1, 10, 19, 20]
    found = ordered.exact_quantiles(df, ["m"], "p", steps, 20)
    got = {(r["m"], r["step"]): r["quantile"] for r in found.collect()}
    for name, values in cases.items():
        ranked = np.sort(values)
        for s in steps:
            lo, rest = divmod((len(values) - 1) * s, 20)
            expected = ranked[lo] + (ranked[lo + (rest > 0)] - ranked[lo]) * (rest / 20)
            assert got[name, s] == pytest.approx(expected, rel=1e-12, abs=1e-12), (name, s)
    # The rows of a key stay in their tasks; only what lies near a wanted rank goes to the task of its range.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


def test_ranges_follow_the_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_VALUES", 10)
    df = spark.range(5000).select(F.lit("a").alias("m"), (F.col("id") % 3000).alias("v"))
    rows = ordered.prefix_sums(df, ["m"], "v", {"n": F.lit(1)})
    before = 0
    for r in sorted(rows.collect(), key=lambda r: r["v"]):
        assert (r["n"], r["n_before"], r["n_total"]) == (2 if r["v"] < 2000 else 1, before, 5000)
        before += r["n"]
    assert before == 5000


def test_spans_of_words_are_those_of_all_tokens(spark):
    texts = ["This is your youth, isn’t it", "''", "", "'' YOU’RE, ’you’ and 'yours'\U0001F389 you", "no word", "漢字 you é you", " that"]
    words = ["you", "your", "yours", "you're", "that"]
    df = with_spans(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("few", spans_of(F.col("text"), words))
    for r in df.collect():
        fold = lambda t: t["token"].lower().replace("’", "'")
        assert r["few"] == [t for k, t in enumerate(r["tokens"]) if k == 0 or fold(t) in words], r["text"]


def test_marked_lines(spark):
    lines = [(1, 0, "This is your youth, isn't it?"), (1, 1, "Plain words here"), (1, 2, "That’s it..."), (2, 0, "One line"), (2, 1, "Same line")]
    df = spark.createDataFrame(lines, "ranking_id long, position long, text string")
    noted = note_kinds(notes(df, MARK_MODEL)).select("ranking_id", "position", "text", "kinds")
    every = mark_spans(with_spans(noted), "kinds").select("ranking_id", "position", F.inline("marks"))
    got = marked_lines(noted)
    assert sorted(got.collect()) == sorted(every.collect()) and got.count() >= 4
    # Marks are worked out once, not again in a filter on their number.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("terminal punctuation") <= every._jdf.queryExecution().optimizedPlan().toString().count("terminal punctuation") / 2


def _sides(spark, train, live):
    rows = [("f", float(v), "train") for v in train] + [("f", float(v), "live") for v in live]
    return spark.createDataFrame(rows, "feature string, value double, side string")


def _numpy_psi(train, live):
    edges = np.unique(np.quantile(train, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    t, l = (np.maximum(np.histogram(x, bins=edges)[0] / len(x), 1e-6) for x in (train, live))
    return float(np.sum((l - t) * np.log(l / t)))


def test_psi(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=1500)
    cases = {"same": base, "shifted": base + 2.5, "apart": rng.uniform(50, 60, 300)}
    for name, live in cases.items():
        sums = drift.value_sums(_sides(spark, base, live), ["feature"])
        assert drift.psi(sums, ["feature"]).first()["psi"] == pytest.approx(_numpy_psi(base, live), abs=1e-9), name
    blind = drift.value_sums(_sides(spark, [0, 1, 1] * 33, [1] * 50), ["feature"])
    assert drift.psi(blind, ["feature"]).first()["psi"] == 0.0
    assert drift.psi_discrete(blind, ["feature"]).first()["psi"] > 1
    constant = drift.value_sums(_sides(spark, [2] * 20, [2, 2, 3, 4, float("nan")]), ["feature"])
    assert drift.psi(constant, ["feature"]).first()["psi"] == pytest.approx(5.0)


def test_ks_and_degenerate_predictions(spark):
    a, b = np.arange(100) / 10, np.arange(100) / 10 + 2
    got = drift.ks_two_sample(drift.value_sums(_sides(spark, a, b), ["feature"]), ["feature"]).first()
    assert got["ks_statistic"] == pytest.approx(0.2)
    p = spark.createDataFrame([("flat", 0.5)] * 90 + [("flat", 0.9)] * 10 + [("wide", i / 100) for i in range(100)], "m string, p double")
    health = {r["m"]: r["degenerate"] for r in drift.prediction_health(p, ["m"]).collect()}
    assert health == {"flat": True, "wide": False}


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(1)
    p, y = np.round(rng.uniform(size=300), 1), rng.integers(0, 2, 300)
    rows = [("a", float(x), int(t)) for x, t in zip(p, y)] + [("b", 0.3, 1), ("b", 0.9, 1)]
    sums = evaluate.score_sums(spark.createDataFrame(rows, "m string, p double, label long"), ["m"])
    got = {r["m"]: r for r in evaluate.pairwise_metrics(sums, ["m"]).collect()}
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert got["a"]["roc_auc"] == pytest.approx(np.mean(wins))
    assert got["a"]["accuracy"] == pytest.approx(np.mean((p >= 0.5) == y))
    assert got["b"]["roc_auc"] is None


def test_strongest_arm_is_the_borda_winner(spark):
    rng = np.random.default_rng(8)
    strengths = rng.normal(size=12)
    score = [np.mean([1 / (1 + np.exp(t - s)) for j, t in enumerate(strengths) if j != i]) for i, s in enumerate(strengths)]
    rows = [(1, "i", f"h{i:02d}", float(s), 0.1) for i, s in enumerate(strengths)]
    df = spark.createDataFrame(rows, "test_id long, image_id string, headline string, strength double, ctr double")
    assert evaluate.group_choices(df).first()["pick"]["headline"] == f"h{int(np.argmax(score)):02d}"


def test_rate_windows_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 2)), float(t)) for i, t in enumerate(np.round(rng.uniform(0, 9000, 800), 1))]
    rows += [(900, 0, 3599.9), (901, 0, 3600.0), (902, 0, 3659.9), (903, 0, 3660.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id int, s double").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1000000).cast("long"))
    )
    got = {r["event_id"]: r["n_recent"] for r in activity.rate_windows(df).collect()}
    for i, user, at in rows:
        near = sum(1 for _, u, t in rows if u == user and at - 60 < t - 1e-9 and t <= at + 1e-9)
        assert got[i] == near


def test_validation_splits_rows(spark):
    rows = [(1, 10, 5, 1, 0.5), (2, 0, 5, 1, 0.5), (3, 10, None, None, None), (4, None, -1, 2, 1.5)]
    df = spark.createDataFrame(rows, "id int, list_size int, opens int, clicks int, share double")
    good, bad = activity.valid_and_quarantine(df, activity.outcome_rules())
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["failed"] for r in bad.collect()} == {
        2: ["list_size positive"], 3: ["some signal"], 4: ["opens not negative", "share within 0-1"],
    }


GATE = "version string, synthetic boolean, feature_spec_version int, export_passed boolean, antisymmetry double, tolerance double, force string"


@pytest.mark.parametrize(("row", "passed", "failures"), [
    ((False, 1, True, 0.0, 1e-6, None), True, []),
    ((True, 1, True, 0.0, 1e-6, "please"), False, ["synthetic"]),
    ((False, 2, True, 0.0, 1e-6, "please"), False, ["feature spec"]),
    ((False, None, None, None, None, None), False, ["feature spec"]),
    ((False, 1, False, 0.0, 1e-6, None), False, ["export"]),
    ((False, 1, True, 0.1, 1e-6, None), False, ["antisymmetry"]),
    ((False, 1, True, 0.1, 1e-6, "agreed"), True, []),
])
def test_gates(spark, row, passed, failures):
    got = lifecycle.promotion_gates(spark.createDataFrame([("v", *row)], GATE)).first()
    assert (got["passed"], got["failures"]) == (passed, failures)


@pytest.mark.parametrize(("metrics", "verdict"), [
    ((0.61, 0.62, 500, 0.0), "PROMOTE"), ((0.61, 0.60, 500, 0.0), "REJECTED: no user gain"),
    ((0.601, 0.62, 500, 0.0), "REJECTED: no holdout gain"), ((0.5, 0.5, 500, 0.0), "REJECTED: worse on both"),
    ((0.9, 0.9, 199, 0.0), "HELD: too few user labels"), ((0.9, 0.9, 500, 0.1), "REJECTED: order dependent"),
])
def test_verdicts(spark, metrics, verdict):
    rows = [("a", "champion", 0.60, 0.60, 0, 0.0), ("b", "challenger", *metrics)]
    df = spark.createDataFrame(rows, "version string, role string, holdout_accuracy double, user_accuracy double, n_user_labels int, antisymmetry double")
    assert lifecycle.promotion_verdict(df).first()["verdict"] == verdict


def test_user_scoped_rows(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id int, user_id int")
    admins = spark.createDataFrame([(9,)], "user_id int")
    assert [activity.visible_rows(rows, who, admins).count() for who in (7, 9, 5)] == [1, 2, 0]
    assert activity.erase(rows, 7).count() == 1


def test_models_that_cannot_be_identified(spark):
    assert model_from_frame(HAND_MODEL.to_frame(spark)) == HAND_MODEL
    for bad in (
        dict(version=""), dict(features=()), dict(coef=(1.0,)), dict(spec_version=2), dict(features=("clicks",), coef=(1.0,), scale=(1.0,)),
    ):
        base = dict(version="v", features=("char_count", "word_count"), coef=(1.0, 2.0), scale=(1.0, 0.0))
        with pytest.raises(ValueError):
            LinearModel(**(base | bad))


def test_checkpoint_is_reliable(spark):
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir() is not None


def test_outcome_agreement(spark):
    rows = [(1, 0.9, 0.2), (1, 0.1, 0.1), (2, 0.3, 0.5), (2, 0.6, 0.1), (3, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "r int, s double, rate double")
    got = evaluate.outcome_agreement(df, ["r"], F.col("s"), F.col("rate")).first()
    assert (got["n_user_labels"], got["user_accuracy"]) == (2, 0.5)


def test_sessions_of_a_busy_user_against_brute_force(spark):
    rng = np.random.default_rng(4)
    at = sorted(np.round(np.cumsum(rng.exponential(900, 400)), 3).tolist() + [0.0, 1800.0])
    rows = [(u, t) for t in at for u in (1, 2) if u == 1 or t % 3 < 1]
    df = spark.createDataFrame(rows, "user_id int, s double").withColumn(
        "ts", F.timestamp_micros(F.round(F.col("s") * 1000000).cast("long"))
    )
    got = sorted((r["user_id"], r["n_events"]) for r in activity.activity_sessions(df).collect())
    want = []
    for user in (1, 2):
        times, size = [t for u, t in rows if u == user], 0
        for i, t in enumerate(times):
            # A gap of exactly the limit stays in the session, as in Spark's session windows.
            if i and round((t - times[i - 1]) * 1e6) > 1800 * 10**6:
                want.append((user, size))
                size = 0
            size += 1
        want.append((user, size))
    assert got == sorted(want)


@pytest.mark.parametrize("train", [[0.0, 10.0] * 40, [3.0] * 50, [float(i % 7) for i in range(90)], [1.0, 2.0] * 30, [float(i) for i in range(200)]])
@pytest.mark.parametrize("live", [[5.5] * 60, [3.0] * 30 + [9.0] * 40, [float(i % 11) for i in range(77)]])
def test_windowed_psi_equals_psi(spark, train, live):
    """Bins without training rows and constant training sides included."""
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "value double")
    sides = frame(train).selectExpr("'f' feature", "value", "'train' side").unionByName(frame(live).selectExpr("'f' feature", "value", "'live' side"))
    want = drift.psi(drift.value_sums(sides, ["feature"]), ["feature"]).first()["psi"]
    got = drift.windowed_psi(frame(train), frame(live).selectExpr("1 day", "value"), "day").first()
    assert got["n_live"] == len(live) and got["psi"] == pytest.approx(want)


def test_verdict_without_champion_or_accuracy(spark):
    row = "version string, role string, holdout_accuracy double, user_accuracy double, n_user_labels long, antisymmetry double"
    champion, good, unknown = ("c", "champion", 0.6, 0.6, 900, 0.0), ("a", "challenger", 0.7, 0.7, 900, 0.0), ("b", "challenger", None, 0.7, 900, 0.0)
    of = lambda rows: {r.version: r.verdict for r in lifecycle.promotion_verdict(spark.createDataFrame(rows, row)).collect()}
    assert of([champion, good, unknown]) == {"a": "PROMOTE", "b": "HELD: accuracy missing"}
    assert of([good]) == {"a": "HELD: no champion"}
    assert of([champion, ("d", *champion[1:]), good]) == {"a": "HELD: several champions"}


def test_exact_limit_equals_replay(spark):
    """Bursts, polite users, equal times, and events at the very edge of the window."""
    import random

    rng, rows = random.Random(4), []
    for user in range(6):
        at = 0
        for _ in range(200):
            at += rng.choice([0, 1, 2, 5, 10, 10, 59, 60, 61] if user % 2 else [30, 61, 200])
            rows.append((len(rows), user, at))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for user in range(6):
        accepted = []
        for at, event in sorted((s, e) for e, u, s in rows if u == user):
            accepted = [t for t in accepted if at - t < 60]
            want[event] = len(accepted) < 4
            if want[event]:
                accepted.append(at)
    assert 0 < sum(want.values()) < len(want)
    for width in (60, 3600):
        got = {r["event_id"]: r["allowed"] for r in activity.exact_limit(df, seconds=60, limit=4, slice_seconds=width).collect()}
        assert got == want
