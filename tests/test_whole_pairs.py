"""Queries on all pairs of a group, not on a draw of them."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from duelframe.operators import learning as M
from duelframe.operators import pairs as P
from duelframe.plans import queries_learning as Q
from duelframe.plans.queries_pairs import arms

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def told_apart(spark):
    """(test, image, a, b) -> first date of all pairs the outcome can tell apart, found one by one."""
    rows = [r.asDict() for r in arms(spark, SF_DIR).collect()]
    groups, found = {}, {}
    for r in rows:
        groups.setdefault((r["test_id"], r["image_id"]), []).append(r)
    assert max(map(len, groups.values())) * (min(map(len, groups.values())) - 1) // 2 > P.MAX_PAIRS
    for group, members in groups.items():
        for x, y in itertools.combinations(sorted(members, key=lambda r: r["headline"]), 2):
            (c, n), (d, m) = ((r["clicks"], r["impressions"]) for r in (x, y))
            pooled = (c + d) / (n + m)
            error = math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
            if c * m != d * n and math.erfc(abs(c / n - d / m) / error / math.sqrt(2)) < P.ALPHA:
                found[*group, x["headline"], y["headline"]] = min(x["created_at"], y["created_at"])
    return found


def test_all_pairs_of_a_group(spark):
    sizes = {1: 1, 2: 2, 3: P.BLOCK, 4: P.BLOCK + 1, 5: 3 * P.BLOCK + 5}
    rows = [(t, "img", f"h{t}-{i:04d}", 10 + i % 7, 200, i) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "test_id int, image_id string, headline string, clicks long, impressions long, day int")
    df = df.withColumns({"ctr": F.col("clicks") / 200, "created_at": F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(day)")})
    got = P.build_pairs(df.drop("day"), cap=None).collect()
    for t, n in sizes.items():
        listed = sorted((r["headline_a"], r["headline_b"]) for r in got if r["test_id"] == t)
        assert listed == list(itertools.combinations(sorted(f"h{t}-{i:04d}" for i in range(n)), 2))
    for r in got:
        a, b = (int(r[f"headline_{s}"][-4:]) for s in "ab")
        assert (r["clicks_a"], r["clicks_b"], r["created_at"].timetuple().tm_yday) == (10 + a % 7, 10 + b % 7, min(a, b) + 1)
    assert set(P.build_pairs(df.drop("day"), cap=None).columns) == set(P.build_pairs(df.drop("day")).columns)


def test_term_differences_of_all_pairs(spark, told_apart):
    rows = Q.QUERIES["tfidf_diff"](spark, SF_DIR).collect()
    assert {tuple(r[c] for c in Q._KEYS) for r in rows} == set(told_apart)
    assert len({(*(r[c] for c in Q._KEYS), r["kind"]) for r in rows}) == len(rows)


def test_term_differences_of_many_texts(spark, monkeypatch):
    query = Q.QUERIES["tfidf_diff"]
    sent = query(spark, SF_DIR)
    monkeypatch.setattr(Q, "FEW_PAIRS", 0)
    assert query(spark, SF_DIR).exceptAll(sent).count() == 0


def test_the_challenger_learns_from_all_pairs(spark, told_apart, monkeypatch):
    learned, whole = [], M.fit_trees

    def fit(rows, weight, **more):
        learned.append(rows.agg(F.sum("n"), F.sum(weight)).first())
        return whole(rows, weight, trees=2, **more)

    monkeypatch.setattr(M, "fit_trees", fit)
    report = Q.QUERIES["challenger_report"](spark, SF_DIR).collect()
    first = {}
    for key, day in told_apart.items():
        first[key[0]] = min(first.get(key[0], day), day)
    newest = sorted(first, key=lambda t: (first[t], t), reverse=True)[:max(1, round(len(first) * 0.2))]
    held = sum(key[0] in newest for key in told_apart)
    assert [r["n_pairs"] for r in report] == [2 * held]
    assert learned == [(2 * len(told_apart), 2 * (len(told_apart) - held))]
