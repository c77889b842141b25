"""Fitting and validating pairwise models with Spark ML, over tables of distinct pairs with counts."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import FEATURE_NAMES
from ..functions.stats import logistic
from ..session import cut_lineage
from . import evaluate
from .scoring import LinearModel
from .splits import N_FOLDS

# ---- fixed values ------------------------------------------------------------
C, MAX_ITER, MIN_PAIRS = 1.0, 2000, 500
TREES, STEP, DEPTH, ROW_SHARE, COLUMN_SHARE, MIN_LEAF = 400, 0.05, 5, 0.8, "0.8", 50
# ---- end of fixed values -----------------------------------------------------

#: Runs: one for each fold, which learns from the others, and PAST, which learns from all but the newest tests.
PAST = N_FOLDS
RUNS = (*range(N_FOLDS), PAST)
#: Largest mean gradient of a fit that counts as converged.
FLAT = 1e-10


class ConvergenceError(RuntimeError):
    """A fit stopped before its optimum."""


# ---- tables of distinct pairs --------------------------------------------------

def pair_table(pairs: DataFrame) -> DataFrame:
    """Distinct (headline_a, headline_b, label) of pairs with ``fold`` and ``holdout``.

    ``n``: how many pairs; ``test``: how many of them each run tests on. A run learns from n - test, so no run
    copies the rows.
    """
    tested = [F.count_if(F.col("fold") == k) for k in range(N_FOLDS)] + [F.count_if("holdout")]
    return pairs.groupBy("headline_a", "headline_b", "label").agg(F.count(F.lit(1)).alias("n"), F.array(*tested).alias("test"))


def _added(columns: Sequence[str], keys: Sequence[str | Column], table: DataFrame) -> DataFrame:
    sums = [F.sum(F.get("test", F.lit(r))) for r in RUNS]
    return table.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*sums).alias("test")).select(*columns, "n", "test")


def difference_table(diffs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct (d, label) with counts, from a pair table with ``d``; of a pair and its mirror, one stands for both.

    The first difference that is not zero is positive: p(-d) = 1 - p(d) makes the other direction the same loss.
    """
    rows = select_features(diffs, names)
    turn = F.coalesce(F.get(F.filter("d", lambda v: v != 0), F.lit(0)) < 0, F.lit(False))
    # + 0.0: no negative zeros, which would tell equal rows apart.
    turned = rows.withColumns({
        "d": F.transform("d", lambda v: F.when(turn, -v).otherwise(v) + 0.0),
        "label": F.when(turn, 1 - F.col("label")).otherwise(F.col("label")),
    })
    return _added(["d", "label"], ["d", "label"], turned)


def train_weight(run: int) -> Column:
    return (F.col("n") - F.get("test", F.lit(run))).cast("double")


def test_weight(run: int) -> Column:
    return F.get("test", F.lit(run)).cast("double")


def both_ways(table: DataFrame) -> DataFrame:
    """Each row and its mirror."""
    turned = table.withColumns({"d": F.transform("d", lambda v: -v), "label": 1 - F.col("label")})
    return table.unionByName(turned)


def select_features(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the entries of ``d`` that the model uses."""
    at = [FEATURE_NAMES.index(n) for n in names]
    return rows.withColumn("d", F.array(*[F.get("d", F.lit(i)) for i in at]))


# ---- baseline ------------------------------------------------------------------

def difference_scales(rows: DataFrame, weights: Sequence[Column]) -> list[tuple[float, list[float]]]:
    """For each weight: its sum, and per feature the deviation of mirrored differences (mean 0), 1 where constant.

    One aggregation for all weights.
    """
    parts = []
    for i, w in enumerate(weights):
        parts += [F.sum(w).alias(f"w{i}"), Summarizer.normL2(F.col("features"), w).alias(f"s{i}")]
    row = rows.select(array_to_vector("d").alias("features"), "*").agg(*parts).first()
    out = []
    for i in range(len(weights)):
        total = float(row[f"w{i}"] or 0.0)
        out.append((total, [float(v) / total ** 0.5 or 1.0 for v in row[f"s{i}"]] if total else []))
    return out


def _slope_and_bend(scaled: DataFrame, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and second derivatives of the summed loss, and the summed weight: tasks add up, the driver gets the sums alone."""
    size = len(coef)

    def sums(batches):
        total = np.zeros((size + 2, size))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, size)
                y, w = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
                p = 1 / (1 + np.exp(-(x @ coef)))
                total[0] += x.T @ (w * (p - y))
                total[1, 0] += w.sum()
                total[2:] += (x * (w * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    rows = scaled.select(vector_to_array("features").alias("x"), "label", "weight").mapInArrow(sums, "k bigint, v double")
    rows = rows.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((size + 2) * size)
    total[rows["k"].to_numpy()] = rows["v"].to_numpy()
    total = total.reshape(size + 2, size)
    return total[0], total[2:], float(total[1, 0])


def _to_optimum(scaled: DataFrame, coef: np.ndarray, penalty: float, steps: int = 4) -> np.ndarray:
    """Ends a fit by Newton steps until its mean gradient vanishes; a fit for which it does not is an error."""
    for left in range(steps, -1, -1):
        slope, bend, n = _slope_and_bend(scaled, coef)
        slope = slope / n + penalty * coef
        steep = float(np.abs(slope).max())
        if steep <= FLAT:
            return coef
        if left:
            coef = coef - np.linalg.solve(bend / n + penalty * np.eye(len(coef)), slope)
    raise ConvergenceError(f"the mean gradient of the fit is {steep:.3g}, over {FLAT:.3g}")


def fit_baseline(
    rows: DataFrame, names: Sequence[str], version: str = "baseline", weight: Column | None = None, both: bool = True,
    scale: tuple[float, list[float]] | None = None,
) -> LinearModel:
    """Logistic regression on differences ``d``, each ``weight`` times; ``both``: rows hold both directions.

    No intercept and no centring: p(d) + p(-d) = 1 holds by construction.  The
    penalty matches C = 1 for a sum of losses over both directions, so it shrinks with the row count. A fit whose
    gradient has not vanished is an error.
    """
    weight = F.lit(1.0) if weight is None else weight
    total, scales = scale or difference_scales(rows, [weight])[0]
    mirrored = total if both else 2 * total
    if mirrored < 2 * MIN_PAIRS:
        raise ValueError(f"only {int(mirrored) // 2} labelled pairs, too few to train on")
    divisor = F.array(*[F.lit(s) for s in scales])
    scaled = rows.select(
        F.col("label").cast("double").alias("label"), weight.alias("weight"),
        array_to_vector(F.zip_with("d", divisor, lambda v, s: v / s)).alias("features"),
    ).filter("weight > 0")
    penalty = 1.0 / (C * mirrored)
    model = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=penalty, maxIter=MAX_ITER, weightCol="weight",
    ).fit(scaled)
    coef = _to_optimum(scaled, model.coefficients.toArray(), penalty)
    return LinearModel(version, tuple(names), tuple(map(float, coef)), tuple(scales))


def predict_differences(rows: DataFrame, model: LinearModel) -> DataFrame:
    weights = F.array(*[F.lit(c / s) for c, s in zip(model.coef, model.scale)])
    total = F.aggregate(F.zip_with("d", weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", logistic(total))


# ---- boosted trees ---------------------------------------------------------------

def fit_trees(rows: DataFrame, weight: Column | None = None, trees: int = TREES, seed: int = 20260826, **settings):
    """Boosted-tree challenger on rows of both directions; not antisymmetric, the gates judge that.

    A leaf needs the weight of MIN_LEAF rows, as a row may stand for many.
    """
    table = rows.select(
        F.col("label").cast("double").alias("label"), array_to_vector("d").alias("features"),
        (F.lit(1.0) if weight is None else weight).alias("weight"),
    ).filter("weight > 0")
    table = cut_lineage(table)
    total = table.agg(F.sum("weight")).first()[0] or 0.0
    if total < 2 * MIN_PAIRS:
        raise ValueError(f"only {int(total) // 2} labelled pairs, too few to train on")
    chosen = dict(
        maxIter=trees, stepSize=STEP, maxDepth=DEPTH, subsamplingRate=ROW_SHARE, featureSubsetStrategy=COLUMN_SHARE,
        minWeightFractionPerNode=min(MIN_LEAF / total, 0.49), seed=seed, weightCol="weight",
    ) | settings
    return GBTClassifier(**chosen).fit(table)


def predict_trees(rows: DataFrame, model) -> DataFrame:
    scored = model.transform(rows.withColumn("features", array_to_vector("d")))
    return scored.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


# ---- measures ----------------------------------------------------------------------

def metrics(predicted: DataFrame, model: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Accuracy, AUC and Brier score of mirrored predictions, each counted ``weight`` times."""
    tagged = predicted.select(
        *keys, F.lit(model).alias("model"), F.round("p", 12).alias("p"), "label", *([weight] if weight else []))
    columns = ["model", *keys]
    return evaluate.pairwise_metrics(evaluate.score_sums(tagged, columns, weight), columns)


def at_once(jobs: Sequence) -> list:
    """Results of calls that each start Spark jobs of their own; a few run side by side."""
    with ThreadPoolExecutor(min(len(jobs), N_FOLDS)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def tested(predictions: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """(fold, p, label, n) of both directions: what each fold's model says of the fold's own rows."""
    parts = None
    for run, predicted in predictions:
        rows = predicted.select(F.lit(run).cast("long").alias("fold"), "p", "label", test_weight(run).cast("long").alias("n")).filter("n > 0")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def cross_validate(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """The baseline's metrics per fold (whole tests) on both directions, from a difference table."""
    weights = [train_weight(k) for k in range(N_FOLDS)]
    scales = difference_scales(table, weights)
    present = [k for k in range(N_FOLDS) if scales[k][0]]

    def job(k: int):
        model = fit_baseline(table, names, "baseline", weights[k], False, scales[k])
        return k, predict_differences(both_ways(table), model)

    return metrics(tested(at_once([lambda k=k: job(k) for k in present])), "baseline", ["fold"], "n")


def cross_validate_trees(table: DataFrame, trees: int = TREES) -> DataFrame:
    """The boosted trees' metrics per fold, on the same table."""
    both = cut_lineage(both_ways(table))

    def job(k: int):
        return k, predict_trees(both, fit_trees(both, train_weight(k), trees))

    return metrics(tested(at_once([lambda k=k: job(k) for k in range(N_FOLDS)])), "trees", ["fold"], "n")
