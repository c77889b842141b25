"""The TF-IDF variant: vectors of headlines for all runs in one pass, fits, strengths in text space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import hash_number
from ..session import cut_lineage, shared_folder
from . import tfidf
from .learning import C, MAX_ITER, RUNS, ConvergenceError, test_weight, train_weight
from .ordered import number_within

#: Copies of a term's row in the join with headlines: a term of every headline is spread over so many tasks.
SALTS = 8


@dataclass(frozen=True)
class TextSpace:
    """Stored vectors: pairs (run, headline_a, headline_b, label, n, test, features) and headlines (run, headline, features).

    ``sizes``: the vocabulary of each run, learned from its own training pairs.
    """

    pairs: str
    headlines: str
    sizes: dict[int, int]


def _per_run(columns: list[Column]) -> Column:
    return F.array(*columns)


def run_vocabulary(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, term, df, idf, idx): for each run (place in the arrays) the training documents with the term, null where
    fewer than MIN_DF, its idf and its number.

    ``counts``: (headline, kind, term, tf), found once for all runs.
    """
    sides = pairs.select(F.explode(F.array("headline_a", "headline_b")).alias("headline"), "n", "test")
    taught = [F.sum(train_weight(r)).cast("long") for r in RUNS]
    seen = sides.groupBy("headline").agg(_per_run(taught).alias("seen"))
    totals = seen.agg(*[F.sum(F.get("seen", F.lit(r))).alias(f"n{r}") for r in RUNS]).first()
    df = counts.join(seen, "headline").groupBy("kind", "term").agg(_per_run([F.sum(F.get("seen", F.lit(r))) for r in RUNS]).alias("df"))
    df = cut_lineage(df.withColumn("df", F.transform("df", lambda n: F.when(n >= tfidf.MIN_DF, n))).filter(F.exists("df", lambda n: n.isNotNull())))
    long = df.select("kind", "term", F.posexplode("df").alias("run", "n")).filter("n is not null")
    numbered = number_within(long.select("run", "kind", "term"), ["run"], ["kind", "term"], hash_number(F.col("term")))
    placed = numbered.groupBy("kind", "term").agg(_per_run([F.max(F.when(F.col("run") == r, F.col("idx"))) for r in RUNS]).alias("idx"))
    idf = _per_run([F.ln((F.lit(totals[f"n{r}"] or 0) + 1.0) / (F.get("df", F.lit(r)) + 1.0)) + 1.0 for r in RUNS])
    return df.join(placed, ["kind", "term"]).select("kind", "term", "df", idf.alias("idf"), "idx")


def headline_terms(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(headline, terms): what a headline holds of the vocabulary; one text's terms are one row."""
    salted = vocabulary.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    met = counts.withColumn("salt", F.pmod(F.xxhash64("headline"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "term", "salt"])
    return met.groupBy("headline").agg(F.collect_list(F.struct("kind", "tf", "idf", "idx")).alias("terms"))


def _entries(terms: Column, run: Column) -> Column:
    """(i, v) of one run, by number: (1 + ln tf) idf, of length 1 for each kind."""
    known = F.filter(terms, lambda t: F.get(t["idx"], run).isNotNull())
    raw = F.transform(known, lambda t: F.struct(
        F.get(t["idx"], run).cast("int").alias("i"), ((F.lit(1.0) + F.ln(t["tf"])) * F.get(t["idf"], run)).alias("v"), t["kind"].alias("kind")))

    def norm(kind: str) -> Column:
        return F.sqrt(F.aggregate(F.filter(raw, lambda t: t["kind"] == kind), F.lit(0.0), lambda a, t: a + t["v"] * t["v"]))

    return F.array_sort(F.transform(raw, lambda t: F.struct(
        t["i"].alias("i"), (t["v"] / F.when(t["kind"] == "word", norm("word")).otherwise(norm("char"))).alias("v"))))


def _vector(entries: Column, size: Column) -> Column:
    """The stored form of a sparse vector."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"),
        F.transform(entries, lambda e: e["i"]).alias("indices"), F.transform(entries, lambda e: e["v"]).alias("values"))


def _read_vectors(df: DataFrame, label: str) -> str:
    path = shared_folder(df.sparkSession, label)
    df.write.partitionBy("run").parquet(path)
    return path


def text_space(pairs: DataFrame) -> TextSpace:
    """Builds and stores the vectors of all runs from a pair table.

    Terms are found once per distinct headline; a run's vocabulary and idf come from its training pairs alone.
    Vectors are put together in the JVM and stored in the form in which Spark reads them as vectors.
    """
    headlines = pairs.select(F.explode(F.array("headline_a", "headline_b")).alias("headline")).distinct()
    counts = cut_lineage(tfidf.term_counts(headlines, ["headline"], "headline"))
    vocabulary = cut_lineage(run_vocabulary(pairs, counts))
    row = vocabulary.agg(*[F.count(F.get("idx", F.lit(r))).alias(f"n{r}") for r in RUNS]).first()
    sizes = {r: row[f"n{r}"] for r in RUNS}
    terms = headlines.join(headline_terms(counts, vocabulary), "headline", "left")
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(sizes[r]).alias("size")) for r in RUNS])
    each = terms.select("headline", F.coalesce("terms", F.array()).alias("terms"), F.inline(runs))
    each = cut_lineage(each.select("run", "size", "headline", _entries(F.col("terms"), F.col("run")).alias("v")))
    stored = _read_vectors(each.select("run", "headline", _vector(F.col("v"), F.col("size")).alias("features")), "headline-vectors")

    def side(s: str) -> DataFrame:
        return each.select("run", "size", F.col("headline").alias(f"headline_{s}"), F.col("v").alias(f"v{s}"))

    met = pairs.join(side("a"), "headline_a").join(side("b").drop("size"), ["run", "headline_b"])

    def by_number(v: str) -> Column:
        return F.map_from_entries(v)

    def of(m: Column, i: Column) -> Column:
        return F.coalesce(F.try_element_at(m, i), F.lit(0.0))

    met = met.withColumns({"ma": by_number("va"), "mb": by_number("vb")})
    numbers = F.array_sort(F.array_union(F.map_keys("ma"), F.map_keys("mb")))
    d = F.filter(F.transform(numbers, lambda i: F.struct(i.alias("i"), (of(F.col("ma"), i) - of(F.col("mb"), i)).alias("v"))), lambda e: e["v"] != 0)
    vectors = met.select("run", "headline_a", "headline_b", "label", "n", "test", _vector(d, F.col("size")).alias("features"))
    return TextSpace(_read_vectors(vectors, "pair-vectors"), stored, sizes)


def _stored(spark, path: str, fields: str, run: int) -> DataFrame:
    schema = T.StructType([*T.StructType.fromDDL(fields), T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(f"{path}/run={run}")


def fit_text_model(spark, space: TextSpace, run: int):
    """The same learner as the baseline's, on differences of TF-IDF vectors of the run's training pairs."""
    rows = _stored(spark, space.pairs, "headline_a string, headline_b string, label long, n long, test array<long>", run)
    rows = rows.select("features", F.col("label").cast("double").alias("y"), train_weight(run).alias("weight")).filter("weight > 0")
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    if not total or not space.sizes[run]:
        raise ValueError("no pairs or no terms to train on")
    model = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=1.0 / (C * 2 * total), maxIter=MAX_ITER, tol=1e-9,
        labelCol="y", weightCol="weight",
    ).fit(rows)
    history = model.summary.objectiveHistory
    if len(history) > MAX_ITER or (len(history) > 1 and abs(history[-2] - history[-1]) > 1e-7 * max(abs(history[-1]), 1e-12)):
        raise ConvergenceError(f"the text model still improved after {len(history) - 1} steps")
    return model


def text_strengths(spark, space: TextSpace, model, run: int) -> DataFrame:
    """(headline, strength): sum of coefficient times weight over the terms of a headline."""
    vectors = _stored(spark, space.headlines, "headline string", run)
    return model.transform(vectors).select("headline", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("strength"))


__all__ = ["TextSpace", "fit_text_model", "run_vocabulary", "test_weight", "text_space", "text_strengths"]
