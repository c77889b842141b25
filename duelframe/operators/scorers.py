"""What every fitted model offers: probabilities of pairs and a choice for each group of arms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hash_number, logistic
from ..session import cut_lineage
from . import evaluate, vectors
from .learning import predict_trees, select_features
from .ordered import number_within
from .pairs import GROUP

#: Arms of one block: a task scores two blocks against each other.
BLOCK = 32
#: Duels of one task, and the most tasks that score them.
TASK_DUELS, MOST_TASKS = 50_000, 4096
#: Texts up to which the chances of all against all (8 MB) are sent to the arms.
FEW_TEXTS = 1000


class Scorer(Protocol):
    name: str

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Adds ``p`` = P(a beats b) to rows with headline_a and headline_b."""

    def choices(self, arms: DataFrame) -> DataFrame:
        """What the scorer picks in each group (``evaluate.group_choices``)."""


@dataclass(frozen=True)
class StrengthScorer:
    """A model with a strength for each text: p is the logistic of the difference, the pick is the strongest arm."""

    name: str
    strengths: DataFrame  #: headline, strength

    def pairs(self, pairs: DataFrame) -> DataFrame:
        def side(s: str) -> DataFrame:
            return self.strengths.select(F.col("headline").alias(f"headline_{s}"), F.col("strength").alias(f"_s{s}"))

        met = pairs.join(side("a"), "headline_a").join(side("b"), "headline_b")
        return met.withColumn("p", logistic(F.col("_sa") - F.col("_sb"))).drop("_sa", "_sb")

    def choices(self, arms: DataFrame) -> DataFrame:
        # Twelve digits, so that texts of equal strength tie whatever the order of summation.
        rounded = self.strengths.withColumn("strength", F.round("strength", 12))
        return evaluate.group_choices(arms.join(rounded, "headline"))


@dataclass(frozen=True)
class TreeScorer:
    """Boosted trees, known only by p of an ordered pair: an arm's score is its mean p against the others of its group."""

    name: str
    model: Any
    features: list[str] = field(default_factory=list)

    def _score(self, rows: DataFrame) -> DataFrame:
        return predict_trees(select_features(rows, self.features), self.model).drop("d")

    def pairs(self, pairs: DataFrame) -> DataFrame:
        return self._score(vectors.difference_vectors(pairs))

    def choices(self, arms: DataFrame) -> DataFrame:
        """A pair of texts is scored once where texts come again and again, else wherever it meets; the score is the same.

        The work of a group grows with the square of its arms, as the measure does. Scored are the fewer of all pairs of
        distinct texts and all duels (pairs inside the groups).
        """
        arms = cut_lineage(arms)
        texts = arms.select(F.col("headline").alias("headline_a"), F.col("headline").alias("headline_b"))
        known = cut_lineage(vectors.headline_vectors(texts))
        sizes = arms.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
        n_texts, n_duels = known.count(), sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
        scores = self._by_texts(arms, known, n_texts) if n_texts ** 2 <= n_duels else self._by_groups(arms, known, n_duels)
        return evaluate.group_choices(arms.join(scores, [*GROUP, "headline"]))

    def _duels(self, placed: DataFrame, keys: Sequence[str], n_duels: int, own: bool) -> DataFrame:
        """(keys, headline, idx, other, p) of each member of a key against each other one, ``own``: and against itself.

        ``placed``: keys, headline, vector, idx, n_in_key. Members form blocks of BLOCK; each pair of blocks is a row of
        its own, scored where it lies, so a hot key spreads over its pairs of blocks. The number of tasks is given: these
        rows are few bytes and much work, and Spark would gather them by their bytes.
        """
        blocks = placed.groupBy(*keys, F.floor(F.col("idx") / BLOCK).alias("block")).agg(
            F.collect_list(F.struct("headline", "vector", "idx")).alias("members"), F.max("n_in_key").alias("n"))
        blocks = cut_lineage(blocks)
        mine = blocks.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK))))
        met = mine.join(blocks.select(*keys, F.col("block").alias("to"), F.col("members").alias("against")), [*keys, "to"])
        met = met.repartition(min(1 + n_duels // TASK_DUELS, MOST_TASKS), *keys, "block", "to")
        duels = met.select(*keys, "against", F.inline("members")).select(
            *keys, "headline", "idx", F.col("vector").alias("_v"), F.explode("against").alias("_o"))
        duels = duels if own else duels.filter(F.col("_o.headline") != F.col("headline"))
        return self._score(duels.select(
            *keys, "headline", "idx", F.col("_o.idx").alias("other"), F.zip_with("_v", "_o.vector", lambda a, b: a - b).alias("d")))

    def _by_groups(self, arms: DataFrame, known: DataFrame, n_duels: int) -> DataFrame:
        """Strengths of arms from duels scored group by group; sums per arm are combined before they are shuffled."""
        placed = number_within(arms.select(*GROUP, "headline"), list(GROUP), ["headline"], hash_number(F.col("headline")))
        duels = self._duels(placed.join(known, "headline"), GROUP, n_duels, own=False)
        return duels.groupBy(*GROUP, "headline").agg(F.round(F.avg("p"), 12).alias("strength"))

    def _by_texts(self, arms: DataFrame, known: DataFrame, n_texts: int) -> DataFrame:
        """Strengths of arms from one table of all texts against all: a row holds the chances of a text against a block.

        An arm meets one row of it for each block that has arms of its group.
        """
        sent = F.broadcast if n_texts <= FEW_TEXTS else lambda df: df
        placed = cut_lineage(number_within(known.withColumn("all", F.lit(0)), ["all"], ["headline"], hash_number(F.col("headline"))))
        block = lambda c: F.floor(F.col(c) / BLOCK)
        # Numbers are dense, so the place of a text in its block is its place in the list.
        listed = F.array_sort(F.collect_list(F.struct("other", "p")))
        chances = cut_lineage(self._duels(placed, ["all"], n_texts ** 2, own=True).groupBy("idx", block("other").alias("to")).agg(
            F.transform(listed, lambda x: x["p"]).alias("chances")))
        numbers = arms.select(*GROUP, "headline").join(sent(placed.select("headline", "idx")), "headline")
        others = numbers.groupBy(*GROUP, block("idx").alias("to")).agg(F.sort_array(F.collect_list("idx")).alias("others"))
        met = numbers.join(others, list(GROUP)).join(sent(chances), ["idx", "to"])
        met = met.withColumn("others", F.filter("others", lambda o: o != F.col("idx")))
        won = F.aggregate("others", F.lit(0.0), lambda total, o: total + F.get("chances", (o % BLOCK).cast("int")))
        sums = met.groupBy(*GROUP, "headline").agg(F.sum(won).alias("won"), F.sum(F.size("others")).alias("n"))
        return sums.filter("n > 0").select(*GROUP, "headline", F.round(F.col("won") / F.col("n"), 12).alias("strength"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair of a table of texts (headline_a, headline_b, label, n, ...) and its mirror, with ``sign``."""
    others = [c for c in pairs.columns if c not in ("headline_a", "headline_b", "label")]

    def way(a: str, b: str, label, sign: int):
        return F.struct(F.col(a).alias("headline_a"), F.col(b).alias("headline_b"), label.cast("long").alias("label"), F.lit(sign).alias("sign"))

    ways = F.array(way("headline_a", "headline_b", F.col("label"), 1), way("headline_b", "headline_a", 1 - F.col("label"), -1))
    return pairs.select(*others, F.inline(ways))


def holdout_report(scorer: Scorer, pairs: DataFrame, arms: DataFrame) -> DataFrame:
    """One row: how a scorer does on held-out pairs and arms.

    ``pairs``: distinct (headline_a, headline_b, label) with how often each occurs (``n``); ``arms``: those of held-out tests.
    Pairwise measures and calibration over both directions, the largest gap of a bin, selection, lift and the largest
    violation of antisymmetry.
    """
    both = both_ways(pairs.select("headline_a", "headline_b", "label", "n"))
    scored = cut_lineage(scorer.pairs(both).select("headline_a", "headline_b", "label", "n", "sign", "p"))
    tagged = scored.select(F.lit(scorer.name).alias("model"), F.round("p", 12).alias("p"), "label", "n")
    sums = evaluate.score_sums(tagged, ["model"], "n")
    gaps = evaluate.calibration(sums, ["model"]).groupBy("model").agg(F.max("gap").alias("max_calibration_gap"))
    ends = [F.when(F.col("sign") == 1, F.col(a)).otherwise(F.col(b)) for a, b in (("headline_a", "headline_b"), ("headline_b", "headline_a"))]
    met = scored.groupBy(ends[0].alias("a"), ends[1].alias("b"))
    lopsided = met.agg(F.max(F.when(F.col("sign") == 1, F.col("p"))).alias("x"), F.max(F.when(F.col("sign") == -1, F.col("p"))).alias("y"))
    lopsided = lopsided.agg(F.max(F.abs(F.col("x") + F.col("y") - 1.0)).alias("max_violation")).withColumn("model", F.lit(scorer.name))
    choices = cut_lineage(scorer.choices(arms))
    chosen = evaluate.selection(choices).withColumn("model", F.lit(scorer.name))
    lifted = evaluate.lift(choices).drop("n_groups").withColumn("model", F.lit(scorer.name))
    report = evaluate.pairwise_metrics(sums, ["model"]).join(gaps, "model").join(chosen, "model").join(lifted, "model")
    return report.join(lopsided, "model")
