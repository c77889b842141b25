"""Linear pairwise model: weights, strengths, pair probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import FEATURE_SPEC_VERSION
from ..functions.features import FEATURE_NAMES, with_features
from ..functions.stats import logistic

MODEL_FIELDS = ("version", "features", "coef", "scale")


@dataclass(frozen=True)
class LinearModel:
    """Weights in feature order; at most as many as the specification has features."""

    version: str
    features: tuple[str, ...]
    coef: tuple[float, ...]
    scale: tuple[float, ...]
    spec_version: int = FEATURE_SPEC_VERSION
    median_chars: int | None = None
    excluded: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.version or not self.features:
            raise ValueError("a model needs a version and its feature names")
        if not len(self.features) == len(self.coef) == len(self.scale):
            raise ValueError("features, coefficients and scales differ in length")
        if len(set(self.features)) < len(self.features):
            raise ValueError("a feature has several coefficients")
        unknown = [f for f in self.features if f not in FEATURE_NAMES]
        if unknown:
            raise ValueError(f"features the extractor does not know: {unknown}")
        if self.spec_version != FEATURE_SPEC_VERSION:
            raise ValueError(
                f"model uses feature specification {self.spec_version}, extractor {FEATURE_SPEC_VERSION}"
            )

    @property
    def terms(self) -> list[tuple[str, float, float]]:
        """(feature, coef, scale) with a usable scale."""
        return [t for t in zip(self.features, self.coef, self.scale) if t[2]]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.version, i, f, float(c), float(s))
            for i, (f, c, s) in enumerate(zip(self.features, self.coef, self.scale))
        ]
        return spark.createDataFrame(
            rows, "version string, pos int, feature string, coef double, scale double"
        )


def model_from_frame(weights: DataFrame, **extra) -> LinearModel:
    """A model from its weight table (one row per feature of the specification)."""
    rows = weights.orderBy("pos").limit(len(FEATURE_NAMES) + 1).collect()
    if len(rows) > len(FEATURE_NAMES):
        raise ValueError(f"more than {len(FEATURE_NAMES)} coefficients")
    versions = {r["version"] for r in rows}
    if len(versions) != 1:
        raise ValueError(f"expected the weights of one model, found {sorted(versions)}")
    return LinearModel(
        versions.pop(), tuple(r["feature"] for r in rows), tuple(r["coef"] for r in rows),
        tuple(r["scale"] for r in rows), **extra,
    )


# A small hand-made model for demonstrations; trained weights replace it.
HAND_MODEL = LinearModel(
    version="hand-1",
    features=(
        "char_count", "word_count", "mean_word_len", "title_case_ratio", "has_digit", "comma_count",
        "has_question", "demonstrative_count", "wh_word_count", "polarity_sum", "syllable_count",
        "ft_determiner",
    ),
    coef=(-0.45, 0.3, 0.2, 0.15, 0.16, -0.05, 0.3, 0.25, 0.12, -0.05, -0.2, 0.1),
    scale=(18.0, 3.5, 0.75, 0.05, 0.45, 0.85, 0.0, 0.75, 0.75, 0.5, 5.0, 0.55),
)


def strength(model: LinearModel) -> Column:
    """Linear score of one text; P(a beats b) = logistic(strength a - strength b)."""
    total = F.lit(0.0)
    for name, coef, scale in model.terms:
        total = total + F.lit(coef) * F.col(name) / F.lit(scale)
    return total


def with_strength(
    df: DataFrame, model: LinearModel = HAND_MODEL, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` columns and ``strength``; narrow, no shuffle."""
    kept = list(df.columns) if keep is None else list(keep)
    names = [t[0] for t in model.terms]
    return with_features(df, text, kept, names).select(*kept, strength(model).alias("strength"))


def headline_strengths(headlines: DataFrame, model: LinearModel = HAND_MODEL) -> DataFrame:
    """One extraction per distinct headline: (headline, strength)."""
    return with_strength(headlines.select("headline").distinct(), model, "headline")


def predict_pairs(pairs: DataFrame, model: LinearModel = HAND_MODEL) -> DataFrame:
    """Add ``p`` = P(a beats b) and the two strengths."""
    texts = pairs.select(F.explode(F.array("headline_a", "headline_b")).alias("headline"))
    scored = headline_strengths(texts, model)
    side = lambda s: scored.select(
        F.col("headline").alias(f"headline_{s}"), F.col("strength").alias(f"strength_{s}")
    )
    return (
        pairs.join(side("a"), "headline_a").join(side("b"), "headline_b")
        .withColumn("p", logistic(F.col("strength_a") - F.col("strength_b")))
    )
