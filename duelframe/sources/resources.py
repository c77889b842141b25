"""Small JSON resources: lexicons, text corpus, model metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import Lexicons
from ..operators.scoring import LinearModel

MAX_WORDS = 100000


def load_lexicons(lexicon: DataFrame, negation_window: int = 3) -> Lexicons:
    """Word lists from a table (category, word, score); a specification has few words."""
    rows = lexicon.select("category", "word", "score").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a lexicon of more than {MAX_WORDS} words is not a specification")
    words = lambda name: [r["word"] for r in rows if r["category"] == name]
    polarity: dict[float, list[str]] = {}
    for r in rows:
        if r["category"] == "polarity":
            polarity.setdefault(float(r["score"]), []).append(r["word"])
    openers = sorted({r["category"] for r in rows if r["category"].startswith("ft_")})
    order = ["ft_wh", "ft_determiner", "ft_pronoun", "ft_auxiliary", "ft_preposition", "ft_verb_common"]
    return Lexicons(
        second=words("second"), first_sing=words("first_sing"), first_plur=words("first_plur"),
        third=words("third"), demonstratives=words("demonstratives"), wh_words=words("wh_words"),
        intensifiers=words("intensifiers"), superlatives=words("superlatives"), polarity=polarity,
        negators=words("negators"), negation_window=negation_window,
        first_token={c.removeprefix("ft_"): words(c) for c in sorted(openers, key=order.index)},
    )


def lexicon_frame(spark: SparkSession, lex: Lexicons) -> DataFrame:
    """The lists as a table (category, word, score)."""
    rows = [(n, w, None) for n in (
        "second", "first_sing", "first_plur", "third", "demonstratives", "wh_words", "intensifiers",
        "superlatives", "negators",
    ) for w in getattr(lex, n)]
    rows += [("polarity", w, s) for s, words in lex.polarity.items() for w in words]
    rows += [(f"ft_{c}", w, None) for c, words in lex.first_token.items() for w in words]
    return spark.createDataFrame(rows, "category string, word string, score double")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, why) of a corpus document with an ``entries`` list."""
    schema = "entries array<struct<text:string,why:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("entries"))


def read_model(spark: SparkSession, path: str) -> LinearModel:
    """A linear model from its metadata document; refused when it cannot be identified."""
    schema = (
        "version string, feature_spec_version int, feature_names array<string>, coefficients array<double>, "
        "scale array<double>, excluded_features array<string>, training_char_median int"
    )
    m = spark.read.schema(schema).json(path, multiLine=True).first()
    if m is None or not m["version"] or not m["feature_names"] or m["feature_spec_version"] is None:
        raise ValueError(f"{path} does not identify a model")
    if not m["coefficients"] or not m["scale"]:
        raise ValueError(f"{path} carries no coefficients")
    return LinearModel(
        m["version"], tuple(m["feature_names"]), tuple(m["coefficients"]), tuple(m["scale"]),
        spec_version=m["feature_spec_version"], median_chars=m["training_char_median"],
        excluded=tuple(m["excluded_features"] or ()),
    )


def write_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    row = [(
        model.version, model.spec_version, list(model.features), list(model.coef), list(model.scale),
        list(model.excluded), model.median_chars,
    )]
    schema = (
        "version string, feature_spec_version int, feature_names array<string>, coefficients array<double>, "
        "scale array<double>, excluded_features array<string>, training_char_median int"
    )
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").json(path)
