"""The 52 numeric features of a short text, as Catalyst expressions.

``with_features`` is a narrow transformation: no shuffle and no Python worker.
Intermediate arrays (tokens, folded tokens, syllables) are built once per row in
their own projections, so the 52 outputs share them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .emoji import CLUSTER, DECORATION_CLASS
from .lexicons import DEFAULT_LEXICONS, Lexicons

# ---- fixed values: names and order of the feature vector ----------------------
FEATURE_NAMES = (
    "char_count word_count mean_word_len max_word_len long_word_ratio upper_char_ratio "
    "allcaps_word_count title_case_ratio has_digit digit_count starts_with_digit "
    "leading_number_magnitude has_question has_exclamation exclamation_count has_ellipsis "
    "comma_count has_colon has_quote has_dash ends_question ends_exclamation ends_ellipsis "
    "second_person_count first_person_sing_count first_person_plur_count third_person_count "
    "demonstrative_count wh_word_count intensifier_count superlative_count "
    "leading_demonstrative has_emoji emoji_count emoji_leading emoji_trailing polarity_sum "
    "polarity_abs_sum polarity_pos_count polarity_neg_count syllable_count "
    "mean_syllables_per_word flesch_reading_ease ft_determiner ft_wh ft_pronoun "
    "ft_preposition ft_auxiliary ft_numeral ft_verb_common ft_other non_ascii_ratio"
).split()
EMOJI_FEATURES = "has_emoji emoji_count emoji_leading emoji_trailing".split()
MAX_LEADING_NUMBER = 1000
# ---- end of fixed values ------------------------------------------------------

# Columns that hold outcomes or identities; no feature name may contain one.
BANNED = (
    "impressions clicks winner first_place significance eyecatcher_id clickability_test_id"
).split()


def banned_features(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(b in n for b in BANNED)]


def require_clean_features(names: Sequence[str]) -> None:
    found = banned_features(names)
    if found:
        raise ValueError(f"outcome columns used as features: {found}")


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _listed(words: Sequence[str]) -> str:
    quoted = ["'" + w.replace("'", "\\'") + "'" for w in words]
    return "(" + ", ".join(quoted) + ")"


def _members(tokens: str, words: Sequence[str]) -> Column:
    return F.expr(f"cast(size(filter({tokens}, w -> w in {_listed(words)})) as double)")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _polarity_scores(lex: Lexicons) -> Column:
    """Score per token; the sign flips when a negator stands shortly before it."""
    window = lex.negation_window
    negated = (
        f"exists(slice(_low, greatest(i - {window - 1}, 1), least(i, {window})), "
        f"n -> n in {_listed(lex.negators)})"
    )
    cases = " ".join(
        f"when w in {_listed(words)} then if({negated}, {-value}D, {value}D)"
        for value, words in lex.polarity.items()
    )
    return F.expr(f"transform(_low, (w, i) -> case {cases} else 0D end)")


def _leading_number(first_token: Column) -> Column:
    digits = F.regexp_replace(T.ascii_digits(first_token), "^0+", "")
    return F.when(F.length(digits) > 4, F.lit(float(MAX_LEADING_NUMBER))).otherwise(
        F.least(
            F.coalesce(digits.try_cast("double"), F.lit(0.0)), F.lit(float(MAX_LEADING_NUMBER))
        )
    )


def _all_words(lex: Lexicons) -> list[str]:
    lists = [
        lex.second, lex.first_sing, lex.first_plur, lex.third, lex.demonstratives,
        lex.wh_words, lex.intensifiers, lex.superlatives, *lex.polarity.values(),
    ]
    return sorted({w for words in lists for w in words})


def with_tokens(
    df: DataFrame,
    text: str = "text",
    overrides: dict[str, str] | None = None,
    lex: Lexicons = DEFAULT_LEXICONS,
) -> DataFrame:
    """Add the normalised text ``_t`` and what the features read from it.

    ``_wide`` marks text beyond Latin-1; only that can hold emoji or
    zero-width characters, so the wide patterns run on few rows.
    """
    staged = df.withColumn("_raw", T.override_categories(T.compose(F.col(text)), overrides))
    staged = staged.withColumn("_wide", T.is_wide(F.col("_raw")))
    staged = staged.withColumn("_t", T.collapse_whitespace(F.col("_raw"), F.col("_wide")))
    wide, t = F.col("_wide"), F.col("_t")
    staged = staged.withColumns(
        {
            "_chars": F.when(wide, T.without_zero_width(t)).otherwise(t),
            "_tail": F.when(wide, F.regexp_replace(t, f"[{DECORATION_CLASS} ]+$", "")).otherwise(t),
            "_emoji": F.when(wide, F.regexp_count(t, F.lit(CLUSTER))).otherwise(0),
            "_toks": T.token_string(t, wide),
        }
    )
    staged = staged.withColumn("_lows", T.fold(F.col("_toks")))
    staged = staged.withColumns(
        {"_low": T.split_tokens(F.col("_lows")), "_syl": T.syllable_string(F.col("_lows"))}
    )
    listed = _all_words(lex)
    return staged.withColumn("_hits", F.expr(f"filter(_low, w -> w in {_listed(listed)})"))


def with_polarity(df: DataFrame, lex: Lexicons = DEFAULT_LEXICONS) -> DataFrame:
    polar = sorted({w for words in lex.polarity.values() for w in words})
    found = F.expr(f"exists(_hits, w -> w in {_listed(polar)})")
    scores = F.when(found, _polarity_scores(lex))
    return df.withColumn("_pol", F.coalesce(scores, F.array().cast("array<double>")))


def feature_columns(lex: Lexicons = DEFAULT_LEXICONS) -> dict[str, Column]:
    """The 52 expressions over the columns of ``with_tokens`` and ``with_polarity``."""
    t, chars, tail, wide = F.col("_t"), F.col("_chars"), F.col("_tail"), F.col("_wide")
    toks, low, pol = F.col("_toks"), F.col("_low"), F.col("_pol")
    n_tok = F.size(low).cast("double")
    n_chars = F.char_length(chars).cast("double")
    n_syl = T.syllable_total(F.col("_syl")).cast("double")
    letters = F.char_length(toks) - F.greatest(F.size(low) - 1, F.lit(0))
    lengths = F.transform(F.split(toks, " "), F.char_length)
    uppers = T.count_kind(chars, "upper", wide).cast("double")
    cased = T.count_kind(chars, "cased", wide).cast("double")
    digits = T.count_kind(chars, "digit", wide).cast("double")
    first = F.substring_index(toks, " ", 1)
    numeral = first.rlike("^\\p{Nd}+$")
    exclamations = T.count_class(t, "!！").cast("double")
    emoji = F.col("_emoji").cast("double")
    n_sentences = F.greatest(_count(t, "[.!?]+"), F.lit(1.0))
    flesch = F.lit(206.835) - F.lit(1.015) * (n_tok / n_sentences) - F.lit(84.6) * (n_syl / n_tok)
    capitals = (
        "(?<![^ ])[^\\p{Lu}\\p{Ll} ]*+\\p{Lu}[^\\p{Lu}\\p{Ll} ]*+\\p{Lu}[^\\p{Ll} ]*+(?![^ ])"
    )

    opener = F.when(numeral, "numeral")
    for name, words in lex.first_token.items():
        opener = opener.when(F.expr(f"substring_index(_lows, ' ', 1) in {_listed(words)}"), name)
    opener = F.when(n_tok > 0, opener.otherwise("other"))

    out = {
        "char_count": n_chars,
        "word_count": n_tok,
        "mean_word_len": _ratio(letters, n_tok),
        "max_word_len": F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"),
        "long_word_ratio": _ratio(T.long_word_total(F.col("_syl")), n_tok),
        "upper_char_ratio": _ratio(uppers, cased),
        "allcaps_word_count": _count(toks, capitals),
        "title_case_ratio": _ratio(_count(toks, "(?<![^ ])\\p{Lu}"), n_tok),
        "has_digit": _flag(digits > 0),
        "digit_count": digits,
        "starts_with_digit": _flag(numeral),
        "leading_number_magnitude": F.when(numeral, _leading_number(first)).otherwise(0.0),
        "has_question": _flag(t.contains("?") | t.contains("？")),
        "has_exclamation": _flag(exclamations > 0),
        "exclamation_count": exclamations,
        "has_ellipsis": _flag(t.contains("…") | t.contains("...")),
        "comma_count": T.count_class(t, ",，").cast("double"),
        "has_colon": _flag(t.contains(":")),
        "has_quote": _flag(t.rlike("[\"'‘’“”]")),
        "has_dash": _flag(t.rlike("[-–—]")),
        "ends_question": _flag(tail.endswith("?") | tail.endswith("？")),
        "ends_exclamation": _flag(tail.endswith("!") | tail.endswith("！")),
        "ends_ellipsis": _flag(tail.endswith("…") | tail.endswith("...")),
        "second_person_count": _members("_hits", lex.second),
        "first_person_sing_count": _members("_hits", lex.first_sing),
        "first_person_plur_count": _members("_hits", lex.first_plur),
        "third_person_count": _members("_hits", lex.third),
        "demonstrative_count": _members("_hits", lex.demonstratives),
        "wh_word_count": _members("_hits", lex.wh_words),
        "intensifier_count": _members("_hits", lex.intensifiers),
        "superlative_count": _members("_hits", lex.superlatives),
        "leading_demonstrative": _flag(
            F.expr(f"exists(slice(_low, 1, 3), w -> w in {_listed(lex.demonstratives)})")
        ),
        "has_emoji": _flag(emoji > 0),
        "emoji_count": emoji,
        "emoji_leading": _flag(wide & t.rlike(f"^{CLUSTER}")),
        "emoji_trailing": _flag(wide & t.rlike(f"{CLUSTER}$")),
        "polarity_sum": _total(pol),
        "polarity_abs_sum": _total(F.transform(pol, F.abs)),
        "polarity_pos_count": F.size(F.filter(pol, lambda s: s > 0)).cast("double"),
        "polarity_neg_count": F.size(F.filter(pol, lambda s: s < 0)).cast("double"),
        "syllable_count": n_syl,
        "mean_syllables_per_word": _ratio(n_syl, n_tok),
        "flesch_reading_ease": F.when(
            n_tok > 0, F.greatest(F.lit(-100.0), F.least(F.lit(150.0), flesch))
        ).otherwise(F.lit(0.0)),
        "non_ascii_ratio": _ratio(T.non_ascii_total(chars), n_chars),
    }
    for name in [f for f in FEATURE_NAMES if f.startswith("ft_")]:
        out[name] = F.coalesce(_flag(opener == name.removeprefix("ft_")), F.lit(0.0))
    return {name: out[name].alias(name) for name in FEATURE_NAMES}


def with_features(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    names: Sequence[str] = FEATURE_NAMES,
    lex: Lexicons = DEFAULT_LEXICONS,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """``keep`` columns (default: all) followed by the features in ``names``.

    The extractor sees one string only.  Features that are not asked for are not
    computed.
    """
    require_clean_features(names)
    kept = list(df.columns) if keep is None else list(keep)
    staged = with_polarity(with_tokens(df, text, overrides, lex), lex)
    columns = feature_columns(lex)
    return staged.select(*kept, *[columns[n] for n in names])


def feature_vector(names: Sequence[str] = FEATURE_NAMES) -> Column:
    return F.array(*[F.col(n) for n in names])


def feature_map(names: Sequence[str] = FEATURE_NAMES) -> Column:
    """Named map for storage: rows outlive the order of the specification."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), feature_vector(names))


def require_finite(names: Sequence[str] = FEATURE_NAMES) -> Column:
    """True per row, or the job fails naming the problem."""
    bad = F.exists(feature_vector(names), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("non-finite feature"))).otherwise(F.lit(True))


def long_features(
    df: DataFrame, keys: Sequence[str], names: Sequence[str] = FEATURE_NAMES
) -> DataFrame:
    """One row per (keys, feature): ``pos``, ``feature``, ``value``."""
    entries = [
        F.struct(F.lit(i).cast("long").alias("pos"), F.lit(n).alias("feature"), F.col(n).alias("value"))
        for i, n in enumerate(names)
    ]
    return df.select(*keys, F.inline(F.array(*entries)))
