"""Rule-weighted score: the placeholder engine that needs no trained model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import logistic

# ---- fixed values: rules and weights ------------------------------------------
MEDIAN_CHARS, LONG_MARGIN, SHORT_LIMIT, SLOPE = 54, 26, 22, 1.9
HYPE = "shocking|unbelievable|insane|amazing|epic|mind-blowing|incredible|crazy"
# Word borders count ASCII letters, digits and underscore only.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
NUMBER = START + "[0-9][0-9.,]*(?:(?<=[0-9])(?![A-Za-z0-9_])|(?<=[.,])(?=[A-Za-z0-9_]))"
SECOND_PERSON = f"(?i){START}(you|your|you're|yours){END}"
SHOUT = f"{START}[A-Z]{{3,}}{END}"
MERGE_TAG = "\\{\\{[^}]*\\}\\}|\\*\\|[^|]*\\|\\*"
WEIGHTS = {
    "number": 0.34, "second-person": 0.28, "question": 0.18, "hype": -0.32,
    "exclamation": -0.16, "caps": -0.24, "long": -0.26, "short": -0.12,
}
STATE_ORDER = ["helps", "hurts", "no-effect", "not-measured"]
# ---- end of fixed values --------------------------------------------------------


def rule_terms(text: Column) -> dict[str, Column]:
    """Weight that each rule adds to a line."""
    when = lambda test, name: F.when(test, WEIGHTS[name]).otherwise(F.lit(0.0))
    size = F.char_length(text)
    shouts = F.least(F.regexp_count(text, F.lit("!")), F.lit(3))
    return {
        "number": when(text.rlike(NUMBER), "number"),
        "second-person": when(text.rlike(SECOND_PERSON), "second-person"),
        "question": when(text.contains("?"), "question"),
        "hype": when(text.rlike(f"(?i){START}({HYPE}){END}"), "hype"),
        "exclamation": F.lit(WEIGHTS["exclamation"]) * shouts,
        "caps": when(text.rlike(SHOUT), "caps"),
        "length": F.when(size > MEDIAN_CHARS + LONG_MARGIN, WEIGHTS["long"])
        .when(size < SHORT_LIMIT, WEIGHTS["short"]).otherwise(F.lit(0.0)),
    }


def rule_score(text: Column) -> Column:
    """Sum of the rules, rounded so that equal sums compare equal."""
    total = F.lit(0.0)
    for term in rule_terms(text).values():
        total = total + term
    return F.round(total, 9)


def rule_pair_probability(a: Column, b: Column) -> Column:
    return logistic(F.lit(SLOPE) * (a - b))


def rule_reasons(text: Column) -> Column:
    """Array of (state order, id, state), sorted: helps, hurts, no effect, not measured."""
    entry = lambda test, id_, state: F.when(
        test,
        F.struct(
            F.lit(STATE_ORDER.index(state)).alias("state_order"), F.lit(id_).alias("id"),
            F.lit(state).alias("state"),
        ),
    )
    terms = rule_terms(text)
    found = [
        entry(terms["number"] != 0, "number", "helps"),
        entry(terms["number"] == 0, "number", "no-effect"),
        entry(terms["length"] != 0, "length", "hurts"),
        entry(terms["length"] == 0, "length", "no-effect"),
        entry(text.rlike("[\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1FAFF}]"), "emoji", "not-measured"),
        entry(text.rlike("[^\\p{IsLatin}\\p{IsCommon}\\p{IsInherited}]"), "non-latin", "not-measured"),
        entry(text.rlike(MERGE_TAG), "merge-tag", "not-measured"),
    ]
    for name in ("second-person", "question", "hype", "exclamation", "caps"):
        found.append(entry(terms[name] != 0, name, "helps" if WEIGHTS[name] > 0 else "hurts"))
    return F.array_sort(F.filter(F.array(*found), lambda e: e.isNotNull()))
