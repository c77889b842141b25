"""Why a line ranks where it does: contributions against the other lines of its set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import EMOJI_FEATURES, with_features
from ..functions.lexicons import DEFAULT_LEXICONS, Lexicons
from ..functions.phrases import FALLBACK, NO_ATTRIBUTION, NOT_MEASURED, PHRASES
from ..functions.spans import folded, spans_of
from .ranking import SET, split_requests
from .scoring import HAND_MODEL, LinearModel

TOP_REASONS = 3
MIN_DIFFERENCE, MIN_CONTRIBUTION = 1e-12, 1e-9


def phrase(feature: str, delta: Column, mine: Column) -> Column:
    """Wording follows the difference, not the verdict."""
    more, less = PHRASES.get(feature, FALLBACK)
    text = F.when(delta > 0, more).otherwise(less)
    if feature == "char_count":
        text = F.concat(F.floor(mine + 0.5).cast("string"), F.lit(" characters — "), text)
    return text


def notes(lines: DataFrame, model: LinearModel = HAND_MODEL) -> DataFrame:
    """Accepted lines with ``notes``: all reasons of the line, strongest first.

    The mean of the other lines comes from window sums over the set (one shuffle);
    everything after that is per row.
    """
    names = [t[0] for t in model.terms]
    extra = [n for n in ("has_emoji", "emoji_count") if n not in names]
    featured = with_features(split_requests(lines), "text", [SET, "position", "text"], names + extra)
    over_set = Window.partitionBy(SET)
    n = F.count(F.lit(1)).over(over_set)
    summed = featured.withColumns({f"_sum_{f}": F.sum(f).over(over_set) for f in names} | {"_n": n})
    theirs = {
        f: F.when(F.col("_n") > 1, (F.col(f"_sum_{f}") - F.col(f)) / (F.col("_n") - 1)).otherwise(0.0)
        for f in names
    }
    staged = summed.withColumns({f"_theirs_{f}": c for f, c in theirs.items()})
    staged = staged.withColumns({f"_delta_{f}": F.col(f) - F.col(f"_theirs_{f}") for f in names})
    staged = staged.withColumns({
        f"_gain_{f}": F.lit(coef) * F.col(f"_delta_{f}") / F.lit(scale) for f, coef, scale in model.terms
    })
    entries = []
    for pos, name in enumerate(names):
        delta, gain, mine = F.col(f"_delta_{name}"), F.col(f"_gain_{name}"), F.col(name)
        seen = (F.abs(delta) >= MIN_DIFFERENCE) & (F.abs(gain) >= MIN_CONTRIBUTION)
        kind = F.when(gain > 0, "helps").otherwise("hurts")
        entries.append(F.when(seen, _note(
            -F.round(F.abs(gain), 12), pos, name, kind, gain, mine, F.col(f"_theirs_{name}"), phrase(name, delta, mine)
        )))
    found = F.array_sort(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return staged.select(SET, "position", "text", "has_emoji", "emoji_count", found.alias("notes"))


def _note(order: Column, pos: int, feature: str, kind, contribution, mine, theirs, text) -> Column:
    return F.struct(
        order.alias("order"), F.lit(pos).alias("pos"), F.lit(feature).alias("feature"), kind.alias("kind"),
        contribution.alias("contribution"), mine.alias("mine"), theirs.alias("theirs"), text.alias("text"),
    )


def attribution(noted: DataFrame) -> DataFrame:
    """One row per line and feature that says something.

    The outer form keeps Spark from testing the size of ``notes`` before the
    explode, which would work out every note twice.
    """
    rows = noted.select(SET, "position", F.posexplode_outer("notes").alias("place", "note"))
    return rows.filter(F.col("note").isNotNull()).select(
        SET, "position", (F.col("place") + 1).cast("long").alias("place"),
        *[f"note.{c}" for c in ("feature", "kind", "contribution", "mine", "theirs", "text")],
    )


def top_reasons(noted: DataFrame, model: LinearModel = HAND_MODEL, limit: int = TOP_REASONS) -> DataFrame:
    """The strongest reasons of a line, and the emoji note when the model has no view on them."""
    best = F.slice("notes", 1, limit)
    if not any(f in model.features for f in EMOJI_FEATURES):
        missing = F.lit(None).cast("double")
        silent = _note(
            F.lit(0.0), len(model.features), "has_emoji", F.lit("not-measured"), F.lit(0.0), missing, missing,
            F.lit(NOT_MEASURED),
        )
        has_emoji = (F.col("has_emoji") > 0) | (F.col("emoji_count") > 0)
        best = F.when(has_emoji, F.concat(best, F.array(silent))).otherwise(best)
    return attribution(noted.withColumn("notes", best))


def no_attribution(lines: DataFrame) -> DataFrame:
    """The single note of a model without coefficients."""
    return lines.select(
        SET, "position", F.lit("__no_attribution__").alias("feature"),
        F.lit("no-effect").alias("kind"), F.lit(0.0).alias("contribution"),
        F.lit(NO_ATTRIBUTION).alias("text"),
    )


# ---- fixed values: decoration skipped before the terminal mark ------------------
_TRAILING = "[\\x{1F000}-\\x{10FFFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0E}\\x{FE0F}\\x{200B}-\\x{200D}\\x{FEFF} ]+$"
# ---- end of fixed values --------------------------------------------------------


def note_kinds(noted: DataFrame) -> DataFrame:
    """Adds ``kinds``: feature -> helps or hurts, of all notes of a line."""
    said = F.filter("notes", lambda n: n["kind"].isin("helps", "hurts"))
    return noted.withColumn("kinds", F.map_from_entries(F.transform(said, lambda n: F.struct(n["feature"], n["kind"]))))


def marked_lines(noted: DataFrame, lex: Lexicons = DEFAULT_LEXICONS) -> DataFrame:
    """``mark_spans`` of lines with ``text`` and ``kinds``, one row per mark: set, position and the mark's fields.

    Tokens are looked for only in lines of which a note speaks of words and which hold such a word. The outer form keeps Spark
    from testing the size of ``marks`` before the explode, which would work out notes and marks once more for each time
    that the test names them.
    """
    words = sorted({*lex.second, *lex.demonstratives})
    spoken = F.arrays_overlap(F.map_keys("kinds"), F.lit(["second_person_count", "leading_demonstrative", "demonstrative_count"]))
    held = folded(F.col("text")).rlike("|".join(rf"\Q{w}\E" for w in words))
    spans = noted.withColumn("tokens", F.when(spoken & held, spans_of(F.col("text"), words)))
    rows = mark_spans(spans, "kinds", lex).select(SET, "position", F.inline_outer("marks"))
    return rows.filter(F.col("label").isNotNull())


def mark_spans(spans: DataFrame, kinds: dict[str, str] | str, lex: Lexicons = DEFAULT_LEXICONS) -> DataFrame:
    """Non-overlapping marks on a line.

    ``spans``: columns ``text`` and ``tokens`` (array of token, start, end in code points).  ``kinds`` maps a feature
    that the notes mention to helps or hurts; a name is a column with such a map for each line. A terminal mark needs
    the punctuation itself; of an opener two features may speak, the leading one first.
    """
    def of(feature: str) -> Column:
        if isinstance(kinds, str):
            return F.try_element_at(F.col(kinds), F.lit(feature))
        return F.lit(kinds.get(feature)).cast("string")

    def mark(start: Column, end: Column, label: str, feature: Column, kind: Column) -> Column:
        return F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(label).alias("label"),
            feature.alias("feature"), kind.alias("kind"))

    none = F.array().cast("array<struct<start:int,end:int,label:string,feature:string,kind:string>>")
    second = F.when(of("second_person_count").isNotNull(), F.transform(
        F.filter("tokens", lambda s: folded(s["token"]).isin(*lex.second)),
        lambda s: mark(s["start"], s["end"], "second person", F.lit("second_person_count"), of("second_person_count"))))
    leads = of("leading_demonstrative").isNotNull()
    opener = F.when(leads, F.lit("leading_demonstrative")).otherwise(F.lit("demonstrative_count"))
    opener_kind = F.when(leads, of("leading_demonstrative")).otherwise(of("demonstrative_count"))
    first = F.when(opener_kind.isNotNull(), F.transform(
        F.filter(F.slice("tokens", 1, 1), lambda s: folded(s["token"]).isin(*lex.demonstratives)),
        lambda s: mark(s["start"], s["end"], "demonstrative", opener, opener_kind)))
    bare = F.regexp_replace("text", _TRAILING, "")
    size = F.char_length(bare)
    width = F.when(bare.endswith("..."), 3).otherwise(1)
    ends = F.coalesce(*(
        F.when(of(feature).isNotNull() & bare.rlike(pattern), F.array(mark(size - width, size, "terminal punctuation", F.lit(feature), of(feature))))
        for feature, pattern in (("ends_question", "[?？]$"), ("ends_exclamation", "[!！]$"), ("ends_ellipsis", "(…|\\.\\.\\.)$"))
    ))
    ordered = F.array_sort(F.concat(*(F.coalesce(part, none) for part in (second, first, ends))))
    kept = F.aggregate(
        ordered, none,
        lambda acc, m: F.when(
            (F.size(acc) == 0) | (m["start"] >= F.element_at(acc, -1)["end"]),
            F.concat(acc, F.array(m)),
        ).otherwise(acc),
    )
    return spans.withColumn("marks", kept)
