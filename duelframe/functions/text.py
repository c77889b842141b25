"""Text primitives as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .emoji import ZERO_WIDTH_CLASS

# ---- fixed values: the 25 code points that count as whitespace ----------------
WIDE_SPACES = (
    "\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
WHITESPACE_CLASS = "\\x{9}-\\x{D}\\x{20}" + WIDE_SPACES
TOKEN_CLASS = "\\p{L}\\p{Nd}'’"
# ---- end of fixed values ----------------------------------------------------

def _latin(member) -> str:
    """Members of a class below U+0100, one by one.

    Java tests a listed character with one bitmap lookup, but a range or category
    with a chain of calls.
    """
    return "".join(f"\\x{c:02X}" for c in range(256) if member(chr(c), unicodedata.category(chr(c))))


LATIN = {
    "space": _latin(lambda ch, _: ch in "\t\n\v\f\r \x85\xa0"),
    "odd_space": _latin(lambda ch, _: ch in "\t\n\v\f\r\x85\xa0"),
    "token": _latin(lambda ch, kind: kind[0] == "L" or kind == "Nd" or ch == "'"),
    "upper": _latin(lambda _, kind: kind == "Lu"),
    "cased": _latin(lambda _, kind: kind in ("Lu", "Ll")),
    "digit": _latin(lambda _, kind: kind == "Nd"),
    "a-z": _latin(lambda ch, _: "a" <= ch <= "z"),
}
FULL = {
    "space": WHITESPACE_CLASS,
    "token": TOKEN_CLASS,
    "upper": "\\p{Lu}",
    "cased": "\\p{Lu}\\p{Ll}",
    "digit": "\\p{Nd}",
}


def non_ascii_total(text: Column) -> Column:
    """Code points beyond ASCII; byte and character lengths settle plain text."""
    plain = F.octet_length(text) == F.char_length(text)
    ascii_part = F.regexp_replace(text, "[^\\x00-\\x7F]+", "")
    return F.when(plain, 0).otherwise(F.char_length(text) - F.char_length(ascii_part))


def is_wide(text: Column) -> Column:
    """True where a text leaves Latin-1."""
    return (F.octet_length(text) > F.char_length(text)) & text.rlike("[^\\x00-\\xFF]")


def compose(text: Column) -> Column:
    """Canonical composition (NFC) in the JVM; Latin-1 text is its own composed form.

    Spark ships ICU; ``reflect`` reaches its composer without a Python worker.
    """
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(is_wide(text), composed).otherwise(text)


def collapse_whitespace(text: Column, wide: Column) -> Column:
    latin = F.regexp_replace(text, f"[{LATIN['space']}](?:[{LATIN['space']}]+|(?<=[{LATIN['odd_space']}]))", " ")
    full = F.regexp_replace(text, f"[{FULL['space']}]+", " ")
    return F.trim(F.when(wide, full).otherwise(latin))


def normalise(text: Column) -> Column:
    """Composed form, whitespace runs as one space, trimmed."""
    composed = compose(text)
    return collapse_whitespace(composed, is_wide(composed))


def token_string(text: Column, wide: Column | None = None) -> Column:
    """Tokens of a text joined by single spaces.

    A token is a run of letters, decimal digits and apostrophes without edge
    apostrophes.  One string instead of an array keeps the work in generated code.
    """
    wide = is_wide(text) if wide is None else wide
    runs = F.when(wide, F.regexp_replace(text, f"[^{FULL['token']}]+", " ")).otherwise(
        F.regexp_replace(text, f"[^{LATIN['token']}]+", " ")
    )
    bare = F.regexp_replace(runs, "(?<![^ ])['’]+|['’]+(?![^ ])", "")
    return F.trim(
        F.when(runs.rlike("['’]"), F.regexp_replace(bare, "  +", " ")).otherwise(runs)
    )


def split_tokens(tokens: Column) -> Column:
    return F.when(tokens == "", F.array().cast("array<string>")).otherwise(F.split(tokens, " "))


def tokenise(text: Column) -> Column:
    return split_tokens(token_string(text))


def fold(tokens: Column) -> Column:
    """Lower case with straight apostrophes, for one token or a token string."""
    return F.replace(F.lower(tokens), F.lit("’"), F.lit("'"))


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ZERO_WIDTH_CLASS}]", "")


def count_class(text: Column, chars: str) -> Column:
    """Code points of a text inside a character class."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def count_kind(text: Column, kind: str, wide: Column) -> Column:
    return F.when(wide, count_class(text, FULL[kind])).otherwise(count_class(text, LATIN[kind]))


# One syllable: a vowel group, or a whole token without one that is heard. A final group that ends in "e" is silent unless
# the token ends in "le". Possessive loops and looks of fixed width: no place of a token is tried twice.
_SYLLABLE = "[aeiouy]++(?:(?=[^ ])|(?<!e)|(?<=le))|(?<![^ ])[^aeiouy ]*+(?:[aeiouy]++(?<=e)(?<!le))?+(?![^ ])"


def syllable_string(folded: Column) -> Column:
    """A folded token string with an ``A`` for each syllable, among consonants.

    Only a-z count.  A final vowel group that ends in ``e`` is silent unless the
    token ends in ``le``; every token has at least one syllable, so one without
    letters becomes one ``A``.
    """
    letters = F.regexp_replace(folded, f"[^{LATIN['a-z']} ]+", "")
    return F.when(folded == "", "").otherwise(F.regexp_replace(letters, _SYLLABLE, "A"))


def syllable_total(marks: Column) -> Column:
    return F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit("A"), F.lit("")))


def long_word_total(marks: Column) -> Column:
    """Tokens of three or more syllables."""
    return F.regexp_count(marks, F.lit("A[^A ]*+A[^A ]*+A[^ ]*+"))


def syllables(token: Column) -> Column:
    return syllable_total(syllable_string(fold(token)))


@lru_cache(maxsize=1)
def _digit_table() -> tuple[str, str]:
    """All decimal digits of all scripts with their values."""
    zeros = [
        c for c in range(0x110000)
        if unicodedata.category(chr(c)) == "Nd" and unicodedata.digit(chr(c)) == 0
    ]
    digits = "".join(chr(zero + k) for zero in zeros for k in range(10))
    return digits, "0123456789" * len(zeros)


def ascii_digits(text: Column) -> Column:
    digits, values = _digit_table()
    return F.translate(text, digits, values)


def override_categories(text: Column, overrides: dict[str, str] | None = None) -> Column:
    """Replace characters whose class is contested; the table is empty by default."""
    if not overrides:
        return text
    return F.translate(text, "".join(overrides), "".join(overrides.values()))


def ordinal(n: Column) -> Column:
    # ---- fixed values: the product only names five places --------------------
    return (
        F.when(n == 1, "1st").when(n == 2, "2nd").when(n == 3, "3rd")
        .otherwise(F.concat(n.cast("string"), F.lit("th")))
    )


def ordinal_range(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, ordinal(lo)).otherwise(F.concat(ordinal(lo), F.lit("–"), ordinal(hi)))


def sentences(text: Column) -> Column:
    """All sentences of a text, each with its closing punctuation, blanks left out."""
    parts = F.regexp_extract_all(text, F.lit("[^.!?\\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
