"""Features of awkward texts against a slow checker written per character."""

import unicodedata

import pytest

from duelframe.functions.features import FEATURE_NAMES, with_features
from duelframe.functions.lexicons import DEFAULT_LEXICONS as LEX

TEXTS = [
    "", "   ", "　　wide　 space　", "Caf\u00e9 ol\u00e9", "Cafe\u0301 ole\u0301",
    "You're ‘not’ going to love this", "don’t don't", "'' ' quote'd ''",
    "not good", "not very good", "not so very good", "not so very truly good", "never ever bad",
    "9 things", "2015 was great", "00012 apples", "١٢ arabic digits", "x² squared", "12345678901234567890 big",
    "İstanbul ΟΣ Σ", "Wow \U0001F389\U0001F389", "\U0001F468‍\U0001F469‍\U0001F467 family",
    "\U0001F1EB\U0001F1F7 flag", "\U0001F1EB lone", "\U0001F44D\U0001F3FD tone", "1️⃣ key", "Really?? \U0001F389", "\U0001F389 party?!",
    "a" * 10000, "​‌﻿", "What...", "Wait… \U0001F600", "THE BEST DEAL Ever!", "He said “hi” — then left",
    "This is what the people made; little table, eye, the, e, rhythm, 123", "one two three\x85four\xa0five",
    "！？ full width？", "ά oxia", "Àéÿ µ ª", "tab\t\tnew\nline\r\nend",
    "Discover how we never lose: simple, easy, free", "is it?", "A/B test_ing under_score", "你好 world",
]

WS = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def normal(text):
    spaced = "".join(" " if ord(c) in WS else c for c in unicodedata.normalize("NFC", text))
    return " ".join(p for p in spaced.split(" ") if p)


def tokens(text):
    joined = "".join(
        c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c in "'’" else " " for c in text
    )
    return [t for t in (w.strip("'’") for w in joined.split(" ")) if t]


def vowel_groups(word):
    letters = [c for c in word if "a" <= c <= "z"]
    flags = [c in "aeiouy" for c in letters]
    groups = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
    end = "".join(letters)
    return max(1, groups - (end.endswith("e") and not end.endswith("le") and groups > 1))


@pytest.fixture(scope="module")
def found(spark):
    rows = with_features(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), "text", ["id"]).collect()
    return {r["id"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_counts(found, i):
    text, row = normal(TEXTS[i]), found[i]
    tok = tokens(text)
    low = [t.lower().replace("’", "'") for t in tok]
    chars = [c for c in text if ord(c) not in (0x200B, 0x200C, 0x200D, 0xFEFF)]
    cat = [unicodedata.category(c) for c in chars]
    syl = [vowel_groups(w) for w in low]
    assert row["char_count"] == len(chars)
    assert row["word_count"] == len(tok)
    assert row["max_word_len"] == max(map(len, tok), default=0)
    assert row["mean_word_len"] == pytest.approx(sum(map(len, tok)) / len(tok) if tok else 0, abs=1e-9)
    assert row["syllable_count"] == sum(syl)
    assert row["long_word_ratio"] == pytest.approx(sum(s > 2 for s in syl) / len(tok) if tok else 0, abs=1e-9)
    assert row["digit_count"] == cat.count("Nd")
    cased = cat.count("Lu") + cat.count("Ll")
    assert row["upper_char_ratio"] == pytest.approx(cat.count("Lu") / cased if cased else 0, abs=1e-9)
    assert row["non_ascii_ratio"] == pytest.approx(sum(ord(c) > 127 for c in chars) / len(chars) if chars else 0, abs=1e-9)
    kinds = [[unicodedata.category(c) for c in t] for t in tok]
    assert row["allcaps_word_count"] == sum(k.count("Lu") > 1 and "Ll" not in k for k in kinds)
    assert row["title_case_ratio"] == pytest.approx(sum(k[0] == "Lu" for k in kinds) / len(tok) if tok else 0, abs=1e-9)
    assert row["second_person_count"] == sum(w in LEX.second for w in low)
    score = 0.0
    for at, w in enumerate(low):
        value = next((s for s, words in LEX.polarity.items() if w in words), 0.0)
        flip = any(n in LEX.negators for n in low[max(0, at - 3):at])
        score += -value if flip else value
    assert row["polarity_sum"] == pytest.approx(score, abs=1e-9)
    openers = [row[n] for n in FEATURE_NAMES if n.startswith("ft_")]
    assert sum(openers) == (1 if tok else 0)
    assert all(row[n] is not None and abs(row[n]) < 1e9 for n in FEATURE_NAMES)


def by_text(found, text):
    return found[TEXTS.index(text)]


def test_empty_is_all_zero(found):
    for text in ("", "   "):
        assert not any(by_text(found, text)[n] for n in FEATURE_NAMES)


def test_composition_does_not_matter(found):
    a, b = by_text(found, "Caf\u00e9 ol\u00e9"), by_text(found, "Cafe\u0301 ole\u0301")
    assert [a[n] for n in FEATURE_NAMES] == [b[n] for n in FEATURE_NAMES]


@pytest.mark.parametrize(("text", "n"), [
    ("Wow \U0001F389\U0001F389", 2), ("\U0001F468‍\U0001F469‍\U0001F467 family", 1), ("\U0001F1EB\U0001F1F7 flag", 1),
    ("\U0001F1EB lone", 1), ("\U0001F44D\U0001F3FD tone", 1),
])
def test_emoji_clusters(found, text, n):
    assert by_text(found, text)["emoji_count"] == n


def test_terminal_mark_behind_emoji(found):
    row = by_text(found, "Really?? \U0001F389")
    assert (row["ends_question"], row["emoji_trailing"], row["emoji_leading"]) == (1, 1, 0)
    assert by_text(found, "Wait… \U0001F600")["ends_ellipsis"] == 1


@pytest.mark.parametrize(("text", "value"), [
    ("9 things", 9), ("2015 was great", 1000), ("00012 apples", 12), ("١٢ arabic digits", 12),
    ("12345678901234567890 big", 1000), ("x² squared", 0),
])
def test_leading_number(found, text, value):
    assert by_text(found, text)["leading_number_magnitude"] == value
