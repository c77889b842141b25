"""Oracle SQL (DuckDB) for text features; formulas written independently, token by token."""

from ..functions.emoji import CLUSTER, DECORATION_CLASS, ZERO_WIDTH_CLASS
from ..functions.features import FEATURE_NAMES
from ..functions.lexicons import DEFAULT_LEXICONS as LEX
from ..functions.text import WHITESPACE_CLASS
from .oracle_pairs import PAIRS


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _count(text: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"len(regexp_extract_all({text}, '{pattern}'))::DOUBLE"


def _members(words) -> str:
    return f"len(list_filter(low, lambda w: list_contains({_list(words)}, w)))::DOUBLE"


def _ratio(a: str, b: str) -> str:
    return f"case when {b} > 0 then ({a}) / {b} else 0 end"


_POS, _NEG = LEX.polarity[0.6], LEX.polarity[-0.6]


def features_ctes(source: str, keys: str, name: str = "features", digits: int | None = 6) -> str:
    """CTEs ending in ``name``: keys and the 52 features of ``source.text``."""
    openers = " ".join(
        f"when list_contains({_list(words)}, low[1]) then '{k}'" for k, words in LEX.first_token.items()
    )
    cols = {
        "char_count": "C", "word_count": "L",
        "mean_word_len": _ratio("list_sum(list_transform(tok, lambda w: length(w)))", "L"),
        "max_word_len": "coalesce(list_max(list_transform(tok, lambda w: length(w))), 0)::DOUBLE",
        "long_word_ratio": _ratio("len(list_filter(syl, lambda s: s >= 3))", "L"),
        "upper_char_ratio": _ratio(_count("ch", "\\p{Lu}"), _count("ch", "[\\p{Lu}\\p{Ll}]")),
        "allcaps_word_count": "len(list_filter(tok, lambda w: len(regexp_extract_all(w, '[\\p{Lu}\\p{Ll}]')) >= 2 and not regexp_matches(w, '\\p{Ll}')))::DOUBLE",
        "title_case_ratio": _ratio("len(list_filter(tok, lambda w: regexp_matches(w, '^\\p{Lu}')))", "L"),
        "has_digit": f"({_count('ch', '[' + chr(92) + 'p{Nd}]')} > 0)::INT::DOUBLE",
        "digit_count": _count("ch", "\\p{Nd}"),
        "starts_with_digit": "num::INT::DOUBLE",
        "leading_number_magnitude": "case when num then least(coalesce(try_cast(tok[1] as DOUBLE), 0), 1000) else 0 end",
        "has_question": "(contains(t, '?') or contains(t, '？'))::INT::DOUBLE",
        "has_exclamation": "(contains(t, '!') or contains(t, '！'))::INT::DOUBLE",
        "exclamation_count": _count("t", "[!！]"),
        "has_ellipsis": "(contains(t, '…') or contains(t, '...'))::INT::DOUBLE",
        "comma_count": _count("t", "[,，]"),
        "has_colon": "contains(t, ':')::INT::DOUBLE",
        "has_quote": "regexp_matches(t, '[\"''‘’“”]')::INT::DOUBLE",
        "has_dash": "regexp_matches(t, '[-–—]')::INT::DOUBLE",
        "ends_question": "regexp_matches(tail, '[?？]$')::INT::DOUBLE",
        "ends_exclamation": "regexp_matches(tail, '[!！]$')::INT::DOUBLE",
        "ends_ellipsis": "regexp_matches(tail, '(…|\\.\\.\\.)$')::INT::DOUBLE",
        "second_person_count": _members(LEX.second),
        "first_person_sing_count": _members(LEX.first_sing),
        "first_person_plur_count": _members(LEX.first_plur),
        "third_person_count": _members(LEX.third),
        "demonstrative_count": _members(LEX.demonstratives),
        "wh_word_count": _members(LEX.wh_words),
        "intensifier_count": _members(LEX.intensifiers),
        "superlative_count": _members(LEX.superlatives),
        "leading_demonstrative": f"list_has_any(low[1:3], {_list(LEX.demonstratives)})::INT::DOUBLE",
        "has_emoji": f"regexp_matches(t, '{CLUSTER}')::INT::DOUBLE",
        "emoji_count": _count("t", CLUSTER),
        "emoji_leading": f"regexp_matches(t, '^{CLUSTER}')::INT::DOUBLE",
        "emoji_trailing": f"regexp_matches(t, '{CLUSTER}$')::INT::DOUBLE",
        "polarity_sum": "coalesce(list_sum(pol), 0)::DOUBLE",
        "polarity_abs_sum": "coalesce(list_sum(list_transform(pol, lambda s: abs(s))), 0)::DOUBLE",
        "polarity_pos_count": "len(list_filter(pol, lambda s: s > 0))::DOUBLE",
        "polarity_neg_count": "len(list_filter(pol, lambda s: s < 0))::DOUBLE",
        "syllable_count": "coalesce(list_sum(syl), 0)::DOUBLE",
        "mean_syllables_per_word": _ratio("list_sum(syl)", "L"),
        "flesch_reading_ease": (
            "case when L > 0 then greatest(-100, least(150, 206.835::DOUBLE - 1.015::DOUBLE * (L / greatest(1, "
            + _count("t", "[.!?]+") + ")) - 84.6::DOUBLE * (list_sum(syl) / L))) else 0 end"
        ),
        "non_ascii_ratio": _ratio(_count("ch", "[^\\x00-\\x7F]"), "C"),
    }
    for n in FEATURE_NAMES:
        if n.startswith("ft_"):
            cols[n] = f"coalesce((opener = '{n[3:]}')::INT, 0)::DOUBLE"
    shown = (lambda x: f"round({x}, {digits}) + 0.0") if digits else (lambda x: f"({x})")
    body = ",\n  ".join(f"{shown(cols[n])} as {n}" for n in FEATURE_NAMES)
    return f"""
{name}_t as (select {keys}, trim(regexp_replace(nfc_normalize(text), '[{WHITESPACE_CLASS}]+', ' ', 'g'), ' ') as t
  from {source}),
{name}_u as (select *, regexp_replace(t, '[{ZERO_WIDTH_CLASS}]', '', 'g') as ch,
  regexp_replace(t, '[{DECORATION_CLASS} ]+$', '') as tail,
  list_filter(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{Nd}}''’]+'), lambda x: trim(x, '''’')), lambda x: x <> '') as tok
  from {name}_t),
{name}_v as (select *, list_transform(tok, lambda w: replace(lower(w), '’', '''')) as low,
  length(ch)::DOUBLE as C, len(tok)::DOUBLE as L, coalesce(regexp_matches(tok[1], '^\\p{{Nd}}+$'), false) as num from {name}_u),
{name}_w as (select *,
  list_transform(list_transform(low, lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w:
    greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))
      - (w like '%e' and w not like '%le' and len(regexp_extract_all(w, '[aeiouy]+')) > 1)::INT)) as syl,
  list_transform(low, lambda w, i:
    (case when list_contains({_list(_POS)}, w) then 0.6::DOUBLE when list_contains({_list(_NEG)}, w) then -0.6::DOUBLE else 0 end)
    * (case when list_has_any(low[greatest(i - 3, 1):i - 1], {_list(LEX.negators)}) then -1 else 1 end)) as pol,
  case when L = 0 then null when num then 'numeral' {openers} else 'other' end as opener from {name}_v),
{name} as (select {keys},
  {body}
  from {name}_w)"""


LINES = """
sentence_lists as (
  select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'),
                             lambda x: trim(x, ' ')), lambda x: x <> '') as s from documents),
lines as (
  select doc_id * 1000000 + n // 5 as ranking_id, n % 5 as position, text, doc_id
  from (select doc_id, unnest(s) as text, unnest(range(len(s))) as n from sentence_lists))"""

DOC_FEATURES = features_ctes("documents", "doc_id, lang")

_NAMES = ", ".join(FEATURE_NAMES)
FAMILIES = {
    "length_features": FEATURE_NAMES[0:5],
    "case_features": FEATURE_NAMES[5:8],
    "digit_features": FEATURE_NAMES[8:12],
    "punctuation_features": FEATURE_NAMES[12:23],
    "lexicon_features": FEATURE_NAMES[23:32],
    "emoji_features": FEATURE_NAMES[32:36],
    "polarity_features": FEATURE_NAMES[36:40],
    "readability_features": FEATURE_NAMES[40:43],
    "first_token_features": FEATURE_NAMES[43:51],
    "script_features": FEATURE_NAMES[51:52],
}
HEADLINES = PAIRS + """,
headlines as (select distinct headline as text from (select headline_a as headline from labelled union all select headline_b from labelled))"""
HEADLINE_FEATURES = HEADLINES + "," + features_ctes("headlines", "text", "hf")
DIFFS = HEADLINE_FEATURES + ",\ndiffs as (select l.*, " + ", ".join(
    f"round(a.{n} - b.{n}, 6) + 0.0 as d_{n}" for n in FEATURE_NAMES
) + " from labelled l join hf a on a.text = l.headline_a join hf b on b.text = l.headline_b)"

SQL = {
    "text_features": f"with {DOC_FEATURES} select doc_id, {_NAMES} from features",
    **{
        name: "with " + features_ctes("conversations", "conv_id, turn") + f" select conv_id, turn, {', '.join(cols)} from features"
        for name, cols in FAMILIES.items()
    },
    "feature_diff_vectors": f"with {DIFFS} select test_id, image_id, headline_a, headline_b, "
    + ", ".join(f"d_{n}" for n in FEATURE_NAMES) + " from diffs",
    "feature_support": f"with {DIFFS}, s as (select "
    + ", ".join(f"avg((d_{n} <> 0)::INT::DOUBLE) as {n}" for n in FEATURE_NAMES)
    + " from diffs) select feature, round(support, 6) as support, support < 0.001 as dropped from (unpivot s on columns(*) into name feature value support)",
    "excluded_features": f"with {DIFFS}, s as (select "
    + ", ".join(f"avg((d_{n} <> 0)::INT::DOUBLE) as {n}" for n in FEATURE_NAMES)
    + " from diffs) select feature from (unpivot s on columns(*) into name feature value support) where support < 0.001",
    "augment_pairs": f"with {DIFFS} select test_id, image_id, sign, count(*) as n, sum(case when sign = 1 then label else 1 - label end)::BIGINT as n_positive, "
    "round(sum(sign * d_char_count), 6) + 0.0 as sum_char_count, round(sum(sign * d_flesch_reading_ease), 4) + 0.0 as sum_flesch "
    "from diffs, (values (1), (-1)) s(sign) group by all",
    "vocabulary": """
with words as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w from documents),
padded as (select doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '')) || ' ' as w from documents),
terms as (
  select doc_id, 'word' as kind, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) as term
  from words
  union all
  select distinct doc_id, 'char', substr(w, i, n)
  from (select doc_id, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) as i
        from padded, (values (3), (4), (5)) s(n) where n = 3 or n - 1 < length(w)))
select kind, term, count(*) as df from terms group by all having count(*) >= 3""",
    "phrase_coverage": "with " + features_ctes("documents", "doc_id") + ", long as (unpivot features on "
    + _NAMES + " into name feature value v) select feature, count(*) filter (where v <> 0) as n_used, "
    "feature not in ('has_emoji', 'emoji_count', 'emoji_leading', 'emoji_trailing') as has_phrase from long group by 1",
    "feature_diff": "with bare as (select doc_id, lang, regexp_replace(text, '[.!?]+$', '') as text from documents), "
    + features_ctes("documents", "doc_id", "fa") + "," + features_ctes("bare", "doc_id", "fb")
    + f""", a as (unpivot fa on {_NAMES} into name feature value v), b as (unpivot fb on {_NAMES} into name feature value v),
d as (select feature, doc_id, abs(a.v - b.v) as delta from a join b using (feature, doc_id)),
shown as (select feature, string_agg(doc_id::VARCHAR, ',' order by place) as example_docs
  from (select feature, doc_id, row_number() over (partition by feature order by delta desc, doc_id) as place from d where delta > 1e-5) where place <= 3 group by 1)
select feature, any_value(example_docs) as example_docs, count(*) as n_cells, count(*) filter (where delta > 1e-5) as n_divergent, round(max(delta), 6) + 0.0 as max_delta,
  case when max(delta) > 1e-5 then arg_min(doc_id, {{'a': -delta, 'b': doc_id}}) end as worst_doc from d left join shown using (feature) group by 1""",
    "url_hosts": """
select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, count(*) as n_pages from pages group by 1""",
}
