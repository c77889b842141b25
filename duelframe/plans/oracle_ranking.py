"""Oracle SQL (DuckDB) for scoring, ranking and attribution."""

from ..functions.phrases import PHRASES
from ..operators.scoring import HAND_MODEL as MODEL
from .oracle_pairs import PAIRS
from .oracle_text import HEADLINES, LINES, features_ctes

_STRENGTH = " + ".join(f"{c!r}::DOUBLE * {f} / {s!r}::DOUBLE" for f, c, s in MODEL.terms)

SETS = LINES + """,
sizes as (select ranking_id, count(*) as n_lines, max(length(text)) as longest from lines group by 1),
accepted as (select l.* from lines l join sizes using (ranking_id)
             where n_lines between 2 and 5 and longest <= 300),""" + features_ctes("accepted", "ranking_id, position, text", "f", None)

SCORES = SETS + f""",
strengths as (select *, {_STRENGTH} as strength from f),
matrix as (select a.ranking_id, a.position as i, b.position as j, 1 / (1 + exp(-(a.strength - b.strength))) as p
           from strengths a join strengths b on a.ranking_id = b.ranking_id and a.position <> b.position),
raw_scores as (select ranking_id, i as position, count(*) + 1 as n_lines, round(avg(p), 12) as score,
                  2 * avg(abs(p - 0.5::DOUBLE)) as confidence from matrix group by all),
scores as (select s.*, t.text, t.strength from raw_scores s join strengths t using (ranking_id, position)),
ranks as (select *, row_number() over (partition by ranking_id order by score desc, position) as rank from scores),
places as (select a.ranking_id, a.position,
             1 + count(*) filter (where b.position <> a.position and abs(a.score - b.score) >= 0.04::DOUBLE and b.score > a.score) as lo,
             count(*) - count(*) filter (where b.position <> a.position and abs(a.score - b.score) >= 0.04::DOUBLE and b.score < a.score) as hi
           from scores a join scores b on a.ranking_id = b.ranking_id group by all),
placed as (select r.*, lo, hi, lo = hi as exact,
             case when lo = hi then o1.name else o1.name || '–' || o2.name end as place_label
           from ranks r join places using (ranking_id, position)
           join (values (1, '1st'), (2, '2nd'), (3, '3rd'), (4, '4th'), (5, '5th')) o1(n, name) on o1.n = lo
           join (values (1, '1st'), (2, '2nd'), (3, '3rd'), (4, '4th'), (5, '5th')) o2(n, name) on o2.n = hi),
neighbours as (select *, lead(position) over w as next_position, score - lead(score) over w as gap,
                 lead(lo) over w as next_lo, lead(hi) over w as next_hi
               from placed window w as (partition by ranking_id order by rank)),
flagged as (select *, coalesce(gap < 0.04::DOUBLE, false) as too_close,
              coalesce(hi >= next_lo and next_hi >= lo, false) as overlaps_next from neighbours)"""

_TERMS = " union all ".join(
    f"select {pos} as pos, '{f}' as feature, {c!r}::DOUBLE as coef, {s!r}::DOUBLE as scale, "
    f"'{PHRASES[f][0]}' as more, '{PHRASES[f][1]}' as less".replace('"', '"')
    for pos, (f, c, s) in enumerate(MODEL.terms)
)
_FEATURES = ", ".join(t[0] for t in MODEL.terms)
NOTES = SETS + f""",
terms as ({_TERMS}),
long as (unpivot (select ranking_id, position, {_FEATURES} from f) on {_FEATURES} into name feature value mine),
sums as (select ranking_id, feature, sum(mine) as total, count(*) as n from long group by all),
deltas as (select l.*, (total - mine) / (n - 1) as theirs, mine - (total - mine) / (n - 1) as delta
           from long l join sums using (ranking_id, feature)),
gains as (select d.*, pos, coef * delta / scale as contribution,
            case when feature = 'char_count' then floor(mine + 0.5)::BIGINT::VARCHAR || ' characters — ' else '' end
              || case when delta > 0 then more else less end as text
          from deltas d join terms using (feature)),
notes as (select ranking_id, position,
            row_number() over (partition by ranking_id, position order by abs(round(contribution, 12)) desc, pos) as place,
            feature, case when contribution > 0 then 'helps' else 'hurts' end as kind,
            round(contribution, 6) + 0.0 as contribution, round(mine, 6) + 0.0 as mine, round(theirs, 6) + 0.0 as theirs, text
          from gains where abs(delta) >= 1e-12 and abs(contribution) >= 1e-9)"""

# Words, coefficients and scales of the marked features, written out.
_MARKED = "second_person_count, leading_demonstrative, demonstrative_count, ends_question, ends_exclamation, ends_ellipsis"
MARKS = SETS + f""",
long as (unpivot (select ranking_id, position, {_MARKED} from f) on {_MARKED} into name feature value mine),
sums as (select ranking_id, feature, sum(mine) as total, count(*) as n from long group by all),
said as (select ranking_id, position, l.feature, coef * (mine - (total - mine) / (n - 1)) / scale as gain
  from long l join sums using (ranking_id, feature) join (values ('second_person_count', 0.3, 0.5), ('leading_demonstrative', 0.2, 0.3),
    ('demonstrative_count', 0.1, 0.8), ('ends_question', 0.25, 0.4), ('ends_exclamation', -0.2, 0.3), ('ends_ellipsis', -0.1, 0.2)) w(feature, coef, scale)
    on w.feature = l.feature where abs(mine - (total - mine) / (n - 1)) >= 1e-12),
kinds as (select ranking_id, position, feature, case when gain > 0 then 'helps' else 'hurts' end as kind from said where abs(gain) >= 1e-9),
pieces as (select ranking_id, position, unnest(p) as piece, unnest(range(len(p))) as n
  from (select ranking_id, position, regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}''’]+|[^\\p{{L}}\\p{{Nd}}''’]+') as p from accepted)),
placed_ as (select *, coalesce(sum(length(piece)) over (partition by ranking_id, position order by n rows between unbounded preceding and 1 preceding), 0)::BIGINT as pos from pieces),
tokens as (select ranking_id, position, pos + length(piece) - length(ltrim(piece, '''’')) as start, trim(piece, '''’') as token,
    row_number() over (partition by ranking_id, position order by n) as number_
  from placed_ where regexp_matches(piece, '^[\\p{{L}}\\p{{Nd}}''’]') and trim(piece, '''’') <> ''),
folded as (select *, replace(lower(token), '’', '''') as low from tokens),
tails as (select ranking_id, position, regexp_replace(text, '[\\x{{1F000}}-\\x{{10FFFF}}\\x{{2600}}-\\x{{27BF}}\\x{{2B00}}-\\x{{2BFF}}\\x{{FE0E}}\\x{{FE0F}}\\x{{200B}}-\\x{{200D}}\\x{{FEFF}} ]+$', '') as bare from accepted),
marks as (
  select ranking_id, position, start, start + length(token) as stop, 'second person' as label, feature, kind
  from folded join kinds using (ranking_id, position) where feature = 'second_person_count'
    and low in ('you', 'your', 'yours', 'yourself', 'yourselves', 'you''re', 'you''ll', 'you''ve', 'you''d')
  union all
  select ranking_id, position, start, start + length(token), 'demonstrative', feature, kind from folded join (
      select * from kinds where feature in ('leading_demonstrative', 'demonstrative_count')
      qualify row_number() over (partition by ranking_id, position order by feature desc) = 1) using (ranking_id, position)
  where number_ = 1 and low in ('this', 'that', 'these', 'those')
  union all
  select ranking_id, position, length(bare) - case when ends_with(bare, '...') then 3 else 1 end, length(bare), 'terminal punctuation', feature, kind
  from tails join kinds using (ranking_id, position)
  where (feature = 'ends_question' and regexp_matches(bare, '[?？]$')) or (feature = 'ends_exclamation' and regexp_matches(bare, '[!！]$'))
    or (feature = 'ends_ellipsis' and regexp_matches(bare, '(…|\\.\\.\\.)$')))"""

_HYPE = "shocking|unbelievable|insane|amazing|epic|mind-blowing|incredible|crazy"
RULES = LINES + f""",
rule_lines as (select ranking_id, position, text,
  (case when regexp_matches(text, '\\b\\d[\\d.,]*\\b') then 0.34::DOUBLE else 0 end)
  + (case when regexp_matches(text, '(?i)\\b(you|your|you''re|yours)\\b') then 0.28::DOUBLE else 0 end)
  + (case when contains(text, '?') then 0.18::DOUBLE else 0 end)
  + (case when regexp_matches(text, '(?i)\\b({_HYPE})\\b') then -0.32::DOUBLE else 0 end)
  + (-0.16::DOUBLE * least(len(regexp_extract_all(text, '!')), 3))
  + (case when regexp_matches(text, '\\b[A-Z]{{3,}}\\b') then -0.24::DOUBLE else 0 end)
  + (case when length(text) > 80 then -0.26::DOUBLE when length(text) < 22 then -0.12::DOUBLE else 0 end) as rule_score
  from lines),
sizes as (select ranking_id, count(*) as n_lines, max(length(text)) as longest from lines group by 1),
rules as (select r.* from rule_lines r join sizes using (ranking_id) where n_lines between 2 and 5 and longest <= 300)"""

_M = "select ranking_id, i, j, round(p, 6) + 0.0 as p from matrix"
SQL = {
    "request_check": f"""
with {LINES}
select ranking_id, count(*) as n_lines, max(length(text)) as longest,
       case when count(*) < 2 then 'too few lines' when count(*) > 5 then 'too many lines'
            when max(length(text)) > 300 then 'line too long' end as refused
from lines group by 1""",
    "pair_probability": "with " + HEADLINES + "," + features_ctes("headlines", "text", "hf", None) + f""",
s as (select text, {_STRENGTH} as strength from hf)
select l.test_id, l.image_id, l.headline_a, l.headline_b,
       round(1 / (1 + exp(-(a.strength - b.strength))), 6) as p
from labelled l join s a on a.text = l.headline_a join s b on b.text = l.headline_b""",
    "pairwise_matrix": f"with {SCORES} {_M}",
    "borda_scores": f"with {SCORES} select ranking_id, position, n_lines, round(score, 6) as score, round(confidence, 6) + 0.0 as confidence from scores",
    "rank_lines": f"with {SCORES} select ranking_id, position, rank, round(score, 6) as score from ranks",
    "placing_ranges": f"with {SCORES} select ranking_id, position, lo, hi, exact, place_label from placed",
    "contenders": f"with {SCORES} select ranking_id, position from placed where lo = 1",
    "verdict": f"""
with {SCORES},
labels_ as (select ranking_id, place_label, list_sort(list(chr((65 + position)::INT))) as ids, bool_or(lo = 1) as first, count(*) as n
            from placed group by all),
sets as (select ranking_id, sum(n)::BIGINT as n_lines, coalesce(sum(n) filter (where first), 0)::BIGINT as n_contenders,
           coalesce(list_sort(list(array_to_string(ids, '+')) filter (where n > 1)), []) as tied,
           array_to_string(list_sort(flatten(list(ids) filter (where first))), '+') as first_ids
         from labels_ group by 1)
select ranking_id, n_lines, n_contenders,
       case when n_contenders = n_lines and n_lines > 1 then 'all tied' when n_contenders > 1 then 'several contenders'
            when len(tied) = 0 then 'fully separated' else 'winner with ties below' end as verdict,
       first_ids, array_to_string(tied, ' ') as tied_groups from sets""",
    "too_close": f"with {SCORES} select ranking_id, position, next_position, round(gap, 6) + 0.0 as gap from flagged where too_close",
    "placing_overlaps": f"with {SCORES} select ranking_id, position, next_position from flagged where overlaps_next",
    "rank_line_sets": f"""
with {SCORES}
select ranking_id, position, text, n_lines, rank, round(score, 6) as score, round(confidence, 6) + 0.0 as confidence,
       lo, hi, place_label, too_close, overlaps_next from flagged""",
    "attribution": f"with {NOTES} select * from notes",
    "top_reasons": f"with {NOTES} select * from notes where place <= 3",
    "mark_spans": f"with {MARKS} select ranking_id, position, start, stop as \"end\", label, feature, kind from marks",
    "no_attribution": f"with {SETS} select ranking_id, position, '__no_attribution__' as feature, 'no-effect' as kind, 0.0::DOUBLE as contribution, "
    "'The scorer has no weights per feature, so its choice is not explained.' as text from accepted",
    "order_invariance": f"with {SCORES} select ranking_id, position as line, 2 * n_lines as n_orders, 0.0::DOUBLE as score_drift, false as order_changed from scores",
    "scorer_agreement": f"with {SCORES} select ranking_id, count(*) as n_lines, 0::BIGINT as n_unmatched, 0::BIGINT as n_rank_changes, 0.0::DOUBLE as max_delta, true as agrees from scores group by 1",
    "rule_score": f"with {RULES} select ranking_id, position, round(rule_score, 6) + 0.0 as rule_score from rules",
    "rule_pair_probability": f"""
with {RULES}
select a.ranking_id, a.position as i, b.position as j,
       round(1 / (1 + exp(-1.9::DOUBLE * (a.rule_score - b.rule_score))), 6) as p,
       abs(round(a.rule_score - b.rule_score, 9)) < 0.07::DOUBLE as inseparable
from rules a join rules b on a.ranking_id = b.ranking_id and a.position < b.position""",
    "tie_islands": f"""
with {RULES},
o as (select *, round(rule_score, 9) as rs, row_number() over w as rn,
        case when abs(lag(round(rule_score, 9)) over w - round(rule_score, 9)) < 0.07::DOUBLE then 0 else 1 end as starts
      from rules window w as (partition by ranking_id order by round(rule_score, 9) desc, text, position)),
r as (select *, sum(starts) over (partition by ranking_id order by rn) as run from o)
select ranking_id, position, min(rn) over (partition by ranking_id, run) as rank_start,
       max(rn) over (partition by ranking_id, run) as rank_end from r""",
    "directed_probability": f"with {SCORES} select ranking_id, i as from_position, j as to_position, round(p, 6) + 0.0 as p from matrix",
}
