"""Oracle SQL (DuckDB) for TF-IDF tables."""

from ..functions.features import FEATURE_NAMES
from .oracle_evaluation import metrics
from .oracle_pairs import SPLIT, hash_sql
from .oracle_text import features_ctes
from .oracle_pairs import EVERY_PAIR, PAIRS

_TERM_CTES = """
words as (select headline, regexp_extract_all(lower(headline), '[\\p{L}\\p{N}_]{2,}') as w from texts_),
word_terms as (select headline, 'word' as kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from words),
padded as (select headline, ' ' || unnest(list_filter(regexp_split_to_array(lower(headline), '[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '')) || ' ' as w from texts_),
char_terms as (select headline, 'char' as kind, substr(w, i, n) as term
               from (select headline, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) as i
                     from padded, (values (3), (4), (5)) s(n) where n = 3 or n - 1 < length(w))),
tf as (select headline, kind, term, count(*) as tf from (select * from word_terms union all select * from char_terms) group by all)"""

_WEIGHTS = """,
texts_ as (select headline, count(*) as occurrences
          from (select headline_a as headline from labelled union all select headline_b from labelled) group by 1),
""" + _TERM_CTES + """,
idf as (select kind, term, sum(occurrences)::BIGINT as df,
          ln((1 + (select sum(occurrences) from texts_)) / (1 + sum(occurrences))) + 1 as idf
        from tf join texts_ using (headline) group by 1, 2 having sum(occurrences) >= 3),
raw as (select headline, kind, term, (1 + ln(tf)) * idf as raw from tf join idf using (kind, term)),
weights as (select headline, kind, term, raw / sqrt(sum(raw * raw) over (partition by headline, kind)) as weight from raw)"""

TERMS, EVERY_TERM = PAIRS + _WEIGHTS, EVERY_PAIR + _WEIGHTS

# Baseline fits by plain gradient descent: run -1 learns from the past, runs 0-4 leave one fold out. Pairs with
# equal differences are one row, so that a step is short; the step is that of the largest possible curvature.
FITS = "with recursive " + SPLIT + """,
headlines as (select distinct headline as text from arms),""" + features_ctes(
    "headlines", "text", "hf", None
) + f""",
parts_ as (select l.headline_a, l.headline_b, l.label, s.holdout, {hash_sql('test_id')} % 5 as fold, count(*) as n
  from labelled l join split s using (test_id) group by all),
wide as (select p.*, {", ".join(f"a.{n} - b.{n} as {n}" for n in FEATURE_NAMES)}
  from parts_ p join hf a on a.text = p.headline_a join hf b on b.text = p.headline_b),
cells as (select headline_a, headline_b, label, holdout, fold, n, feature, v, list_position({list(FEATURE_NAMES)}, feature) as place_
  from (unpivot wide on {", ".join(FEATURE_NAMES)} into name feature value v)),
kept as (select feature, row_number() over (order by min(place_)) as pos from cells group by 1 having sum(n * (v <> 0)::INT) / sum(n) >= 0.001),
runs as (select unnest(range(-1, 5)) as run),
learned as (select run, headline_a, headline_b, label, n, pos, v from cells join kept using (feature), runs
  where case when run < 0 then not holdout else fold <> run end),
scales as (select run, pos, case when sum(n * v * v) > 0 then sqrt(sum(n * v * v) / sum(n)) else 1 end as s from learned group by all),
vectors as (select run, headline_a, headline_b, label, any_value(n) as n, list(v / s order by pos) as x from (
    select run, headline_a, headline_b, label, pos, sum(n)::DOUBLE as n, any_value(v) as v from learned group by all)
  join scales using (run, pos) group by all),
data as (select run, x, label, 2 * sum(n) as n from vectors group by all),
steps as (select run, 1 / (1 + sum(n * list_dot_product(x, x)) / 4) as step, any_value(len(x)) as size from data group by 1),
fit as (
  select run, 0 as k, list_transform(range(size), lambda i: 0.0::DOUBLE) as w from steps
  union all
  select run, k, list(next order by j) from (
    select f.run, f.k + 1 as k, j, any_value(f.w[j]) - any_value(step) * (any_value(f.w[j])
      + sum(n * (1 / (1 + exp(-list_dot_product(x, f.w))) - label) * x[j])) as next
    from fit f join data d on d.run = f.run join steps s on s.run = f.run, lateral (select unnest(range(1, size + 1)) as j) where f.k < 2000 group by f.run, f.k, j)
  group by run, k),
weights_ as (select run, unnest(w) as coef, unnest(range(1, len(w) + 1)) as pos from fit where k = 2000),
terms_ as (select run, pos, feature, coef, s from weights_ join scales using (run, pos) join kept using (pos)),
scored_ as (select run, headline_a, headline_b, c.label, holdout, fold, n, 1 / (1 + exp(-sum(coef / s * v))) as p0
  from cells c join terms_ using (feature) where case when run < 0 then holdout else fold = run end group by all),
each_ as (select *, unnest(range(n)) as copy from scored_),
both_ as (select run, round(p0, 12) as p, label as y from each_ union all select run, round(1 - p0, 12), 1 - label from each_)"""

# The text model by accelerated gradient descent. Its solution is a sum of headline vectors, so a step moves one number for
# each headline; K holds their products. eta is one over a bound of the curvature, run -1 learns from the past.
TEXT_STEPS = 800
TEXT = "with recursive " + SPLIT + f""",
parts_ as (select l.headline_a, l.headline_b, l.label, s.holdout, {hash_sql('test_id')} % 5 as fold, count(*) as n
  from labelled l join split s using (test_id) group by all),
runs as (select unnest(range(-1, 5)) as run),
learned as (select run, headline_a, headline_b, label, sum(n) as n from parts_, runs
  where case when run < 0 then not holdout else fold <> run end group by all),
texts_ as (select distinct headline from arms),
numbers_ as (select headline, row_number() over (order by headline) as i from texts_),
""" + _TERM_CTES + """,
occ as (select run, headline, sum(n) as occurrences
  from (select run, headline_a as headline, n from learned union all select run, headline_b, n from learned) group by all),
idf as (select run, kind, term, ln((1 + any_value(total)) / (1 + sum(occurrences))) + 1 as idf
  from tf join occ using (headline) join (select run, sum(occurrences) as total from occ group by 1) using (run) group by all having sum(occurrences) >= 3),
raw as (select run, headline, kind, term, (1 + ln(tf)) * idf as raw from tf join idf using (kind, term)),
weights as (select run, headline, kind, term, raw / sqrt(sum(raw * raw) over (partition by run, headline, kind)) as weight from raw),
dots as (select run, a.headline as ha, b.headline as hb, sum(a.weight * b.weight) as dot
  from weights a join weights b using (run, kind, term) group by all),
kernel as (select runs.run, x.i, list(coalesce(dot, 0)::DOUBLE order by y.i) as row_
  from runs, numbers_ x, numbers_ y left join dots on dots.run = runs.run and ha = x.headline and hb = y.headline group by all),
fit_rows as (
  select l.run, a.i as ia, b.i as ib, label, 2.0::DOUBLE * n as n, list_transform(list_zip(ka.row_, kb.row_), lambda x: x[1] - x[2]) as kd
  from learned l join numbers_ a on a.headline = headline_a join numbers_ b on b.headline = headline_b
    join kernel ka on ka.run = l.run and ka.i = a.i join kernel kb on kb.run = l.run and kb.i = b.i
  union all select run, i, i, 0, 0, list_transform(row_, lambda x: 0::DOUBLE) from kernel),
pace as (select run, 1 / (1 + d * k / 2) as eta, m from
    (select run, max(degree) as d from (select run, i, sum(n) as degree from
       (select run, ia as i, n from fit_rows union all select run, ib, n from fit_rows) group by all) group by 1)
    join (select run, max(list_sum(list_transform(row_, lambda x: abs(x)))) as k, max(i) as m from kernel group by 1) using (run)),
textfit as (
  select run, 0 as k, list_transform(range(m), lambda i: 0.0::DOUBLE) as a, list_transform(range(m), lambda i: 0.0::DOUBLE) as prev from pace
  union all
  select run, k + 1, list(next order by j), any_value(a) from (
    select run, k, j, any_value(a) as a, any_value(v[j] - eta * v[j]) - any_value(eta) * sum(sg * r) as next
    from (select f.run, f.k, f.a, f.v, eta, unnest([ia, ib]) as j, unnest([1, -1]) as sg,
            n * (1 / (1 + exp(-list_dot_product(kd, f.v))) - label) as r
          from (select t.*, eta, list_transform(list_zip(a, prev), lambda x: x[1] + (1 - sqrt(eta)) / (1 + sqrt(eta)) * (x[1] - x[2])) as v
                from textfit t join pace using (run) where k < """ + str(TEXT_STEPS) + """) f
            join fit_rows d on d.run = f.run)
    group by run, k, j) group by run, k),
text_strength as (select t.run, headline as text, list_dot_product(row_, a) as strength
  from textfit t join kernel using (run) join numbers_ using (i) where k = """ + str(TEXT_STEPS) + """),
scored_ as (select x.run, p.headline_a, p.headline_b, p.label, holdout, fold, n, 1 / (1 + exp(-(x.strength - y.strength))) as p0
  from parts_ p join text_strength x on x.text = headline_a join text_strength y on y.text = headline_b and y.run = x.run
  where case when x.run < 0 then holdout else fold = x.run end),
each_ as (select *, unnest(range(n)) as copy from scored_),
both_ as (select run, round(p0, 12) as p, label as y from each_ union all select run, round(1 - p0, 12), 1 - label from each_),
sizes_ as (select run, count(*)::BIGINT as n_features from idf group by 1)"""

# Strengths of the baseline of the past, for all headlines of arms.
_BASELINE_STRENGTH = f"""
flat_ as (select text, feature, v from (unpivot (select * from hf) on {", ".join(FEATURE_NAMES)} into name feature value v)),
model_strength as (select text, sum(coef / s * v) as strength from flat_ join terms_ using (feature) where run < 0 group by 1)"""


_MEASURES = "n_pairs, round(accuracy, 4) as accuracy, round(roc_auc, 4) as roc_auc, round(brier, 4) as brier"


def _report(ctes: str, strengths: str, model: str, more: str = "") -> str:
    return f"""{ctes}, {strengths},
past as (select * from both_ where run < 0), {metrics('run', 'past')},
edges as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from past),
binned as (select p, y, len(list_filter(e, lambda x: x < p)) as bin from past, edges),
gaps as (select max(gap) as gap from (select abs(avg(p) - avg(y)) as gap from binned group by bin)),
held_arms as (select a.*, round(m.strength, 12) as strength from arms a join split using (test_id) join model_strength m on m.text = headline where holdout),
placed_arms as (select *,
   row_number() over (partition by test_id, image_id order by strength desc, headline) as by_score,
   row_number() over (partition by test_id, image_id order by ctr desc, headline) as by_ctr,
   count(*) over (partition by test_id, image_id) as n_arms from held_arms),
choices as (select test_id, image_id, any_value(n_arms) as n_arms,
   max(ctr) filter (where by_score = 1) as chosen, max(ctr) as best, avg(ctr) as mean_ctr, min(ctr) as worst,
   bool_or(by_score = 1 and by_ctr = 1) as hit from placed_arms where n_arms >= 2 group by 1, 2),
m as (select count(*) as n_groups, count(distinct test_id) as n_tests, avg(hit::INT) as top1, avg(1 / n_arms) as random_, avg(n_arms) as arms_,
   avg(chosen) as c, avg(mean_ctr) as m, avg(best) as b, avg(worst) as w from choices)
select '{model}' as model, {_MEASURES}, round(gap, 4) as max_calibration_gap, n_groups, n_tests, round(top1, 4) as top1_accuracy,
  round(random_, 4) as top1_baseline_random, round(arms_, 4) as mean_arms_per_group,
  round(c, 4) as ctr_model_choice, round(m, 4) as ctr_mean_arm, round(b, 4) as ctr_best_arm, round(w, 4) as ctr_worst_arm,
  round(100 * (c - m) / nullif(m, 0), 4) as lift_vs_mean_pct, round(100 * (c - w) / nullif(w, 0), 4) as lift_vs_worst_pct,
  round(100 * (c - m) / nullif(b - m, 0), 4) as pct_of_oracle_gap_captured, 0.0::DOUBLE as max_violation{more}
from metrics, gaps, m"""



SQL = {
    "fit_baseline": f"{FITS} select 'baseline' as version, pos - 1 as pos, feature, round(coef, 4) + 0.0 as coef, round(s, 4) as scale from terms_ where run < 0",
    "cross_validation": f"{FITS}, {metrics('run', 'both_')} select run as fold, 'baseline' as model, {_MEASURES} from metrics where run >= 0",
    "holdout_report": f"{FITS}, {metrics('run', 'both_')} select 'baseline' as model, {_MEASURES} from metrics where run < 0",
    "baseline_report": _report(FITS, _BASELINE_STRENGTH, "baseline"),
    "text_cross_validation": f"{TEXT}, {metrics('run', 'both_')} select run as fold, 'tfidf' as model, {_MEASURES}, n_features from metrics join sizes_ using (run) where run >= 0",
    "tfidf_holdout": _report(
        TEXT, "model_strength as (select text, strength from text_strength where run < 0)", "tfidf",
        ", (select n_features from sizes_ where run < 0) as n_features"),
    "tfidf_idf": f"with {TERMS} select kind, term, df, round(idf, 6) as idf from idf",
    "tfidf_weights": f"with {TERMS} select headline, kind, term, round(weight, 6) as weight from weights",
    "tfidf_diff": f"""with {EVERY_TERM},
d as (select test_id, image_id, headline_a, headline_b, kind, term, sum(w) as d from (
  select l.*, kind, term, weight as w from labelled l join weights on headline = headline_a
  union all select l.*, kind, term, -weight from labelled l join weights on headline = headline_b) group by all)
select test_id, image_id, headline_a, headline_b, kind, count(*) as n_terms, round(sum(d * d), 6) as sq_norm
from d where abs(d) > 1e-9 group by all""",
}
