"""Oracle SQL (DuckDB) for evaluation."""

from ..operators.scoring import HAND_MODEL as MODEL
from .oracle_pairs import PAIRS, hash_sql
from .oracle_ranking import _STRENGTH, SCORES
from .oracle_text import features_ctes

BASE = PAIRS + """,
headlines as (select distinct headline as text from arms),""" + features_ctes("headlines", "text", "hf", None) + f""",
s as (select text, {_STRENGTH} as strength from hf),
predicted as (select l.*, 1 / (1 + exp(-(a.strength - b.strength))) as p0
              from labelled l join s a on a.text = l.headline_a join s b on b.text = l.headline_b),
both_ways as (select test_id, {hash_sql('test_id')} % 5 as fold, round(p0, 12) as p, label as y from predicted
              union all select test_id, {hash_sql('test_id')} % 5, round(1 - p0, 12), 1 - label from predicted)"""


def metrics(keys: str, source: str = "both_ways", name: str = "metrics") -> str:
    part = f"partition by {keys}"
    return f"""
{name}_c as (select {keys}, p, count(*) as n, sum(y) as pos, sum(1 - y) as neg from {source} group by all),
{name}_r as (select *, sum(neg) over ({part} order by p rows unbounded preceding) - neg as below from {name}_c),
{name} as (select {keys}, sum(n)::BIGINT as n_pairs,
  sum(case when p >= 0.5 then pos else neg end)::DOUBLE / sum(n) as accuracy,
  sum(pos::DOUBLE * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) as roc_auc,
  sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(n) as brier from {name}_r group by {keys})"""


_CHOICES = BASE + """,
scored_arms as (select a.*, strength from arms a join s on s.text = a.headline),
placed_arms as (select *,
   row_number() over (partition by test_id, image_id order by strength desc, headline) as by_score,
   row_number() over (partition by test_id, image_id order by ctr desc, headline) as by_ctr,
   count(*) over (partition by test_id, image_id) as n_arms from scored_arms),
choices as (select test_id, image_id, any_value(n_arms) as n_arms,
   max(ctr) filter (where by_score = 1) as chosen, max(ctr) as best, avg(ctr) as mean_ctr, min(ctr) as worst,
   bool_or(by_score = 1 and by_ctr = 1) as hit from placed_arms where n_arms >= 2 group by 1, 2)"""

_LONG = """long as (select fold, unnest(['accuracy', 'roc_auc', 'brier']) as metric,
   unnest([accuracy, roc_auc, brier]) as value from metrics)"""

SQL = {
    "pairwise_metrics": f"with {BASE}, one as (select 'all' as run, p, y from both_ways), {metrics('run', 'one')} "
    "select run, n_pairs, round(accuracy, 6) as accuracy, round(roc_auc, 6) as roc_auc, round(brier, 6) as brier from metrics",
    "fold_metrics": f"with {BASE}, {metrics('fold')} select fold, n_pairs, round(accuracy, 6) as accuracy, round(roc_auc, 6) as roc_auc, round(brier, 6) as brier from metrics",
    "cv_summary": f"with {BASE}, {metrics('fold')} select '{MODEL.version}' as model, round(avg(accuracy), 6) as cv_accuracy_mean, "
    "round(stddev_pop(accuracy), 6) + 0.0 as cv_accuracy_std, round(avg(roc_auc), 6) as cv_auc_mean, "
    "round(stddev_pop(roc_auc), 6) + 0.0 as cv_auc_std, count(*) as n_folds from metrics",
    "top1_selection": f"with {_CHOICES} select count(*) as n_groups, count(distinct test_id) as n_tests, "
    "round(avg(hit::INT), 6) as top1_accuracy, round(avg(1 / n_arms), 6) as top1_baseline_random, "
    "round(avg(n_arms), 6) as mean_arms_per_group from choices",
    "ctr_lift": f"""
with {_CHOICES}, m as (select count(*) as n_groups, avg(chosen) as c, avg(mean_ctr) as m, avg(best) as b, avg(worst) as w from choices)
select n_groups, round(c, 6) as ctr_model_choice, round(m, 6) as ctr_mean_arm, round(b, 6) as ctr_best_arm, round(w, 6) as ctr_worst_arm,
  round(100 * (c - m) / nullif(m, 0), 6) as lift_vs_mean_pct, round(100 * (c - w) / nullif(w, 0), 6) as lift_vs_worst_pct,
  round(100 * (c - m) / nullif(b - m, 0), 6) as pct_of_oracle_gap_captured from m""",
    "calibration": f"""
with {BASE},
edges as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from both_ways),
binned as (select p, y, len(list_filter(e, lambda x: x < p)) as bin from both_ways, edges)
select 'all' as run, bin, count(*) as n, round(avg(p), 6) as mean_predicted, round(avg(y), 6) as observed,
  round(abs(avg(p) - avg(y)), 6) as gap from binned group by bin""",
    "probability_histogram": f"with {BASE} select 'all' as run, least(floor(p * 10), 9)::BIGINT as bin, count(*) as n from both_ways group by 2",
    "antisymmetry": f"""
with {SCORES}
select ranking_id, count(*) as n_pairs, 0::BIGINT as n_one_sided, round(max(abs(a.p + b.p - 1)), 6) + 0.0 as max_violation
from matrix a join matrix b using (ranking_id) where a.i = b.j and a.j = b.i and a.i < a.j group by 1""",
    "metrics_long": f"with {BASE}, {metrics('fold')}, {_LONG} select fold, metric, round(value, 6) as value from long",
    "run_compare": f"""
with {BASE}, hard as (select * from both_ways), half as (select fold, p, y from both_ways where p >= 0.5),
{metrics('fold')}, {metrics('fold', 'half', 'other')}, {_LONG},
long2 as (select fold, unnest(['accuracy', 'roc_auc', 'brier']) as metric, unnest([accuracy, roc_auc, brier]) as value from other)
select fold, metric, round(a.value, 6) as value_1, round(b.value, 6) as value_2,
  round(a.value, 6) is not distinct from round(b.value, 6) as equal,
  round(abs(round(a.value, 6) - round(b.value, 6)) / nullif(abs(round(a.value, 6)), 0), 6) as relative_delta
from long a full join long2 b using (fold, metric)""",
}
