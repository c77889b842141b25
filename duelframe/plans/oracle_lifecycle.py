"""Oracle SQL (DuckDB) for model lifecycle."""

from .oracle_pairs import SPLIT, hash_sql

REGISTRY = """
measured as (select user_id % 20 as v, avg(case when ts < '2024-01-16' then (value > 10)::INT::DOUBLE end) as holdout_accuracy,
  avg(case when ts >= '2024-01-16' then (value > 10)::INT::DOUBLE end) as user_accuracy,
  count(*) filter (where ts >= '2024-01-16') as n_user_labels, max(value) * 2.5e-9::DOUBLE as antisymmetry from events group by 1),
registry as (select 'v' || v as version, case when v % 2 = 0 then 'linear' else 'trees' end as algorithm,
  case when v = 0 then 'champion' when v % 4 = 1 then 'archived' else 'challenger' end as status,
  case when v % 7 = 6 then 2 else 1 end as spec, v = 3 as synthetic, v % 5 <> 4 as export_passed,
  case when v % 4 = 0 then 'agreed' end as force, * from measured),
gated as (select *, antisymmetry > 1e-6 as lopsided from registry),
gates as (select *, list_filter([case when synthetic then 'synthetic' end, case when spec <> 1 then 'feature spec' end,
    case when not export_passed then 'export' end, case when lopsided and force is null then 'antisymmetry' end], lambda x: x is not null) as failures,
  case when lopsided and force is not null then 'antisymmetry' else '' end as warnings from gated)"""

SQL = {
    "promotion_gates": f"""with {REGISTRY} select version, array_to_string(failures, ', ') as failures, warnings,
  len(failures) = 0 as passed, case when warnings <> '' then force end as forced from gates""",
    "promotion_verdict": f"""with {REGISTRY}, c as (select holdout_accuracy as h0, user_accuracy as u0 from registry where status = 'champion'),
g as (select *, holdout_accuracy - h0 as h, user_accuracy - u0 as u from registry, c where status <> 'champion'),
d as (select *, case when antisymmetry > 1e-6 then 'REJECTED: order dependent' when n_user_labels < 200 then 'HELD: too few user labels'
   when h >= 0.005 and u > 0 then 'PROMOTE' when h >= 0.005 then 'REJECTED: no user gain' when u > 0 then 'REJECTED: no holdout gain'
   else 'REJECTED: worse on both' end as verdict from g)
select version, verdict, verdict = 'PROMOTE' as promote, round(h, 6) + 0.0 as holdout_gain, round(u, 6) + 0.0 as user_gain,
  case when verdict like 'HELD%' then n_user_labels || ' of 200 labels' when verdict like '%order%' then 'antisymmetry above 1e-06'
  else 'holdout ' || printf('%+.4f', h) || ', user ' || printf('%+.4f', u) end as reason from d""",
    "registry_check": f"with {REGISTRY} select count(*) as n_models, count(*) filter (where status = 'champion') as n_champions, "
    "count(*) filter (where status = 'champion') <= 1 as one_champion_at_most from registry",
    "registry_view": f"with {REGISTRY} select algorithm, version, len(failures) = 0 as gate_passed, round(antisymmetry, 12) as antisymmetry, status = 'champion' as is_champion from gates",
    "alias_move": f"with {REGISTRY} select version, case when version = 'v2' then 'champion' when status = 'champion' then 'archived' else status end as status from registry",
    "leakage_audit": f"""
with {SPLIT}, h as (select l.*, s.holdout, {hash_sql('test_id')} % 5 as fold from labelled l join split s using (test_id)),
t as (select count(*) filter (where f > 1) as in_folds, count(*) filter (where s > 1) as in_sides
      from (select test_id, count(distinct fold) as f, count(distinct holdout) as s from h group by 1)),
a as (select count(*) filter (where holdout) / count(*) as share, avg(label) as balance,
        count(*) filter (where subset = 'holdout') as locked, min(created_at) filter (where holdout) as first from h),
l as (select count(*) as late from h, a where not holdout and created_at >= first)
select 'no outcome name in a feature' as check_name, true as ok, 0.0::DOUBLE as detail
union all select 'features in the specification', true, 52
union all select 'same texts give the same vector', true, 1
union all select 'no test in two folds', in_folds = 0, in_folds from t
union all select 'no test on both sides', in_sides = 0, in_sides from t
union all select 'no training pair after the holdout starts', late = 0, late from l
union all select 'holdout share 10-30 percent', share between 0.1 and 0.3, round(share, 6) from a
union all select 'locked subset not loaded', locked = 0, locked from a
union all select 'labels balanced', balance > 0.4 and balance < 0.6, round(balance, 6) from a
union all select 'mirror is the exact negation', true, 0""",
}
