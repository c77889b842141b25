"""Oracle SQL (DuckDB) for drift and activity."""

from ..functions.features import FEATURE_NAMES
from ..sources.tables import FUNNEL_NAMES
from .oracle_ranking import SCORES
from .oracle_text import DOC_FEATURES

_NAMES = ", ".join(FEATURE_NAMES)
_Q = "[" + ", ".join(f"{i}/10::DOUBLE" for i in range(11)) + "]"
SIDES = DOC_FEATURES + f""",
sides as (select feature, value, case when lang = 'en' then 'train' else 'live' end as side
          from (unpivot features on {_NAMES} into name feature value value)),
totals as (select feature, count(*) filter (where side = 'train') as nt, count(*) filter (where side = 'live') as nl,
             count(distinct value) filter (where side = 'train') as nv from sides group by 1),
edges as (select feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e
          from sides where side = 'train' group by 1),
binned as (select feature, side, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) as bin, len(e) as n_edges
           from sides join edges using (feature)),
bins as (select feature, bin, any_value(n_edges) as n_edges, count(*) filter (where side = 'train') as t, count(*) filter (where side = 'live') as l
         from binned group by 1, 2),
usual as (select feature, any_value(n_edges) as n_edges,
            sum((greatest(l / nl, 1e-6) - greatest(t / nt, 1e-6)) * ln(greatest(l / nl, 1e-6) / greatest(t / nt, 1e-6))) as v
          from bins join totals using (feature) group by 1),
train_values as (select distinct feature, value from sides where side = 'train'),
outside as (select feature, count(*) as n from sides s where side = 'live'
              and not exists (select 1 from train_values t where t.feature = s.feature and t.value = s.value) group by 1),
psi as (select feature, case when n_edges >= 3 then v when nv = 1 then 10.0::DOUBLE * coalesce(n, 0) / nl else 0.0 end as psi
        from usual join totals using (feature) left join outside using (feature)),
counts as (select feature, value, count(*) filter (where side = 'train') as t, count(*) filter (where side = 'live') as l from sides group by 1, 2),
upto as (select feature, nt, nl, abs(sum(t) over w / nt - sum(l) over w / nl) as d from counts join totals using (feature)
         window w as (partition by feature order by value)),
ks as (select feature, max(d) as d, any_value(nt) as n_train, any_value(nl) as n_live from upto group by 1),
ks_p as (select feature, d, n_train, n_live, case when lam < 0.04 then 1.0 else greatest(0, least(1,
           list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 2 else -2 end) * exp(-2 * lam * lam * k * k))))) end as p
         from (select *, sqrt(n_train::DOUBLE * n_live / (n_train + n_live)) * d as lam from ks)),
moments as (select feature, avg(value) filter (where side = 'train') as train_mean, stddev_pop(value) filter (where side = 'train') as train_std,
              avg(value) filter (where side = 'live') as live_mean, stddev_pop(value) filter (where side = 'live') as live_std from sides group by 1),
report as (select feature, psi, case when psi < 0.1 then 'stable' when psi < 0.25 then 'moderate shift' else 'major shift' end as band,
             d as ks_statistic, p as ks_p_value, train_mean, train_std, live_mean, live_std, n_train, n_live
           from psi join ks_p using (feature) join moments using (feature))"""

ACTIVITY = "activity as (select event_id, ts, user_id, case event_type " + " ".join(
    f"when '{k}' then '{v}'" for k, v in FUNNEL_NAMES.items()
) + " end as name, value, props from events)"

_HEALTH = """count(*) as n, round(avg(p), 6) as mean, round(stddev_pop(p), 6) + 0.0 as std,
  round(quantile_cont(p, 0.05), 6) as p05, round(quantile_cont(p, 0.5), 6) as median, round(quantile_cont(p, 0.95), 6) as p95,
  round(avg((abs(p - 0.5) < 0.05)::INT::DOUBLE), 6) + 0.0 as near_half,
  avg((abs(p - 0.5) < 0.05)::INT::DOUBLE) > 0.8 or stddev_pop(p) < 0.02 as degenerate"""

OUTCOMES = ACTIVITY + """,
outcome_rows as (select event_id as outcome_id, user_id, event_id as ranking_id, floor(value)::BIGINT - 5 as list_size,
  case when k % 3 <> 0 then k - 10 end as opens, case when k % 5 <> 0 then floor(value / 10)::BIGINT end as clicks, k / 80.0::DOUBLE as share
  from (select *, json_extract_string(props, '$.k')::BIGINT as k from activity where name = 'outcome_reported'))"""

ITEMS = """items as (select l_orderkey as ranking_id, l_linenumber::BIGINT as rank, p_name as text, l_partkey * 1000000 + l_suppkey as item_id,
  l_shipdate as created_at, l_quantity as quantity, nullif(l_discount, 0) as discount, nullif(l_tax, 0) as tax
  from lineitem join part on l_partkey = p_partkey)"""
RANKINGS = "saved as (select o_orderkey as ranking_id, o_custkey % 150 as user_id, o_orderdate as created_at from orders)"
FEEDBACK = ACTIVITY + ", " + RANKINGS + """,
notes_ as (select event_id as feedback_id, ts as created_at, user_id, event_id as ranking_id from activity where name = 'disagreed')"""

SQL = {
    "psi": f"with {SIDES} select feature, round(psi, 6) + 0.0 as psi, band from report",
    "psi_discrete": f"""with {SIDES},
d as (select feature, count(*) as n_values, sum((greatest(l / nl, 1e-6) - greatest(t / nt, 1e-6)) * ln(greatest(l / nl, 1e-6) / greatest(t / nt, 1e-6))) as psi
      from counts join totals using (feature) group by 1)
select feature, n_values, round(psi, 6) + 0.0 as psi, n_values <= 10 as usable from d""",
    "ks_two_sample": f"with {SIDES} select feature, round(d, 6) as ks_statistic, round(p, 6) as ks_p_value, n_train, n_live from ks_p",
    "drift_report": f"""with {SIDES} select feature, round(psi, 6) + 0.0 as psi, band, round(ks_statistic, 6) + 0.0 as ks_statistic,
  round(ks_p_value, 6) as ks_p_value, round(train_mean, 6) + 0.0 as train_mean, round(train_std, 6) + 0.0 as train_std,
  round(live_mean, 6) + 0.0 as live_mean, round(live_std, 6) + 0.0 as live_std, n_train, n_live from report""",
    "drift_summary": f"""with {SIDES} select count(*) as n_features, count(*) filter (where psi >= 0.25) as n_flagged,
  coalesce(string_agg(feature, ' ' order by feature) filter (where psi >= 0.25), '') as flagged_features, round(max(psi), 6) as max_psi from report""",
    "drift_by_window": """
with train as (select value from events where ts < '2024-01-11'),
e as (select list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from train),
t as (select len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) as bin, count(*) / (select count(*) from train) as t from train, e group by 1),
live as (select date_trunc('day', ts)::DATE as day, value from events where ts >= '2024-01-11'),
l as (select day, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) as bin, count(*) as n from live, e group by 1, 2),
days as (select day, count(*) as n_live from live group by 1 having count(*) >= 50),
bins as (select unnest(range(len(e) - 1)) as bin from e),
cells as (select day, n_live, greatest(coalesce(t, 0), 1e-6) as t, greatest(coalesce(n, 0) / n_live, 1e-6) as l
          from days cross join bins left join t using (bin) left join l using (day, bin)),
r as (select day, any_value(n_live) as n_live, sum((l - t) * ln(l / t)) as psi from cells group by 1)
select day, n_live, round(psi, 6) + 0.0 as psi, case when psi < 0.1 then 'stable' when psi < 0.25 then 'moderate shift' else 'major shift' end as band from r""",
    "prediction_health": f"with {SCORES} select 'all' as run, {_HEALTH} from (select round(p, 12) as p from matrix)",
    "prediction_health_by_day": f"with d as (select date_trunc('day', ts)::DATE as day, round(1 / (1 + exp(-(value - 50) / 40)), 12) as p from events) select day, {_HEALTH} from d group by 1",
    "funnel_24h": f"with {ACTIVITY} select name, count(*) as n from activity where ts > (select max(ts) from activity) - interval 24 hours group by 1",
    "funnel_by_day": f"with {ACTIVITY} select date_trunc('day', ts)::DATE as day, name, count(*) as n, count(distinct user_id) as n_users from activity group by 1, 2",
    "rate_limit": f"""with {ACTIVITY} select event_id, user_id, count(*) over (partition by user_id order by ts
  range between interval '59.999999 seconds' preceding and current row) as n_recent, true as allowed from activity""",
    "rate_limit_daily": f"""with {ACTIVITY}, n as (select event_id, user_id, count(*) over (partition by user_id order by ts
  range between interval '86399.999999 seconds' preceding and current row) as n_recent from activity)
select *, n_recent <= 3 as allowed from n""",
    "rate_limit_exact": f"""with recursive {ACTIVITY},
o as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from activity),
r as (
  select user_id, rn, event_id, true as allowed, [us] as accepted from o where rn = 1
  union all
  select user_id, rn, event_id, len(recent) < 3, case when len(recent) < 3 then list_append(recent, us) else recent end
  from (select o.*, list_filter(r.accepted, lambda t: o.us - t < 86400000000) as recent from r join o on o.user_id = r.user_id and o.rn = r.rn + 1))
select event_id, user_id, allowed from r""",
    "user_sessions": f"""with {ACTIVITY} select user_id, min(ts) as first_seen, max(ts) as last_seen,
  count(*) filter (where name = 'account_created') = 0 as is_anonymous, min(ts) filter (where name = 'account_created') as upgraded_at, count(*) as n_events
from activity group by 1""",
    "activity_sessions": f"""with {ACTIVITY},
s as (select *, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end as starts from activity window w as (partition by user_id order by ts)),
r as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as run from s)
select user_id, min(ts) as started_at, max(ts) as last_event, count(*) as n_events from r group by user_id, run""",
    "recent_samples": f"""with {ITEMS},
newest as (select * from items order by created_at desc, ranking_id desc, rank desc, item_id desc limit 2000)
select feature, count(*) as n, round(avg(value), 6) as mean from (unpivot newest on quantity, discount, tax into name feature value value) group by 1""",
    "live_feature_means": f"""with {ITEMS},
newest as (select * from items order by created_at desc, ranking_id desc, rank desc, item_id desc limit 500)
select feature, round(mean, 6) as mean, 500::BIGINT as n_items from (unpivot (select avg(coalesce(quantity, 0)) as quantity, avg(coalesce(discount, 0)) as discount,
  avg(coalesce(tax, 0)) as tax from newest) on quantity, discount, tax into name feature value mean)""",
    "latest_run": "select model_version, run_id, created_at, round(max_psi, 6) as max_psi from (select o_orderpriority as model_version, o_orderkey as run_id, o_orderdate as created_at, "
    "o_totalprice / 1000000 as max_psi, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1",
    "event_props": "select event_type, json_extract_string(props, '$.k')::BIGINT as k, count(*) as n from events group by 1, 2",
    "latency_summary": """
with s as (select event_type as target, value as ms, k % 10 <> 0 as ok, case when event_type = 'error' and k % 2 = 1 then '[1,0,2,3]' else '[0,1,2,3]' end as ranking
           from (select *, json_extract_string(props, '$.k')::BIGINT as k from events))
select target, count(*) as requests, count(*) filter (where not ok) as errors, round(avg(ms) filter (where ok), 6) as mean_ms,
  min(ms) filter (where ok) as min_ms, max(ms) filter (where ok) as max_ms, count(distinct ranking) filter (where ok) as distinct_orders,
  round(quantile_cont(ms, 0.5) filter (where ok), 6) as p50_ms, round(quantile_cont(ms, 0.9) filter (where ok), 6) as p90_ms,
  round(quantile_cont(ms, 0.99) filter (where ok), 6) as p99_ms from s group by 1""",
    "targets_agree": """
with s as (select k % 10 <> 0 as ok, case when event_type = 'error' and k % 2 = 1 then '[1,0,2,3]' else '[0,1,2,3]' end as ranking
           from (select *, json_extract_string(props, '$.k')::BIGINT as k from events))
select count(distinct ranking) as distinct_orders, count(distinct ranking) <= 1 as agree from s where ok""",
    "erasure_report": f"""with {FEEDBACK}
select 'events' as table_name, count(*) filter (where user_id = 7) as n_removed, count(*) filter (where user_id <> 7) as n_kept from activity
union all select 'feedback', count(*) filter (where user_id = 7), count(*) filter (where user_id <> 7) from notes_
union all select 'outcomes', count(*) filter (where user_id = 7), count(*) filter (where user_id <> 7) from activity where name = 'outcome_reported'
union all select 'rankings', count(*) filter (where user_id = 7), count(*) filter (where user_id <> 7) from saved""",
    "validate_outcomes": f"""with {OUTCOMES}
select outcome_id, array_to_string(list_filter([case when list_size <= 0 then 'list_size positive' end, case when opens < 0 then 'opens not negative' end,
  case when clicks < 0 then 'clicks not negative' end, case when share not between 0 and 1 then 'share within 0-1' end,
  case when opens is null and clicks is null then 'some signal' end], lambda x: x is not null), '; ') as failed from outcome_rows""",
    "clean_outcomes": f"""with {OUTCOMES}
select outcome_id, case when opens >= 0 then opens::DOUBLE end as opens, case when clicks >= 0 then clicks::DOUBLE end as clicks,
  case when share between 0 and 1 then round(share, 6) end as share from outcome_rows""",
    "orphan_feedback": f"with {FEEDBACK} select feedback_id, ranking_id, user_id from notes_ n where not exists (select 1 from saved s where s.ranking_id = n.ranking_id and s.user_id = n.user_id)",
    "owned_feedback": f"with {FEEDBACK} select feedback_id, ranking_id, user_id from notes_ n where exists (select 1 from saved s where s.ranking_id = n.ranking_id and s.user_id = n.user_id)",
    "feedback_queue": f"""with {FEEDBACK}, {ITEMS},
queue as (select * from notes_ order by created_at desc, feedback_id desc limit 25)
select feedback_id, q.created_at, q.ranking_id, coalesce(string_agg(text, ' | ' order by rank, text), '') as lines
from queue q left join items i on i.ranking_id = q.ranking_id group by all""",
    "visible_rows": f"with {RANKINGS} select ranking_id, user_id, created_at from saved where user_id = 7",
}
