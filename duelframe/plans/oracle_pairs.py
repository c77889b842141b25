"""Oracle SQL (DuckDB) for packages, arms, pairs and splits."""

from ..functions.stats import TAIL_DENOMINATOR, TAIL_NUMERATOR


def _horner(x: str, coefficients: list[float]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + {c!r}::DOUBLE)"
    return out


def tail_sql(x: str) -> str:
    near = f"exp(-({x}*{x})/2) * ({_horner(x, TAIL_NUMERATOR)}) / ({_horner(x, TAIL_DENOMINATOR)})"
    far = f"exp(-({x}*{x})/2) / ({x} + 1/({x} + 2/({x} + 3/({x} + 4/({x} + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE"
    return f"case when {x} < 7.07106781186547 then {near} else {far} end"


def hash_sql(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")"
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT)"


PACKAGES = """
packages as (
  select l_suppkey as test_id, l_returnflag as image_id, p_name as headline,
         case when l_discount >= 0.05 then l_quantity::BIGINT else 0 end as clicks,
         l_quantity::BIGINT as impressions, l_shipdate as created_at,
         l_linestatus as subset, (l_tax = 0)::INT as problem
  from lineitem join part on l_partkey = p_partkey)"""

ARMS = PACKAGES + """,
all_arms as (
  select test_id, image_id, headline, sum(clicks)::BIGINT as clicks,
         sum(impressions)::BIGINT as impressions, min(created_at) as created_at,
         min(subset) as subset
  from packages
  where trim(headline) <> '' and impressions > 0 and clicks between 0 and impressions
    and coalesce(problem, 0) = 0 and image_id is not null
  group by all),
arms as (select *, clicks / impressions as ctr from all_arms where impressions >= 100)"""

_DRAWN = ARMS + f""",
numbered as (
  select *, row_number() over (partition by test_id, image_id
              order by {hash_sql('headline')} % 64, headline) - 1 as idx
  from arms),
groups as (select test_id, image_id, count(*) as n, (count(*) * (count(*) - 1)) // 2 as total
           from arms group by all),
slots as (
  select *, unnest(range(least(total, 40))) as slot, least(total, 40) as k from groups where total > 0),
drawn as (
  select test_id, image_id,
         (slot * total) // k + {hash_sql('test_id', 'image_id', 'slot', '20260826')}
           % (((slot + 1) * total) // k - (slot * total) // k) as p
  from slots),
decoded as (
  select test_id, image_id, p, max(j) as j
  from (select d.*, g.n from drawn d join groups g using (test_id, image_id)) x,
       range(1, 100000) r(j)
  where r.j < x.n and (r.j * (r.j - 1)) // 2 <= x.p
  group by all),
sides as (
  select d.test_id, d.image_id, x, y from decoded d
  join (select test_id, image_id, idx, numbered as x from numbered) x1
    on x1.test_id = d.test_id and x1.image_id = d.image_id and x1.idx = d.p - (d.j * (d.j - 1)) // 2
  join (select test_id, image_id, idx, numbered as y from numbered) y1
    on y1.test_id = d.test_id and y1.image_id = d.image_id and y1.idx = d.j),
ordered as (
  select test_id, image_id,
         case when x.headline < y.headline then x else y end as a,
         case when x.headline < y.headline then y else x end as b
  from sides)"""

_EVERY = ARMS + """,
ordered as (
  select x.test_id, x.image_id, x as a, y as b
  from arms x join arms y on y.test_id = x.test_id and y.image_id = x.image_id and x.headline < y.headline)"""

_LABELLED = f""",
pairs as (
  select test_id, image_id, a.headline as headline_a, b.headline as headline_b,
         a.clicks as clicks_a, b.clicks as clicks_b,
         a.impressions as impressions_a, b.impressions as impressions_b,
         a.ctr as ctr_a, b.ctr as ctr_b,
         least(a.created_at, b.created_at) as created_at, a.subset as subset
  from ordered),
spread as (
  select *, (clicks_a + clicks_b) / (impressions_a + impressions_b) as pooled from pairs),
errors as (
  select *, sqrt(pooled * (1 - pooled) * (1 / impressions_a + 1 / impressions_b)) as se from spread),
scored as (
  select * exclude (pooled, se),
         case when se > 0 then (ctr_a - ctr_b) / se else 0 end as z from errors),
tested as (
  select *, 2 * ({tail_sql('abs(z)')}) as p_value,
         clicks_a * impressions_b = clicks_b * impressions_a as tied,
         (clicks_a * impressions_b > clicks_b * impressions_a)::INT as label
  from scored),
labelled as (select * from tested where not tied and p_value < 0.10)"""

#: At most 40 drawn pairs of a group, and all of them.
PAIRS, EVERY_PAIR = _DRAWN + _LABELLED, _EVERY + _LABELLED

SPLIT = PAIRS + """,
tests as (select test_id, min(created_at) as first_at from labelled group by 1),
ranked as (select *, row_number() over (order by first_at desc, test_id desc) as newest,
                  count(*) over () as n_tests from tests),
split as (select test_id, first_at,
                 newest <= greatest(1, round_even(n_tests * 0.2::DOUBLE, 0)::BIGINT) as holdout from ranked)"""

_PAIR_COLUMNS = (
    "test_id, image_id, headline_a, headline_b, clicks_a, clicks_b, impressions_a, "
    "impressions_b, round(ctr_a, 6) as ctr_a, round(ctr_b, 6) as ctr_b, created_at, subset"
)

SQL = {
    "source_count_check": f"""
with {PACKAGES},
expected as (select l_linestatus as subset, count(*) as packages, count(distinct l_suppkey) + (l_linestatus = 'F')::BIGINT as tests
             from orders join lineitem on o_orderkey = l_orderkey group by 1),
found as (select subset, count(*) as found_packages, count(distinct test_id) as found_tests
          from packages group by 1)
select subset, found_packages, found_tests, packages as expected_packages, tests as expected_tests,
       found_packages = packages and found_tests = tests as matches
from found join expected using (subset)""",
    "arms": f"""
with {ARMS}
select test_id, image_id, headline, clicks, impressions, created_at, subset, round(ctr, 6) as ctr from arms""",
    "group_census": f"""
with {ARMS}, g as (select count(*) as n, (count(*) * (count(*) - 1)) // 2 as total
                   from arms group by test_id, image_id)
select count(*) as n_groups, count(*) filter (where n < 2) as n_singletons,
       count(*) filter (where total > 40) as n_capped, sum(total)::BIGINT as possible_pairs,
       sum(least(total, 40))::BIGINT as kept_pairs from g""",
    "candidate_pairs": f"with {PAIRS} select {_PAIR_COLUMNS} from pairs",
    "capped_pairs": f"""
with {PAIRS}
select g.test_id, g.image_id, g.n as n_arms, g.total as possible, count(p.headline_a) as kept
from groups g left join pairs p using (test_id, image_id) group by all""",
    "z_test": f"""
with {PAIRS}
select test_id, image_id, headline_a, headline_b, round(z, 6) + 0.0 as z, round(p_value, 6) as p_value
from tested""",
    "labelled_pairs": f"""
with {PAIRS}
select {_PAIR_COLUMNS}, round(z, 6) as z, round(p_value, 6) as p_value, label from labelled""",
    "alpha_sweep": f"""
with {PAIRS},
passes as (select alpha, t.*, not tied and p_value < alpha as keep
           from tested t, (values (0.05::DOUBLE), (0.10), (0.20), (0.50), (1.00)) a(alpha))
select alpha, count(*) filter (where keep) as pairs, count(*) as candidates,
       round(100.0::DOUBLE * count(*) filter (where keep) / count(*), 2) as pct_of_candidates,
       round((sum(label) filter (where keep))::DOUBLE / (count(*) filter (where keep)), 4) as label_balance,
       quantile_cont(least(impressions_a, impressions_b), 0.5) filter (where keep) as median_min_impressions
from passes group by alpha""",
    "filter_ledger": f"""
with {PAIRS},
flags as (
  select trim(headline) <> '' as f1, impressions > 0 and clicks between 0 and impressions as f2,
         coalesce(problem, 0) = 0 as f3, image_id is not null as f4 from packages),
stages as (
  select 1 as seq, 'packages loaded' as stage, count(*) as remaining from flags
  union all select 2, 'headline present', count(*) filter (where f1) from flags
  union all select 3, 'outcomes valid', count(*) filter (where f1 and f2) from flags
  union all select 4, 'problem flag clear', count(*) filter (where f1 and f2 and f3) from flags
  union all select 5, 'image id present', count(*) filter (where f1 and f2 and f3 and f4) from flags
  union all select 6, 'arms after aggregation', count(*) from all_arms
  union all select 7, 'arm impressions >= threshold', count(*) from arms
  union all select 8, 'possible pairs', sum(total)::BIGINT from groups
  union all select 9, 'candidate pairs', count(*) from pairs
  union all select 10, 'distinct headlines', count(*) filter (where headline_a <> headline_b) from pairs
  union all select 11, 'non-tied rate', count(*) filter (where not tied) from tested
  union all select 12, 'distinguishable', count(*) from labelled),
notes as (
  select 'possible pairs' as stage, count(*) filter (where n < 2) || ' of ' || count(*) || ' groups have a single arm' as note from groups
  union all select 'candidate pairs', count(*) filter (where total > 40) || ' groups are cut to 40 pairs' from groups
  union all values ('arm impressions >= threshold', 'at least 100 after aggregation'), ('distinguishable', 'two-sided test below 0.1'))
select seq::BIGINT as seq, stage, remaining,
  case when stage <> 'possible pairs' then lag(remaining) over (order by seq) - remaining end as removed, coalesce(note, '') as note
from stages left join notes using (stage)""",
    "temporal_split": f"""
with {SPLIT}
select s.test_id, s.first_at, s.holdout, count(*) as n_pairs
from split s join labelled l using (test_id) group by all""",
    "group_folds": f"""
with {PAIRS}
select {hash_sql('test_id')} % 5 as fold, count(*) as n_pairs, count(distinct test_id) as n_tests,
       sum(label)::BIGINT as n_positive from labelled group by 1""",
    "split_overlap": f"""
with {SPLIT}, h as (select l.*, s.holdout, {hash_sql('test_id')} % 5 as fold from labelled l join split s using (test_id))
select column_name, count(*) filter (where in_train and in_test) as n_shared,
       count(*) filter (where in_train) as n_train, count(*) filter (where in_test) as n_test
from (select 'test_id' as column_name, test_id::VARCHAR as v, bool_or(not holdout) as in_train, bool_or(holdout) as in_test from h group by all
      union all
      select 'headline', v, bool_or(not holdout), bool_or(holdout)
      from (select headline_a as v, holdout from h union all select headline_b, holdout from h) group by all)
group by 1""",
    "text_overlap": f"""
with {SPLIT}, h as (select l.*, s.holdout from labelled l join split s using (test_id)),
seen as (select headline_a as v from h where not holdout union select headline_b from h where not holdout),
held as (select headline_a as v from h where holdout union select headline_b from h where holdout)
select (select count(*) from held) as n_headlines,
       (select count(*) from held where v in (select v from seen)) as n_headlines_seen,
       (select count(*) from h where holdout) as n_pairs,
       (select count(*) from h where holdout and headline_a in (select v from seen)
          and headline_b in (select v from seen)) as n_pairs_both_seen""",
    "train_char_median": f"""
with {PAIRS}
select count(*) as n_arms, floor(quantile_cont(length(headline), 0.5))::BIGINT as char_median
from arms where test_id in (select test_id from labelled)""",
    "label_balance": f"""
with {PAIRS}
select count(*) as n_pairs, sum(label)::BIGINT as n_positive, round(avg(label), 6) as balance,
       avg(label) > 0.4 and avg(label) < 0.6 as balanced from labelled""",
}
