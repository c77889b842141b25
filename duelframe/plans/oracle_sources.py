"""Oracle SQL (DuckDB) for what is written and read back."""

from .oracle_monitoring import ACTIVITY
from .oracle_pairs import ARMS, PACKAGES
from .oracle_ranking import SETS

SQL = {
    "archive_arms": f"""with {ARMS} select test_id::VARCHAR as test_id, image_id, headline, clicks, impressions, created_at,
  case when subset = 'F' then 'confirmatory' else 'exploratory' end as subset, round(ctr, 6) as ctr from arms""",
    "archive_manifest": f"""with {PACKAGES}
select case when subset = 'F' then 'confirmatory' else 'exploratory' end as subset, count(*) as data_rows,
  case when subset = 'F' then count(*) else -1 end as expected_packages, subset = 'F' as rows_match, true as hashed from packages group by subset""",
    "saved_rankings": f"""with {SETS} select ranking_id, 'hand-1' as model_version, count(*) as n_lines, count(*) as n_items,
  sum(char_count)::BIGINT as n_chars from f group by 1""",
    "appended_outcomes": f"""with {ACTIVITY}
select user_id, count(*) as n, sum(case when (props->>'$.k')::BIGINT % 5 <> 0 then floor(value / 10) end)::BIGINT as clicks
from activity where name = 'outcome_reported' group by 1""",
    "run_report": f"""with {PACKAGES}, flags as (
  select trim(headline) <> '' as f1, impressions > 0 and clicks between 0 and impressions as f2,
         coalesce(problem, 0) = 0 as f3, image_id is not null as f4 from packages)
select 1::BIGINT as seq, 'packages loaded' as stage, count(*) as remaining from flags
union all select 2, 'headline present', count(*) filter (where f1) from flags
union all select 3, 'outcomes valid', count(*) filter (where f1 and f2) from flags
union all select 4, 'problem flag clear', count(*) filter (where f1 and f2 and f3) from flags
union all select 5, 'image id present', count(*) filter (where f1 and f2 and f3 and f4) from flags""",
}
