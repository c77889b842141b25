"""Oracle SQL (DuckDB) for bounded replays of streams and token positions."""

from .oracle_monitoring import ACTIVITY, SQL as MONITORING

SQL = {
    "stream_rate_limit": f"""with {ACTIVITY},
w as (select user_id, time_bucket(interval 10 seconds, ts) - k * interval 10 seconds as started_at from activity, range(0, 6) r(k))
select started_at, user_id, count(*) as n, count(*) > 30 as over_limit from w group by 1, 2""",
    "stream_funnel": f"""with {ACTIVITY},
w as (select name, date_trunc('hour', ts) - k * interval 1 hour as started_at from activity, range(0, 24) r(k))
select started_at, name, count(*) as n from w group by 1, 2""",
    "stream_sessions": MONITORING["activity_sessions"],
    "stream_dedup": f"with {ACTIVITY} select name, count(*) as n, count(distinct event_id) as n_ids from activity group by 1",
    "stream_health": """
with d as (select date_trunc('day', ts) as started_at, round(1 / (1 + exp(-(value - 50) / 40)), 12) as p from events)
select started_at, count(*) as n, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, round(avg((abs(p - 0.5) < 0.05)::INT::DOUBLE), 6) + 0.0 as near_half,
  avg((abs(p - 0.5) < 0.05)::INT::DOUBLE) > 0.8 or stddev_pop(p) < 0.02 as degenerate from d group by 1""",
    "token_spans": """
with pieces as (select conv_id, turn, unnest(p) as piece, unnest(range(len(p))) as n
  from (select conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{Nd}''’]+|[^\\p{L}\\p{Nd}''’]+') as p from conversations)),
placed as (select *, coalesce(sum(length(piece)) over (partition by conv_id, turn order by n rows between unbounded preceding and 1 preceding), 0)::BIGINT as pos,
         length(piece) - length(ltrim(piece, '''’')) as lead_, trim(piece, '''’') as token from pieces where true)
select conv_id, turn, token, pos + lead_ as start, pos + lead_ + length(token) as "end"
from placed where regexp_matches(piece, '^[\\p{L}\\p{Nd}''’]') and token <> ''""",
}
