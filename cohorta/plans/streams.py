"""Streams over the event table, run until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.plans.base import SCHEMAS, SESSION_GAP, SESSIONS_CTE, query
from cohorta.session import scratch_dir
from cohorta.streaming import joins, runs, sessions

LATE = 3600


def event_stream(spark, folder):
    return runs.read_files(spark, f"{folder}/events.parquet", SCHEMAS["events"], "ts").select("event_id", "ts", "user_id", "event_type")


def _finish(spark, stream):
    return runs.run_to_end(stream, scratch_dir(spark), scratch_dir(spark))


@query("stream_session_funnel", f"""
with {SESSIONS_CTE}, s as (select user_id, session_start, max(ts) as last_event, count(*) as n_events, min(case when event_type = 'view' then ts end) as t_view from sessions where user_id is not null group by all),
c as (select s.user_id, s.session_start, min(e.ts) as t_click from s join sessions e using (user_id, session_start) where event_type = 'click' and e.ts >= t_view group by all),
p as (select c.user_id, c.session_start, min(e.ts) as t_purchase from c join sessions e using (user_id, session_start) where event_type = 'purchase' and e.ts >= t_click group by all)
select user_id, session_start, last_event, n_events, t_view, t_click, t_purchase from s left join c using (user_id, session_start) left join p using (user_id, session_start)
where last_event + interval {SESSION_GAP} second + interval 1 microsecond <= (select max(ts) from events) - interval {LATE} second""")
def _(spark, folder):
    steps = [(kind, F.col("event_type") == kind) for kind in ("view", "click", "purchase")]
    out = _finish(spark, sessions.session_funnels(event_stream(spark, folder), "user_id", "ts", SESSION_GAP, steps, LATE))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in out.columns if c not in ("user_id", "n_events")})


@query("stream_interval_join", """
select a.event_id as view_id, b.event_id as click_id from events a join events b
 on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 60 minute
where a.event_type = 'view' and b.event_type = 'click'""")
def _(spark, folder):
    views = event_stream(spark, folder).where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    clicks = event_stream(spark, folder).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return _finish(spark, joins.interval_join(views, clicks, ["user_id"], "view_ts", "click_ts", 3600, LATE)).select("view_id", "click_id")
