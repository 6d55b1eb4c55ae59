"""Stored forms that later queries read less of: folders by day, bitmaps, histories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohorta.operators import distinct as D
from cohorta.operators import history as H
from cohorta.operators import spine as S
from cohorta.plans.base import events, orders, query
from cohorta.session import scratch_dir
from cohorta.sources import tables

DAILY = "user_id long, event_type string, value double, day date"


def store_events(spark, folder):
    """Events written with a folder per day; the path."""
    path = scratch_dir(spark)
    tables.write_by_day(events(spark, folder, "user_id", "event_type", "value", "ts").withColumn("day", F.to_date("ts")).drop("ts"), path, "day")
    return path


@query("days_of_spine", """
select cast(ts as date) as day, event_type, count(*) as n_events, round(sum(value), 4) as value from events
where cast(ts as date) between date '2024-01-03' and date '2024-01-24' and extract(isodow from ts) in (1, 6, 7) group by all""")
def _(spark, folder):
    spine = S.date_spine(spark, date(2024, 1, 3), date(2024, 1, 24)).where(F.weekday(S.DAY).isin(0, 5, 6))
    found = tables.read_days(spark, store_events(spark, folder), "day", spine, S.DAY, DAILY)
    return found.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("value"))


@query("distinct_from_bitmaps", """
select event_type, cast(date_trunc('week', ts) as date) as first_day, 'week' as period, count(distinct user_id) as n_users from events group by all
union all select event_type, null, 'all', count(distinct user_id) from events group by 1
union all select event_type, date '2024-01-05', '10 days', count(distinct user_id) from events where cast(ts as date) between date '2024-01-05' and date '2024-01-14' group by 1
union all select 'any', null, 'all', count(distinct user_id) from events""")
def _(spark, folder):
    e = events(spark, folder, "user_id", "event_type", "ts").withColumn("day", F.to_date("ts"))
    path = scratch_dir(spark)
    D.daily_bitmaps(e, D.number_ids(e, "user_id"), "user_id", ["day", "event_type"]).write.parquet(path)
    # Every period from here on is answered without the events.
    b = spark.read.schema("day date, event_type string, bucket long, bitmap binary").parquet(path)
    none = F.lit(None).cast("date")
    week = D.distinct_in(b.withColumn("first_day", F.to_date(F.date_trunc("week", "day"))), ["event_type", "first_day"], "n_users").withColumn("period", F.lit("week"))
    whole = D.distinct_in(b, ["event_type"], "n_users").withColumns({"first_day": none, "period": F.lit("all")})
    some = D.distinct_in(b.where("day between date'2024-01-05' and date'2024-01-14'"), ["event_type"], "n_users")
    some = some.withColumns({"first_day": F.lit(date(2024, 1, 5)), "period": F.lit("10 days")})
    every = D.distinct_in(b, [], "n_users").where("n_users is not null").withColumns({"event_type": F.lit("any"), "first_day": none, "period": F.lit("all")})
    return week.unionByName(whole).unionByName(some).unionByName(every)


def monthly_priorities(spark, folder):
    """One row per customer and month with orders: the month's most urgent priority."""
    o = orders(spark, folder).withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate")))
    return o.groupBy("o_custkey", "month").agg(F.min("o_orderpriority").alias("priority"))


@query("versions_from_snapshots", """
with s as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, min(o_orderpriority) as priority from orders group by all),
d as (select month, row_number() over (order by month) as nth, lead(month) over (order by month) as next_month from (select distinct month from s)),
m as (select s.*, nth, next_month, case when lag(priority) over w = priority and lag(nth) over w = nth - 1 then 0 else 1 end as starts from s join d using (month) window w as (partition by o_custkey order by month)),
v as (select *, sum(starts) over (partition by o_custkey order by month) as version from m)
select o_custkey, any_value(priority) as priority, min(month) as valid_from, max_by(coalesce(next_month, date '9999-12-31'), month) as valid_to from v group by o_custkey, version""")
def _(spark, folder):
    out = H.versions(monthly_priorities(spark, folder), ["o_custkey"], "month", ["priority"])
    return out.withColumn("valid_to", F.coalesce("valid_to", F.lit(date(9999, 12, 31))))
