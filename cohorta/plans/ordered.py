"""Window functions, ranks and running values."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import activity as V
from cohorta.operators import exposure as E
from cohorta.operators import ranks as R
from cohorta.operators import rows as P
from cohorta.operators import splits as L
from cohorta.operators.scans import next_known, ordered_scans
from cohorta.plans.base import (
    scan_table,
    EXPOSURES_CTE, SESSIONS_CTE, WINDOWS_CTE, events, exposures, lines, orders, query, r, sessions, windows,
)


@query("exposure_windows", f"with {WINDOWS_CTE} select event_id, customer_id, variant, start_time, end_time from windows")
def _(spark, folder):
    return windows(spark, folder).select("event_id", "customer_id", "variant", "start_time", "end_time")


@query("exposure_windows_by_day", f"""
with {EXPOSURES_CTE}
select distinct customer_id, variant, cast(ts as date) as start_time,
 coalesce(lead(cast(ts as date)) over (partition by customer_id order by cast(ts as date), event_id), date '2024-01-31') as end_time from exposures""")
def _(spark, folder):
    e = exposures(spark, folder).withColumn("ts", F.to_date("ts"))
    w = E.exposure_windows(e, ["customer_id"], "ts", F.lit("2024-01-31").cast("date"), ["event_id"])
    return w.select("customer_id", "variant", "start_time", "end_time").distinct()


@query("exposure_windows_two_experiments", """
with e as (select case when value < 10 then 'a' else 'b' end as experiment, user_id, ts, event_id from events where event_type = 'signup')
select event_id, experiment, ts as start_time,
 coalesce(lead(ts) over (partition by experiment, user_id order by ts, event_id), timestamp '2024-01-15 12:00:00') as end_time from e""")
def _(spark, folder):
    e = events(spark, folder, "event_id", "user_id", "ts", "value", "event_type").where("event_type = 'signup'")
    e = e.select(F.when(F.col("value") < 10, "a").otherwise("b").alias("experiment"), "user_id", "ts", "event_id")
    w = E.exposure_windows(e, ["experiment", "user_id"], "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), ["event_id"])
    return w.select("event_id", "experiment", "start_time", "end_time")


@query("last_entry_per_key", """
select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    return P.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("first_session_per_customer", f"""
with {SESSIONS_CTE}
select user_id, session_id, session_start from (select distinct user_id, session_id, session_start from sessions)
qualify row_number() over (partition by user_id order by session_start) = 1""")
def _(spark, folder):
    s = sessions(spark, folder).select("user_id", "session_id", "session_start")
    return P.first_per_key(s, ["user_id"], ["session_start"])


@query("any_one_per_key", """
select user_id, event_type, event_id from events
qualify row_number() over (partition by user_id, event_type order by md5('7|' || event_id), event_id) = 1""")
def _(spark, folder):
    e = events(spark, folder, "user_id", "event_type", "event_id")
    return P.any_one_per_key(e, ["user_id", "event_type"], ["event_id"], seed="7")


@query("rank_with_ties", """
select o_custkey, o_orderkey from orders qualify rank() over (partition by o_custkey order by cast(o_orderdate as date)) = 1""")
def _(spark, folder):
    return P.keep_smallest_with_ties(orders(spark, folder).select("o_custkey", "o_orderkey", "day"), ["o_custkey"], "day").select("o_custkey", "o_orderkey")


@query("dense_rank_first", f"""
with {SESSIONS_CTE}
select session_id, event_id, ts from (select distinct session_id, event_id, ts from sessions where event_type = 'view')
qualify dense_rank() over (partition by session_id order by ts) = 1""")
def _(spark, folder):
    views = sessions(spark, folder).where("event_type = 'view'").select("session_id", "event_id", "ts").distinct()
    return P.keep_smallest_with_ties(views, ["session_id"], "ts")


@query("percent_rank_trim", """
with n as (select c_nationkey, c_custkey, count(o_orderkey) as n_orders from customer join orders on o_custkey = c_custkey group by all)
select c_nationkey, c_custkey, n_orders from n
qualify percent_rank() over (partition by c_nationkey order by n_orders) < 0.9""")
def _(spark, folder):
    counts = scan_table(spark, folder, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    n = scan_table(spark, folder, "customer", ["c_custkey", "c_nationkey"]).join(counts, "c_custkey")
    return R.ranked(n, ["c_nationkey"], "n_orders").where("rank_percent < 0.9").select("c_nationkey", "c_custkey", "n_orders")


@query("lead_ignore_nulls", """
select event_id, lead(case when event_type = 'purchase' then ts end ignore nulls) over (partition by user_id order by ts, event_id) as next_purchase_at
from events""")
def _(spark, folder):
    e = events(spark, folder, "event_id", "user_id", "ts", "event_type").withColumn("bought_at", F.when(F.col("event_type") == "purchase", F.col("ts")))
    out = ordered_scans(e, ["user_id"], ["ts", "event_id"], {"next_purchase_at": next_known("bought_at")})
    return out.select("event_id", "next_purchase_at")


@query("first_value_collapse", f"""
with {SESSIONS_CTE}
select distinct session_id, first_value(user_id) over (partition by session_id order by ts, user_id) as user_id,
 first_value(day) over (partition by session_id order by day) as day,
 first_value(event_type) over (partition by session_id order by value, event_type) as event_type,
 first_value(ts) over (partition by session_id order by ts) as ts from sessions""")
def _(spark, folder):
    return P.collapse_first_values(sessions(spark, folder), ["session_id"], {"user_id": "ts", "day": "day", "event_type": "value", "ts": "ts"})


@query("range_window_activity", """
with d as (select *, cast(o_orderdate as date) as day, o_orderpriority in ('1-URGENT', '2-HIGH') as wanted from orders)
select o_orderkey,
 count(case when wanted then 1 end) over before as n_before, round(coalesce(sum(case when wanted then o_totalprice end) over before, 0), 2) as value_before,
 round(coalesce(avg(case when wanted then o_totalprice end) over before, 0), 6) as average_before,
 count(case when wanted then 1 end) over after30 as n_after30, round(coalesce(sum(case when wanted then o_totalprice end) over after30, 0), 2) as value_after30,
 count(case when wanted then 1 end) over after28 as n_after28 from d
window before as (partition by o_custkey order by day range between interval 31 day preceding and interval 1 day preceding),
 after30 as (partition by o_custkey order by day range between interval 1 day following and interval 31 day following),
 after28 as (partition by o_custkey order by day range between interval 1 day following and interval 29 day following)""")
def _(spark, folder):
    frames = {"before": (-31, -1), "after30": (1, 31), "after28": (1, 29)}
    wanted = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    out = V.activity_around(orders(spark, folder), ["o_custkey"], "day", F.col("o_totalprice"), wanted, frames)
    return out.select(
        "o_orderkey", "n_before", r("value_before", 2).alias("value_before"), r("average_before").alias("average_before"),
        "n_after30", r("value_after30", 2).alias("value_after30"), "n_after28",
    )


@query("running_total_weekly", """
with w as (select o_orderstatus, cast(date_trunc('week', o_orderdate) as date) as week, count(*) as n_orders from orders group by all)
select *, cast(sum(n_orders) over (partition by o_orderstatus order by week) as bigint) as orders_so_far from w""")
def _(spark, folder):
    weekly = scan_table(spark, folder, "orders").groupBy("o_orderstatus", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n_orders"))
    return R.running_total(weekly, ["o_orderstatus"], "week", "n_orders", "orders_so_far")


@query("share_of_total", """
with s as (select n_regionkey, n_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by all)
select n_regionkey, n_name, n, round(n / sum(n) over (), 6) as share, round(n / sum(n) over (partition by n_regionkey), 6) as share_of_region from s""")
def _(spark, folder):
    s = scan_table(spark, folder, "supplier", ["s_nationkey"]).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    named = s.join(scan_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_name", "n")
    out = R.share_of_total(R.share_of_total(named, "n"), "n", ["n_regionkey"], "share_of_region")
    return out.withColumn("share", r("share")).withColumn("share_of_region", r("share_of_region"))


@query("cumulative_share", """
with w as (select l_partkey, sum(l_quantity) as weight from lineitem group by 1)
select l_partkey, weight, round(100 * weight / sum(weight) over (), 6) as share,
 round(100 * sum(weight) over (order by weight desc, l_partkey rows unbounded preceding) / sum(weight) over (), 6) as cumulative_share from w""")
def _(spark, folder):
    w = lines(spark, folder, "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("weight"))
    out = R.cumulative_share(w, "l_partkey", "weight")
    return out.withColumn("share", r("share")).withColumn("cumulative_share", r("cumulative_share"))


@query("rolling_mean", """
with d as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1)
select day, case when count(n) over f21 >= 21 then round(avg(n) over f21, 6) end as mean_21,
 round(avg(n) over f7, 6) as mean_7 from d
window f21 as (order by day rows 20 preceding), f7 as (order by day rows 6 preceding)""")
def _(spark, folder):
    d = orders(spark, folder).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    out = R.rolling_mean(R.rolling_mean(d, [], "day", "n", 21, 21, "mean_21"), [], "day", "n", 7, 1, "mean_7")
    return out.select("day", r("mean_21").alias("mean_21"), r("mean_7").alias("mean_7"))


@query("first_difference", """
with d as (select o_orderstatus, cast(o_orderdate as date) as day, count(*) as n from orders group by all)
select o_orderstatus, day, n - lag(n) over (partition by o_orderstatus order by day) as difference from d""")
def _(spark, folder):
    d = orders(spark, folder).groupBy("o_orderstatus", "day").agg(F.count(F.lit(1)).alias("n"))
    return R.first_difference(d, ["o_orderstatus"], "day", "n").drop("n")


@query("rank_dense_and_average", """
with w as (select l_partkey, sum(l_quantity) as q from lineitem group by 1)
select l_partkey, dense_rank() over (order by q desc) as rank_dense, rank() over (order by q desc) as rank_min,
 rank() over (order by q desc) + (count(*) over (partition by q) - 1) / 2 as rank_avg from w""")
def _(spark, folder):
    w = lines(spark, folder, "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return R.ranked(w, [], "q", descending=True).select("l_partkey", "rank_dense", "rank_min", "rank_avg")


_DIFF = """
with d as (select cast(date_trunc('month', l_shipdate) as date) as month,
 round(sum(case when l_returnflag = 'R' then l_quantity else 0 end) - sum(case when l_returnflag = 'A' then l_quantity else 0 end), 2) as difference
 from lineitem where l_returnflag in ('A', 'R') group by 1)"""


@query("cumulative_difference", _DIFF + "select month, difference, round(sum(difference) over (order by month), 2) as cumulative_difference from d")
def _(spark, folder):
    l = lines(spark, folder, "l_shipdate", "l_returnflag", "l_quantity").where(F.col("l_returnflag").isin("A", "R"))
    l = l.withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))
    return L.cumulative_difference(l, [], "month", "l_returnflag", "l_quantity", "R", "A")


@query("tenure_of_orders", """
with f as (select o_custkey, cast(min(o_orderdate) as date) as first_day from orders group by 1)
select o_orderkey, (cast(o_orderdate as date) - first_day) // 28 as periods from orders join f using (o_custkey)""")
def _(spark, folder):
    o = orders(spark, folder).select("o_orderkey", "o_custkey", "day")
    first = o.groupBy("o_custkey").agg(F.min("day").alias("first_day"))
    return o.join(first, "o_custkey").select("o_orderkey", C.tenure_periods("first_day", "day").alias("periods"))
