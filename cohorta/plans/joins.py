"""Joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import exposure as E
from cohorta.operators import funnel as U
from cohorta.operators import joins as J
from cohorta.operators import reconcile as K
from cohorta.operators.activity import subsequent_orders
from cohorta.operators.rows import first_per_key
from cohorta.operators.spine import date_spine
from cohorta.plans.base import (
    scan_table,
    SESSIONS_CTE, WINDOWS_CTE, events, lines, orders, query, r, sessions, windows,
)
from cohorta.plans.filters import VERSIONS_CTE, part_versions


# -- equi joins ---------------------------------------------------------------

@query("inner_join", """
select o_orderstatus, count(*) as n_lines, round(sum(l_extendedprice), 2) as value
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus"])
    l = lines(spark, folder, "l_orderkey", "l_extendedprice")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), r(F.sum("l_extendedprice"), 2).alias("value")
    )


@query("left_join", """
select o_orderkey, count(l_partkey) as n_returned from orders
left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by 1""")
def _(spark, folder):
    # The left side is one row per order, so the lines are counted before they are joined.
    back = lines(spark, folder, "l_orderkey", "l_returnflag").where("l_returnflag = 'R'")
    counts = back.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_returned"))
    return scan_table(spark, folder, "orders", ["o_orderkey"]).join(counts, "o_orderkey", "left").fillna(0, ["n_returned"])


@query("using_join", """
with a as (select l_suppkey, l_partkey, count(*) as n_sold from lineitem where l_returnflag <> 'R' group by all),
     b as (select l_suppkey, l_partkey, count(*) as n_back from lineitem where l_returnflag = 'R' group by all)
select * from a join b using (l_suppkey, l_partkey)""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_partkey", "l_returnflag")
    keys = ["l_suppkey", "l_partkey"]
    sold = l.where("l_returnflag <> 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sold"))
    back = l.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_back"))
    return sold.join(back, keys)


@query("reconcile", """
with a as (select l_orderkey as k, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' group by 1),
     b as (select o_orderkey as k, count(*) as n from orders where o_orderdate < timestamp '1998-01-01' group by 1)
select coalesce(a.k, b.k) as order_id, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right,
       case when b.k is null then 'left only' when a.k is null then 'right only' else 'both' end as side
from a full join b on a.k = b.k""")
def _(spark, folder):
    cut = F.lit(date(1998, 1, 1))
    a = lines(spark, folder, "l_orderkey", "l_shipdate").where(F.col("l_shipdate") < cut).select(F.col("l_orderkey").alias("order_id"))
    b = scan_table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]).where(F.col("o_orderdate") < cut).select(F.col("o_orderkey").alias("order_id"))
    return K.reconcile(a, b, ["order_id"])


@query("left_anti", """
select c_custkey from customer where not exists
 (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)""")
def _(spark, folder):
    big = scan_table(spark, folder, "orders", ["o_custkey", "o_totalprice"]).where("o_totalprice > 450000")
    c = scan_table(spark, folder, "customer", ["c_custkey"])
    buyers = big.select("o_custkey").distinct()
    return c.join(buyers, c.c_custkey == buyers.o_custkey, "left_anti")


@query("not_in_subquery", """
select o_orderkey from orders where o_orderkey not in
 (select l_orderkey from lineitem where l_extendedprice > 90000)""")
def _(spark, folder):
    dear = lines(spark, folder, "l_orderkey", "l_extendedprice").where("l_extendedprice > 90000")
    return J.not_in_ids(scan_table(spark, folder, "orders", ["o_orderkey"]), "o_orderkey", dear.select("l_orderkey"), "l_orderkey")


@query("not_in_subquery_with_null", """
select count(*) as n_kept from orders where o_custkey not in
 (select case when c_acctbal > 0 then c_custkey end from customer)""")
def _(spark, folder):
    # One unknown id makes every NOT IN unknown, so nothing is left.
    ids = scan_table(spark, folder, "customer", ["c_custkey", "c_acctbal"]).select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("id"))
    return J.not_in_ids(scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", ids, "id").agg(F.count(F.lit(1)).alias("n_kept"))


@query("in_subquery", """
select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5)""")
def _(spark, folder):
    c = scan_table(spark, folder, "customer", ["c_custkey", "c_nationkey"]).where("c_nationkey < 5")
    return J.in_ids(scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", c, "c_custkey").select("o_orderkey")


@query("in_subquery_in_on", """
select c_custkey, count(o_orderkey) as n_orders from customer
left join orders on o_custkey = c_custkey
  and o_orderkey in (select l_orderkey from lineitem where l_quantity = 50) group by 1""")
def _(spark, folder):
    c = scan_table(spark, folder, "customer", ["c_custkey"])
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_custkey", "c_custkey")
    full = lines(spark, folder, "l_orderkey", "l_quantity").where("l_quantity = 50")
    joined = J.left_join_if_in(c, o, ["c_custkey"], "o_orderkey", full, "l_orderkey")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("merge_with_suffixes", """
with d as (select cast(o_orderdate as date) as day, o_orderstatus as s, count(*) as n from orders group by all)
select coalesce(a.day, b.day) as day, a.n as n_control, b.n as n_variant
from (select * from d where s = 'F') a full join (select * from d where s = 'O') b on a.day = b.day""")
def _(spark, folder):
    daily = orders(spark, folder).groupBy("day", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    a = daily.where("o_orderstatus = 'F'").select("day", F.col("n").alias("n_control"))
    b = daily.where("o_orderstatus = 'O'").select("day", F.col("n").alias("n_variant"))
    return a.join(b, "day", "full")


@query("dimension_chain", """
select r_name, n_name, s_suppkey, p_type, count(*) as n_lines
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey
where s_acctbal > 0 and r_name in ('ASIA', 'EUROPE') group by all""")
def _(spark, folder):
    # Dimensions carry no hint: Spark broadcasts those it finds small and shuffles the
    # others. Lines are counted per (store, product) before they meet them.
    counted = lines(spark, folder, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    region = scan_table(spark, folder, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nation = scan_table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    store = scan_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).where("s_acctbal > 0")
    store = store.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = scan_table(spark, folder, "part", ["p_partkey", "p_type"])
    joined = counted.join(store, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("r_name", "n_name", "s_suppkey", "p_type").agg(F.sum("n").alias("n_lines"))


@query("snapshot_date_join", """
with snap as (select o_custkey, cast(o_orderdate as date) as d, max(o_totalprice) as top from orders group by all)
select o_orderkey, top from orders o join snap s on s.o_custkey = o.o_custkey and s.d = cast(o.o_orderdate as date)""")
def _(spark, folder):
    o = orders(spark, folder).select("o_orderkey", "o_custkey", "day", "o_totalprice")
    snap = o.groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("top"))
    return o.join(snap, ["o_custkey", "day"]).select("o_orderkey", "top")


# -- windows of time ----------------------------------------------------------

_EVENT_VARIANT = f"with {WINDOWS_CTE} select e.event_id, w.variant from events e @how@ join windows w on w.customer_id = e.user_id and e.ts >= w.start_time and e.ts < w.end_time where e.event_type = 'purchase'"


def _purchases(spark, folder):
    e = events(spark, folder, "event_id", "ts", "user_id", "event_type").where("event_type = 'purchase'")
    return e.select("event_id", "ts", F.col("user_id").alias("customer_id"))


@query("assign_variant", _EVENT_VARIANT.replace("@how@", ""))
def _(spark, folder):
    found = E.assign_variant(_purchases(spark, folder), windows(spark, folder), ["customer_id"], "ts")
    return found.select("event_id", "variant")


@query("assign_variant_left", _EVENT_VARIANT.replace("@how@", "left"))
def _(spark, folder):
    found = E.assign_variant(_purchases(spark, folder), windows(spark, folder), ["customer_id"], "ts", how="left")
    return found.select("event_id", "variant")


_ANY_EVENT_VARIANT = f"with {WINDOWS_CTE} select e.event_id, w.variant from events e @how@ join windows w on w.customer_id = e.user_id and e.ts between w.start_time and w.end_time"


@query("assign_variant_closed", _ANY_EVENT_VARIANT.replace("@how@", ""))
def _(spark, folder):
    # Sign-ups themselves lie on window borders and match the window they end and the
    # one they begin.
    e = events(spark, folder, "event_id", "ts", "user_id").withColumnRenamed("user_id", "customer_id")
    return E.assign_variant_closed(e, windows(spark, folder), ["customer_id"], "ts").select("event_id", "variant")


@query("assign_variant_closed_left", _ANY_EVENT_VARIANT.replace("@how@", "left"))
def _(spark, folder):
    e = events(spark, folder, "event_id", "ts", "user_id").withColumnRenamed("user_id", "customer_id")
    return E.assign_variant_closed(e, windows(spark, folder), ["customer_id"], "ts", how="left").select("event_id", "variant")


@query("orders_by_variant_not_found", f"""
with {WINDOWS_CTE}
select cast(e.ts as date) as day, coalesce(w.variant, 'no variant') as variant,
       count(distinct e.user_id) as customers, count(distinct e.event_id) as orders, round(sum(e.value), 2) as gmv
from events e left join windows w on w.customer_id = e.user_id and e.ts >= w.start_time and e.ts < w.end_time
where e.event_type = 'purchase' group by all""")
def _(spark, folder):
    e = events(spark, folder, "event_id", "ts", "user_id", "event_type", "value").where("event_type = 'purchase'")
    e = e.withColumnRenamed("user_id", "customer_id")
    found = E.assign_variant(e, windows(spark, folder), ["customer_id"], "ts", how="left")
    found = found.withColumn("variant", F.coalesce("variant", F.lit("no variant"))).withColumn("day", F.to_date("ts"))
    per_customer = found.groupBy("day", "variant", "customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return per_customer.groupBy("day", "variant").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"), r(F.sum("v"), 2).alias("gmv")
    )


@query("scd2_point_in_time_join", f"""
with {VERSIONS_CTE}
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, v.start_date, v.discount
from lineitem l left join versions v on v.l_partkey = l.l_partkey
 and cast(l.l_shipdate as date) between v.start_date and coalesce(v.end_date - 1, date '9999-12-31')""")
def _(spark, folder):
    facts = lines(spark, folder, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    facts = facts.withColumn("day", F.to_date("l_shipdate"))
    joined = J.point_in_time_join(facts, part_versions(spark, folder), ["l_partkey"], "day", "start_date", "end_date", ["discount"])
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start_date", "discount")


@query("ordered_step_join", f"""
with {SESSIONS_CTE}
select a.event_id, count(distinct b.event_id) > 0 as has_later_purchase,
       coalesce(bool_or(b.ts > a.ts), false) as strictly_later
from sessions a left join sessions b on a.session_id = b.session_id and b.event_type = 'purchase' and b.ts >= a.ts
where a.event_type = 'view' group by 1""")
def _(spark, folder):
    s = sessions(spark, folder)
    views = s.where("event_type = 'view'").select("event_id", "session_id", "ts")
    buys = s.where("event_type = 'purchase'").groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    joined = views.join(buys, "session_id", "left")
    return joined.select(
        "event_id",
        F.coalesce(F.col("last_ts") >= F.col("ts"), F.lit(False)).alias("has_later_purchase"),
        F.coalesce(F.col("last_ts") > F.col("ts"), F.lit(False)).alias("strictly_later"),
    )


@query("interval_join", """
select a.event_id as view_id, b.event_id as click_id from events a join events b
 on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 60 minute
where a.event_type = 'view' and b.event_type = 'click'""")
def _(spark, folder):
    e = events(spark, folder, "event_id", "ts", "user_id", "event_type")
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return J.interval_join(a, b, ["user_id"], "view_ts", "click_ts", 3600).select("view_id", "click_id")


@query("or_condition_join", f"""
with {SESSIONS_CTE},
taps as (select event_id, session_id, ts, cast(json_extract_string(props, '$.k') as bigint) % 10 as tapped from sessions where event_type = 'click'),
opened as (select event_id, session_id, ts, cast(floor(value) as bigint) % 10 as item, cast(floor(value * 10) as bigint) % 10 as item_group
           from sessions where event_type = 'view')
select t.event_id as tap_id, o.event_id as open_id,
       case when t.tapped = o.item then 'item' when t.tapped = o.item_group then 'group' else 'neither' end as kind
from taps t join opened o on t.session_id = o.session_id and (t.tapped = o.item or t.tapped = o.item_group)
 and o.ts between t.ts and t.ts + interval 3 hour""")
def _(spark, folder):
    s = sessions(spark, folder)
    k = F.get_json_object("props", "$.k").cast("long")
    # Three hours in these slow sessions play the two minutes of an app.
    taps = s.where("event_type = 'click'").select("session_id", F.col("event_id").alias("tap_id"), (k % 10).alias("tapped"), F.col("ts").alias("tapped_at"))
    opened = s.where("event_type = 'view'").select(
        "session_id", F.col("event_id").alias("open_id"), F.col("ts").alias("opened_at"),
        (F.floor("value") % 10).alias("item"), (F.floor(F.col("value") * 10) % 10).alias("item_group"),
    )
    pairs = J.either_key_within(taps, opened, ["session_id"], "tapped", "item", "item_group", "tapped_at", "opened_at", 3 * 3600)
    kind = C.case_map([(F.col("tapped") == F.col("item"), "item"), (F.col("tapped") == F.col("item_group"), "group")], "neither")
    return pairs.select("tap_id", "open_id", kind.alias("kind"))


@query("self_followup_join", """
select o.o_orderkey, count(distinct n.o_orderkey) as orders_28d from orders o
left join orders n on n.o_custkey = o.o_custkey and n.o_orderkey <> o.o_orderkey
 and cast(n.o_orderdate as date) between cast(o.o_orderdate as date) and cast(o.o_orderdate as date) + 28 group by 1""")
def _(spark, folder):
    o = orders(spark, folder).select("o_orderkey", "o_custkey", "day")
    return subsequent_orders(o, ["o_custkey"], "day", 28, F.lit(False)).select("o_orderkey", F.col("orders_after").alias("orders_28d"))


@query("cross_vertical_self_join", """
select f.event_id, min(g.ts) as next_grocery_at from events f join events g
 on g.user_id = f.user_id and g.ts >= f.ts and g.ts <= f.ts + interval 24 hour and g.event_type = 'purchase'
where f.event_type = 'click' group by 1""")
def _(spark, folder):
    e = events(spark, folder, "event_id", "ts", "user_id", "event_type")
    food = e.where("event_type = 'click'").select("event_id", "ts", "user_id")
    grocery = e.where("event_type = 'purchase'").select("ts", "user_id")
    hits = U.next_within(food, grocery, ["user_id"], "ts", "ts", 86400, "next_grocery_at")
    return hits.where(F.col("next_grocery_at").isNotNull()).select("event_id", "next_grocery_at")


def order_lines(spark, folder):
    """One line per (order, line number); the next number of the order replaces a
    returned line."""
    l = lines(spark, folder, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    one = first_per_key(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return one.withColumn("line_id", line_id).withColumn("replaced_by", F.when(F.col("l_returnflag") == "R", F.col("line_id") + 1))


LINES_CTE = """
one_line as (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) = 1),
order_lines as (select *, l_orderkey * 10 + l_linenumber as line_id,
   case when l_returnflag = 'R' then l_orderkey * 10 + l_linenumber + 1 end as replaced_by from one_line)"""


@query("replacement_self_join", f"""
with {LINES_CTE}
select a.line_id, a.l_partkey, a.l_quantity, b.l_partkey as new_l_partkey, b.l_quantity as new_l_quantity
from order_lines a left join order_lines b on a.replaced_by = b.line_id""")
def _(spark, folder):
    l = order_lines(spark, folder).select("line_id", "replaced_by", "l_partkey", "l_quantity")
    return J.replacement_join(l, "line_id", "replaced_by", ["l_partkey", "l_quantity"]).drop("replaced_by")


@query("date_theta_join", f"""
with {WINDOWS_CTE},
spine as (select cast(unnest(generate_series(date '2024-01-01', date '2024-02-03', interval 1 day)) as date) as calendar_date)
select calendar_date, count(case when variant = 'control' then customer_id end) as n_control,
       count(case when variant = 'treatment' then customer_id end) as n_treatment
from spine left join windows on calendar_date between start_time and end_time group by 1""")
def _(spark, folder):
    spine = date_spine(spark, date(2024, 1, 1), date(2024, 2, 3))
    return E.active_windows_by_day(windows(spark, folder), spine, ["control", "treatment"])
