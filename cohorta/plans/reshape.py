"""Sorting, limits, reshaping, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import nested as N
from cohorta.operators import ranks as R
from cohorta.operators import reshape as W
from cohorta.operators import rows as P
from cohorta.operators.funnel import session_timeline
from cohorta.operators.joins import in_ids
from cohorta.plans.base import SESSIONS_CTE, events, lines, orders, query, r, sessions, scan_table


@query("order_by", """
select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"])
    return o.orderBy(F.col("o_orderdate").desc(), "o_orderkey")


_TOP = "(select o_custkey as customer, count(*) as n from orders group by 1 order by n desc, customer limit 150)"


@query("top_k_groups", f"""
select o_custkey, o_orderkey, o_totalprice from orders where o_custkey in (select customer from {_TOP})""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    counts = o.groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("n"))
    return in_ids(o, "o_custkey", R.top_k(counts, "n", "customer", 150), "customer")


@query("top_k", f"select * from {_TOP}")
def _(spark, folder):
    counts = scan_table(spark, folder, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(counts, "n", "customer", 150)


@query("limit", f"""
with {SESSIONS_CTE}
select session_id, count(*) as n from sessions group by 1 order by n desc, session_id limit 20""")
def _(spark, folder):
    counts = sessions(spark, folder).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(counts, "n", "session_id", 20)


@query("argmin", """
select o_orderstatus, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest from orders group by 1""")
def _(spark, folder):
    return scan_table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest")
    )


@query("union_all", """
select l_suppkey, 'returned' as kind, count(*) as n from lineitem where l_returnflag = 'R' group by 1
union all select l_suppkey, 'closed' as kind, count(*) as n from lineitem where l_linestatus = 'F' group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_returnflag", "l_linestatus")
    part = lambda cond, kind: l.where(cond).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return part("l_returnflag = 'R'", "returned").unionByName(part("l_linestatus = 'F'", "closed"))


_PIVOT = ", ".join(
    f"sum(case when o_orderstatus = '{v}' then {e} end) as {m}_{v}" for v in "FOP" for m, e in (("orders", "1"), ("customers_mod", "o_custkey % 7"))
)


@query("pivot", f"select cast(o_orderdate as date) as day, {_PIVOT.replace('sum(', 'sum(1 * ')} from orders group by 1")
def _(spark, folder):
    metrics = {"orders": F.sum(F.lit(1)), "customers_mod": F.sum(F.col("o_custkey") % 7)}
    return W.pivot_metrics(orders(spark, folder), ["day"], "o_orderstatus", ["F", "O", "P"], metrics)


@query("pivot_single_metric", """
select l_suppkey, sum(case when l_returnflag = 'A' then l_quantity end) as "qty_A",
 sum(case when l_returnflag = 'N' then l_quantity end) as "qty_N", sum(case when l_returnflag = 'R' then l_quantity end) as "qty_R"
from lineitem group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_returnflag", "l_quantity")
    return W.pivot_metrics(l, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], {"qty": F.sum("l_quantity")})


@query("conditional_sum_pivot", """
with long as (unpivot (select o_custkey, cast(count(*) as double) as n_orders, round(sum(o_totalprice), 2) as gmv from orders group by 1)
              on n_orders, gmv into name metric value value)
select o_custkey, sum(case when metric = 'n_orders' then value else 0 end) as n_orders, sum(case when metric = 'gmv' then value else 0 end) as gmv
from long group by 1""")
def _(spark, folder):
    wide = scan_table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), r(F.sum("o_totalprice"), 2).alias("gmv"))
    long = W.unpivot_metrics(wide, ["o_custkey"], ["n_orders", "gmv"])
    pick = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")).otherwise(0.0)).alias(m)
    return long.groupBy("o_custkey").agg(pick("n_orders"), pick("gmv"))


@query("unpivot", """
unpivot (select o_custkey, cast(count(*) as double) as n_orders, round(sum(o_totalprice), 2) as gmv, max(o_totalprice) as biggest from orders group by 1)
on n_orders, gmv, biggest into name metric value value""")
def _(spark, folder):
    wide = scan_table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), r(F.sum("o_totalprice"), 2).alias("gmv"), F.max("o_totalprice").alias("biggest")
    )
    return W.unpivot_metrics(wide, ["o_custkey"], ["n_orders", "gmv", "biggest"])


@query("bin_fixed", """
select case when l_discount >= 0 and l_discount <= 0.02 then 'none to 2 %' when l_discount <= 0.04 then 'to 4 %' when l_discount <= 0.06 then 'to 6 %'
 when l_discount <= 0.08 then 'to 8 %' when l_discount <= 0.1 then 'to 10 %' else 'unknown' end as tier, count(*) as n
from (select case when l_returnflag <> 'N' then l_discount end as l_discount from lineitem) group by 1""")
def _(spark, folder):
    d = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    tier = C.fixed_bins(d, [0.0, 0.02, 0.04, 0.06, 0.08, 0.1], ["none to 2 %", "to 4 %", "to 6 %", "to 8 %", "to 10 %"], "unknown")
    return lines(spark, folder, "l_discount", "l_returnflag").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("threshold_bins", """
select case when o_totalprice <= 100000 then 'low' when o_totalprice <= 300000 then 'medium' else 'high' end as level, count(*) as n from orders group by 1""")
def _(spark, folder):
    level = C.threshold_label("o_totalprice", [100000, 300000], ["low", "medium", "high"])
    return scan_table(spark, folder, "orders", ["o_totalprice"]).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("histogram", """
with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as total from orders),
b as (select least(cast(floor((o_totalprice - lo) / (hi - lo) * 20) as bigint), 19) as bin, count(*) as n from orders, e group by 1),
f as (select g.bin, coalesce(n, 0) as n, lo, hi, total from (select unnest(range(20)) as bin) g left join b using (bin), e)
select bin, n, round(lo + bin * (hi - lo) / 20, 4) as bin_from, round(lo + (bin + 1) * (hi - lo) / 20, 4) as bin_to,
 round(n / (total * (hi - lo) / 20), 12) as density, round(sum(n) over (order by bin) / total, 6) as cumulative from f""")
def _(spark, folder):
    h = W.histogram(scan_table(spark, folder, "orders", ["o_totalprice"]), "o_totalprice", 20)
    return h.select("bin", "n", r("bin_from", 4).alias("bin_from"), r("bin_to", 4).alias("bin_to"), r("density", 12).alias("density"), r("cumulative").alias("cumulative"))


@query("box_stats", """
with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1)
select event_type, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
 min(case when value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then value end) as whisker_low,
 max(case when value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then value end) as whisker_high,
 count(case when value not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then 1 end) as n_outliers
from events join q using (event_type) group by event_type, q1, median, q3""")
def _(spark, folder):
    out = R.box_stats(events(spark, folder, "event_type", "value"), ["event_type"], "value")
    return out.withColumn("q1", r("q1", 4)).withColumn("median", r("median", 4)).withColumn("q3", r("q3", 4))


@query("one_random_row_per_group", """
select c_mktsegment, c_custkey, c_name from customer
qualify row_number() over (partition by c_mktsegment order by md5('sample|' || c_custkey), c_custkey) = 1""")
def _(spark, folder):
    return P.any_one_per_key(scan_table(spark, folder, "customer", ["c_mktsegment", "c_custkey", "c_name"]), ["c_mktsegment"], ["c_custkey"], seed="sample")


@query("session_timeline", f"""
with {SESSIONS_CTE}
select session_id, ts, event_id, event_type, value from sessions
where user_id in (select user_id from events where value > 300) order by session_id, ts""")
def _(spark, folder):
    big = events(spark, folder, "user_id", "value").where("value > 300").select("user_id")
    s = in_ids(sessions(spark, folder), "user_id", big.withColumnRenamed("user_id", "wanted"), "wanted")
    return session_timeline(s, "session_id", F.lit(True), "ts", ["event_id", "event_type", "value"])


@query("explode_list_count", """
with x as (select l_suppkey, cast(l_shipdate as date) as day,
  unnest([l_partkey, l_partkey + l_linenumber, l_partkey % 10]) as item from lineitem)
select l_suppkey, day, count(distinct item) as n_items from x group by all""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_shipdate", "l_partkey", "l_linenumber")
    text = F.concat_ws(", ", F.col("l_partkey").cast("string"), (F.col("l_partkey") + F.col("l_linenumber")).cast("string"), (F.col("l_partkey") % 10).cast("string"))
    lists = l.select("l_suppkey", F.to_date("l_shipdate").alias("day"), text.alias("products"))
    return N.explode_list_count(lists, ["l_suppkey", "day"], "products")


@query("smoothed_density", """
with s as (select l_returnflag, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, stddev_samp(l_quantity) as sd,
 quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from lineitem group by 1),
b as (select *, 0.9 * least(sd, (q3 - q1) / 1.34) * power(n, -0.2) as h from s),
g as (select *, point, lo - 3 * h + point * (hi - lo + 6 * h) / 39 as x from b, (select unnest(range(40)) as point))
select g.l_returnflag, point, round(x, 6) as x, round(h, 6) as bandwidth, round(sum(exp(-power((x - l_quantity) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 8) as density
from g join lineitem l on l.l_returnflag = g.l_returnflag group by g.l_returnflag, point, x, h, n""")
def _(spark, folder):
    out = W.smoothed_density(lines(spark, folder, "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", points=40, bins=None)
    return out.select("l_returnflag", "point", r("x").alias("x"), r("bandwidth").alias("bandwidth"), r("density", 8).alias("density"))
