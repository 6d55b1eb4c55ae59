"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import aggregates as A
from cohorta.operators import ranks as R
from cohorta.operators import reshape as W
from cohorta.plans.base import SESSIONS_CTE, lines, orders, query, r, scan_table, sessions
from cohorta.sources.tables import run_sql


def _lines_orders(spark, folder):
    l = lines(spark, folder, "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    return l.join(o, l.l_orderkey == o.o_orderkey)


@query("count_distinct", """
select l_returnflag, count(distinct l_orderkey) as n_orders from lineitem group by 1""")
def _(spark, folder):
    return lines(spark, folder, "l_returnflag", "l_orderkey").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n_orders"))


@query("conditional_count_distinct", """
select o_orderpriority, count(distinct l_orderkey) as all_orders,
 count(distinct case when l_returnflag = 'R' then l_orderkey end) as r_orders,
 count(distinct case when l_returnflag = 'R' and l_linestatus = 'F' then l_orderkey end) as rf_orders,
 count(distinct case when o_orderstatus = 'F' then l_orderkey end) as delivered,
 count(distinct case when l_quantity > 45 then l_orderkey end) as large,
 round(sum(l_extendedprice), 2) as gmv, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end), 2) as r_gmv
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def _(spark, folder):
    back, closed = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    out = A.conditional_distinct(
        _lines_orders(spark, folder), ["o_orderpriority"], "l_orderkey",
        {"all_orders": F.lit(True), "r_orders": back, "rf_orders": back & closed, "delivered": F.col("o_orderstatus") == "F", "large": F.col("l_quantity") > 45},
        {"gmv": F.col("l_extendedprice"), "r_gmv": F.when(back, F.col("l_extendedprice")).otherwise(0.0)},
    )
    return out.withColumn("gmv", r("gmv", 2)).withColumn("r_gmv", r("r_gmv", 2))


@query("composite_count_distinct", """
select l_returnflag, count(distinct (l_orderkey, l_suppkey)) as n_pairs,
 count(distinct case when l_linestatus = 'F' then (l_orderkey, l_suppkey) end) as n_closed_pairs
from lineitem group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_returnflag", "l_orderkey", "l_suppkey", "l_linestatus")
    conditions = {"n_pairs": F.lit(True), "n_closed_pairs": F.col("l_linestatus") == "F"}
    return A.conditional_distinct(l, ["l_returnflag"], ["l_orderkey", "l_suppkey"], conditions)


@query("composite_count_distinct_separator", """
select l_returnflag, count(distinct l_orderkey || '_' || l_suppkey) as n_pairs from lineitem group by 1""")
def _(spark, folder):
    # Counting the pair itself is the separator form without building strings.
    l = lines(spark, folder, "l_returnflag", "l_orderkey", "l_suppkey")
    return A.conditional_distinct(l, ["l_returnflag"], ["l_orderkey", "l_suppkey"], {"n_pairs": F.lit(True)})


@query("filter_clause", """
select o_orderstatus, count(distinct o_custkey) filter (where o_totalprice > 300000) as big_spenders,
 count(distinct o_custkey) filter (where o_orderpriority = '1-URGENT') as urgent_customers from orders group by 1""")
def _(spark, folder):
    return run_sql(
        spark,
        """select o_orderstatus, count_if(big) as big_spenders, count_if(urgent) as urgent_customers from (
             select o_orderstatus, o_custkey, coalesce(bool_or(true) filter (where o_totalprice > 300000), false) as big,
                    coalesce(bool_or(true) filter (where o_orderpriority = '1-URGENT'), false) as urgent
             from {orders} group by o_orderstatus, o_custkey)
           group by o_orderstatus""",
        tables={"orders": scan_table(spark, folder, "orders")},
    )


@query("count_if", """
select l_suppkey, count_if(l_returnflag = 'R')::bigint as n_returned, count_if(l_discount >= 0.05)::bigint as n_discounted
from lineitem group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_returnflag", "l_discount")
    return l.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_if(F.col("l_discount") >= 0.05).alias("n_discounted")
    )


@query("count_non_null", """
select c_mktsegment, count(*) as n_rows, count(n_orders) as n_with_orders
from customer left join (select o_custkey, count(*) as n_orders from orders where o_totalprice > 400000 group by 1) on o_custkey = c_custkey
group by 1""")
def _(spark, folder):
    big = scan_table(spark, folder, "orders", ["o_custkey", "o_totalprice"]).where("o_totalprice > 400000")
    counts = big.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = scan_table(spark, folder, "customer", ["c_custkey", "c_mktsegment"]).join(counts, "c_custkey", "left")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"), F.count("n_orders").alias("n_with_orders"))


@query("conditional_sums", """
select o_custkey, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 6) as average, min(o_totalprice) as lowest,
 max(o_totalprice) as highest, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end), 2) as delivered,
 round(avg(case when o_orderstatus = 'F' then o_totalprice end), 6) as average_delivered,
 max(case when o_orderstatus = 'F' then o_orderdate end) as last_delivered
from orders group by 1""")
def _(spark, folder):
    p, done = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    return scan_table(spark, folder, "orders").groupBy("o_custkey").agg(
        r(F.sum(p), 2).alias("total"), r(F.avg(p)).alias("average"), F.min(p).alias("lowest"), F.max(p).alias("highest"),
        r(F.sum(F.when(done, p).otherwise(0.0)), 2).alias("delivered"), r(F.avg(F.when(done, p))).alias("average_delivered"),
        F.max(F.when(done, F.col("o_orderdate"))).alias("last_delivered"),
    )


@query("sum_distinct", "select l_suppkey, sum(distinct l_quantity) as sum_distinct_quantity from lineitem group by 1")
def _(spark, folder):
    return lines(spark, folder, "l_suppkey", "l_quantity").groupBy("l_suppkey").agg(F.sum_distinct("l_quantity").alias("sum_distinct_quantity"))


@query("fanout_safe_sum", """
select l_suppkey, round(sum(o_totalprice), 2) as total
from (select distinct l_suppkey, o_orderkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey) group by 1""")
def _(spark, folder):
    out = A.fanout_safe_sum(_lines_orders(spark, folder), ["l_suppkey"], ["o_orderkey"], "o_totalprice")
    return out.withColumn("total", r("total", 2))


@query("fanout_safe_avg", """
select l_suppkey, round(sum(o_totalprice) / nullif(count(*), 0), 6) as average
from (select distinct l_suppkey, o_orderkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey) group by 1""")
def _(spark, folder):
    out = A.fanout_safe_avg(_lines_orders(spark, folder), ["l_suppkey"], ["o_orderkey"], "o_totalprice")
    return out.withColumn("average", r("average"))


@query("abs_sum", """
select l_orderkey, round(abs(sum(coalesce(case when l_returnflag = 'R' then -l_extendedprice end, 0))), 2) as refunds
from lineitem group by 1""")
def _(spark, folder):
    refund = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice"))
    return lines(spark, folder, "l_orderkey", "l_returnflag", "l_extendedprice").groupBy("l_orderkey").agg(
        r(F.abs(F.sum(F.coalesce(refund, F.lit(0.0)))), 2).alias("refunds")
    )


@query("first_of_sorted_array", """
select l_suppkey, list_sort(list(l_shipdate))[1] as first_ship, list_sort(list(l_quantity > 49))[1] as all_large
from lineitem group by 1""")
def _(spark, folder):
    # The first of the sorted values is their minimum; no array needs to be built.
    return lines(spark, folder, "l_suppkey", "l_shipdate", "l_quantity").groupBy("l_suppkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.min(F.col("l_quantity") > 49).alias("all_large")
    )


@query("safe_ratio", """
select o_custkey, round(count_if(o_orderstatus = 'F') / nullif(count_if(o_orderpriority = '1-URGENT'), 0), 6) as ratio
from orders group by 1""")
def _(spark, folder):
    done, urgent = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return scan_table(spark, folder, "orders").groupBy("o_custkey").agg(r(C.safe_ratio(done, urgent)).alias("ratio"))


@query("ratio_of_sums", """
select l_returnflag, round(sum(l_discount) / sum(l_tax), 6) as discount_per_tax, round(sum(l_quantity) / sum(l_linenumber), 6) as quantity_per_line
from lineitem group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_returnflag", "l_discount", "l_tax", "l_quantity", "l_linenumber")
    out = A.ratio_of_sums(l, ["l_returnflag"], {"discount_per_tax": ("l_discount", "l_tax"), "quantity_per_line": ("l_quantity", "l_linenumber")})
    return out.select("l_returnflag", r("discount_per_tax").alias("discount_per_tax"), r("quantity_per_line").alias("quantity_per_line"))


@query("two_level_aggregate", """
select o_orderstatus, count(*) as n_days, round(avg(n), 6) as orders_per_day, max(n) as busiest
from (select o_orderstatus, cast(o_orderdate as date) as day, count(*) as n from orders group by all) group by 1""")
def _(spark, folder):
    daily = orders(spark, folder).groupBy("o_orderstatus", "day").agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_days"), r(F.avg("n")).alias("orders_per_day"), F.max("n").alias("busiest")
    )


@query("fanout_audit", """
select l_returnflag, count(*) as n_rows, count(distinct (l_orderkey, l_linenumber)) as n_keys from lineitem group by 1""")
def _(spark, folder):
    return A.grain_audit(lines(spark, folder, "l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("group_by_ordinals", """
select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2""")
def _(spark, folder):
    return run_sql(
        spark, "select l_returnflag, l_linestatus, count(*) as n from {l} group by 1, 2",
        tables={"l": lines(spark, folder, "l_returnflag", "l_linestatus")},
    )


@query("named_aggregations", """
select o_orderpriority, count(*) as size, count(distinct o_custkey) as customers, round(sum(o_totalprice), 2) as gmv_sum,
 round(avg(o_totalprice), 4) as gmv_mean, round(stddev_samp(o_totalprice), 4) as gmv_std, min(o_orderdate) as first_order
from orders group by 1""")
def _(spark, folder):
    per_customer = scan_table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("size"), F.countDistinct("o_custkey").alias("customers"), r(F.sum("o_totalprice"), 2).alias("gmv_sum"),
        r(F.avg("o_totalprice"), 4).alias("gmv_mean"), r(F.stddev_samp("o_totalprice"), 4).alias("gmv_std"), F.min("o_orderdate").alias("first_order"),
    )
    return per_customer


@query("value_counts", """
select l_linenumber, count(*) as n, round(count(*) / (select count(*) from lineitem), 6) as share from lineitem group by 1""")
def _(spark, folder):
    out = A.value_shares(lines(spark, folder, "l_linenumber"), "l_linenumber")
    return out.withColumn("share", r("share"))


@query("crosstab", """
select o_orderpriority, count_if(o_orderstatus = 'F')::bigint as "F", count_if(o_orderstatus = 'O')::bigint as "O",
 count_if(o_orderstatus = 'P')::bigint as "P" from orders group by 1""")
def _(spark, folder):
    return W.crosstab(scan_table(spark, folder, "orders", ["o_orderpriority", "o_orderstatus"]), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("percentiles_by_group", """
select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as p50,
 round(quantile_cont(o_totalprice, 0.75), 4) as p75, round(quantile_cont(o_totalprice, 1.0), 4) as p100 from orders group by 1""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_orderpriority", "o_totalprice"])
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    out = R.percentiles(o, ["o_orderpriority"], "o_totalprice", points)
    return out.select("o_orderpriority", *[r(p, 4).alias(p) for p in points])


EXTREME = {"p0001": 0.0001, "p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p9999": 0.9999}


@query("describe_extremes", "select count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as lowest, max(o_totalprice) as highest, "
       + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) as {n}" for n, p in EXTREME.items()) + " from orders")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_totalprice"])
    p = R.percentiles(o, [], "o_totalprice", EXTREME)
    rounded = F.struct(*[r(n, 4).alias(n) for n in EXTREME])
    plain = o.agg(
        F.count("o_totalprice").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean"), r(F.stddev_samp("o_totalprice"), 4).alias("std"),
        F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"),
    )
    return plain.withColumn("_p", p.select(rounded).scalar()).select("n", "mean", "std", "lowest", "highest", "_p.*")


@query("share_of_sessions_with_purchase", f"""
with {SESSIONS_CTE}
select day, count(distinct session_id) as n_sessions,
 count(distinct case when event_type = 'purchase' then session_id end) as n_buying,
 round(count(distinct case when event_type = 'purchase' then session_id end) / count(distinct session_id), 6) as share
from sessions group by 1""")
def _(spark, folder):
    out = A.conditional_distinct(sessions(spark, folder), ["day"], "session_id", {"n_sessions": F.lit(True), "n_buying": F.col("event_type") == "purchase"})
    return out.withColumn("share", r(C.safe_ratio("n_buying", "n_sessions")))
