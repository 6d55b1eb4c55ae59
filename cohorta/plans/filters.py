"""Date spines, projections and filters."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import rows as R
from cohorta.operators import spine as S
from cohorta.operators.activity import activity_around
from cohorta.operators.scans import next_value, ordered_scans
from cohorta.plans.base import EXPOSURES_CTE, events, exposures, lines, orders, query, scan_table

START, END = date(1997, 3, 1), date(1997, 4, 30)
TODAY = date(1998, 6, 11)


def _daily(spark, folder, first, last):
    """Orders per day of a period, which is pushed down to the scan."""
    return S.within_days(orders(spark, folder), "o_orderdate", first, last).groupBy("day").agg(F.count(F.lit(1)).alias("n_orders"))


# -- spines -------------------------------------------------------------------

@query("date_spine", """
select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as date) as calendar_date
from orders""")
def _(spark, folder):
    return S.data_spine(scan_table(spark, folder, "orders", ["o_orderdate"]), "o_orderdate")


@query("date_spine_offset", """
select s.calendar_date, count(o_orderkey) as n_orders
from (select cast(unnest(generate_series(date '1997-02-15', date '1997-04-30', interval 1 day)) as date) as calendar_date) s
left join orders on cast(o_orderdate as date) = s.calendar_date group by 1""")
def _(spark, folder):
    spine = S.date_spine_offset(spark, START, END, 14)
    return S.spine_left_join(spine, _daily(spark, folder, START - timedelta(days=14), END), "day", ["n_orders"])


@query("date_spine_relative", """
select cast(o_orderdate as date) as day, count(*) as n_orders from orders
where cast(o_orderdate as date) between date '1998-05-12' and date '1998-06-10' group by 1""")
def _(spark, folder):
    spine = S.date_spine_relative(spark, TODAY, -30, -1)
    return S.filter_by_spine(_daily(spark, folder, TODAY - timedelta(days=30), TODAY - timedelta(days=1)), "day", spine)


@query("retention_spine", """
select a.d as calendar_date, count(distinct o.o_custkey) as customers,
       count(distinct b.o_custkey) as customers_28d
from (select cast(unnest(generate_series(date '1997-03-01', date '1997-03-31', interval 1 day)) as date) as d) a
left join orders o on cast(o.o_orderdate as date) = a.d
left join orders b on b.o_custkey = o.o_custkey
  and cast(b.o_orderdate as date) between a.d + 1 and a.d + 28 group by 1""")
def _(spark, folder):
    # Customers of each day of the period, and those of them who come back within 28 days.
    # The longer spine lets the days after the period in.
    short, longer = S.retention_spines(spark, date(1997, 3, 1), date(1997, 3, 31), 28)
    o = S.within_days(orders(spark, folder), "o_orderdate", date(1997, 3, 1), date(1997, 4, 28))
    seen = S.filter_by_spine(o, "day", longer).select("o_custkey", "day").distinct()
    ahead = activity_around(seen, ["o_custkey"], "day", F.lit(0.0), F.lit(True), {"next": (1, 28)})
    counts = S.filter_by_spine(ahead, "day", short).groupBy("day").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n_next") > 0).alias("customers_28d")
    )
    return S.spine_left_join(short, counts, "day", ["customers", "customers_28d"])


@query("filter_by_spine_inner", """
select o_orderkey, cast(o_orderdate as date) as day from orders
where cast(o_orderdate as date) between date '1997-03-01' and date '1997-04-30'""")
def _(spark, folder):
    # Without gaps the spine is a plain range, which the scan can use to skip row groups.
    o = S.within_days(scan_table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]), "o_orderdate", START, END)
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("filter_by_spine_in", """
select o_orderkey from orders where cast(o_orderdate as date) in
 (select cast(unnest(generate_series(date '1997-03-01', date '1997-04-30', interval 1 day)) as date))""")
def _(spark, folder):
    o = S.within_days(scan_table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]), "o_orderdate", START, END)
    return S.filter_by_spine(o, "o_orderdate", S.date_spine(spark, START, END)).select("o_orderkey")


@query("spine_left_join", """
select s.d as calendar_date, count(e.event_id) as n_events
from (select cast(unnest(generate_series(date '2023-12-25', date '2024-02-05', interval 1 day)) as date) as d) s
left join (select * from events where event_type = 'purchase') e on cast(e.ts as date) = s.d group by 1""")
def _(spark, folder):
    e = events(spark, folder, "event_id", "ts", "event_type").where("event_type = 'purchase'")
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("event_id").alias("n_events"))
    return S.spine_left_join(S.date_spine(spark, date(2023, 12, 25), date(2024, 2, 5)), daily, "day", ["n_events"])


@query("last_full_week", """
select cast(o_orderdate as date) as day, count(*) as n_orders from orders
where cast(o_orderdate as date) between date_trunc('week', date '1998-06-11') - interval 7 day
  and date_trunc('week', date '1998-06-11') - interval 1 day group by 1""")
def _(spark, folder):
    monday, sunday = S.previous_full_week(TODAY)
    o = S.within_days(scan_table(spark, folder, "orders", ["o_orderdate"]), "o_orderdate", monday, sunday)
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))


# -- projections and predicates -----------------------------------------------

@query("case_map", """
select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'fast'
            when o_orderpriority = '3-MEDIUM' then 'normal'
            when o_totalprice > 250000 then 'slow and large' else 'Other' end as class,
       count(*) as n_orders from orders group by 1""")
def _(spark, folder):
    p = F.col("o_orderpriority")
    rules = [(p.isin("1-URGENT", "2-HIGH"), "fast"), (p == "3-MEDIUM", "normal"), (F.col("o_totalprice") > 250000, "slow and large")]
    return orders(spark, folder).groupBy(C.case_map(rules, "Other").alias("class")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("in_list", """
select c_mktsegment, count(*) as n from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1""")
def _(spark, folder):
    c = scan_table(spark, folder, "customer", ["c_mktsegment"])
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("not_in_list", """
select p_type, count(*) as n from part where p_type not in ('PROMO', 'SMALL') group by 1""")
def _(spark, folder):
    p = scan_table(spark, folder, "part", ["p_type"])
    return p.where(~F.col("p_type").isin("PROMO", "SMALL")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


_FLAG_SQL = "case when l_returnflag = 'R' then true when l_returnflag = 'A' then false end"


def _flagged(spark, folder):
    deleted = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return lines(spark, folder, "l_returnflag", "l_suppkey").withColumn("is_deleted", deleted)


@query("null_safe_not_deleted", f"""
select l_suppkey, count(*) as n from (select *, {_FLAG_SQL} as is_deleted from lineitem)
where not (is_deleted or is_deleted is null) group by 1""")
def _(spark, folder):
    return _flagged(spark, folder).where(C.known_alive("is_deleted")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("null_counts_as_alive", f"""
select l_suppkey, count(*) as n from (select *, {_FLAG_SQL} as is_deleted from lineitem)
where not is_deleted or is_deleted is null group by 1""")
def _(spark, folder):
    return _flagged(spark, folder).where(C.not_known_deleted("is_deleted")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def part_versions(spark, folder):
    """Dated versions per part: every ship day of a returned line starts a new one, which
    lasts until the next."""
    v = (
        lines(spark, folder, "l_partkey", "l_shipdate", "l_discount", "l_returnflag").where("l_returnflag = 'R'")
        .groupBy("l_partkey", F.to_date("l_shipdate").alias("start_date")).agg(F.max("l_discount").alias("discount"))
    )
    return ordered_scans(v, ["l_partkey"], ["start_date"], {"end_date": next_value("start_date")})


VERSIONS_CTE = """
starts as (select l_partkey, cast(l_shipdate as date) as start_date, max(l_discount) as discount
           from lineitem where l_returnflag = 'R' group by 1, 2),
versions as (select *, lead(start_date) over (partition by l_partkey order by start_date) as end_date from starts)"""


@query("current_rows", f"with {VERSIONS_CTE} select l_partkey, start_date, discount from versions where end_date is null")
def _(spark, folder):
    return R.current_rows(part_versions(spark, folder), "end_date").select("l_partkey", "start_date", "discount")


@query("latest_snapshot", """
select o_orderkey, o_custkey from orders where o_orderdate = (select max(o_orderdate) from orders)""")
def _(spark, folder):
    return R.latest_snapshot(scan_table(spark, folder, "orders"), "o_orderdate").select("o_orderkey", "o_custkey")


@query("customer_allowlist", """
select o_orderkey, o_custkey from orders
where o_custkey in (select c_custkey from customer where c_mktsegment <> 'MACHINERY' and c_acctbal >= 0)""")
def _(spark, folder):
    customers = scan_table(spark, folder, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]).withColumnRenamed("c_custkey", "o_custkey")
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    return R.customer_allowlist(o, customers, "o_custkey", [F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") >= 0]).select("o_orderkey", "o_custkey")


@query("between_closed", """
select count(*) as n from lineitem where l_quantity between l_linenumber and 7 * l_linenumber""")
def _(spark, folder):
    ok = C.within_closed("l_quantity", "l_linenumber", F.col("l_linenumber") * 7)
    return lines(spark, folder, "l_quantity", "l_linenumber").where(ok).agg(F.count(F.lit(1)).alias("n"))


@query("half_open", """
select count(*) as n from lineitem where l_quantity >= l_linenumber and l_quantity < 7 * l_linenumber""")
def _(spark, folder):
    ok = C.within_half_open("l_quantity", "l_linenumber", F.col("l_linenumber") * 7)
    return lines(spark, folder, "l_quantity", "l_linenumber").where(ok).agg(F.count(F.lit(1)).alias("n"))


@query("after_exposure_or_no_event", f"""
with {EXPOSURES_CTE},
firsts as (select customer_id, min(ts) as exposed_at from exposures group by 1),
buys as (select user_id as customer_id, ts as bought_at, value from events where event_type = 'purchase')
select f.customer_id, count(b.bought_at) as n_after
from firsts f left join buys b on b.customer_id = f.customer_id
where (b.value <> 0 and b.bought_at > f.exposed_at) or b.bought_at is null group by 1""")
def _(spark, folder):
    # "a and b or c" keeps rows without an event date, whatever a and b say.
    firsts = exposures(spark, folder).groupBy("customer_id").agg(F.min("ts").alias("exposed_at"))
    buys = events(spark, folder, "user_id", "ts", "value", "event_type").where("event_type = 'purchase'")
    buys = buys.select(F.col("user_id").alias("customer_id"), F.col("ts").alias("bought_at"), "value")
    # Counted per customer before the outer join, which then has one row on either side.
    after = (F.col("value") != 0) & (F.col("bought_at") > F.col("exposed_at"))
    counts = buys.join(firsts, "customer_id").groupBy("customer_id").agg(
        F.count_if(after).alias("n_after"), F.count_if(F.col("bought_at").isNull()).alias("n_undated")
    )
    joined = firsts.join(counts, "customer_id", "left")
    keep = (F.col("n_after") > 0) | F.col("n_after").isNull() | (F.col("n_undated") > 0)
    return joined.where(keep).select("customer_id", F.coalesce("n_after", F.lit(0)).alias("n_after"))


@query("select_distinct", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def _(spark, folder):
    return lines(spark, folder, "l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("drop_all_duplicates", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
qualify count(*) over (partition by l_orderkey, l_linenumber) = 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.drop_all_duplicates(l, ["l_orderkey", "l_linenumber"])


@query("tidy_columns", """
select o_orderkey as order_id, o_custkey as customer_id, o_totalprice as gmv from orders""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders")
    return R.tidy(o, {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "gmv"}, ["o_orderstatus", "o_orderdate", "o_orderpriority"])


_BUYS_SQL = """select c_custkey, max(o_totalprice) as biggest, max(case when o_orderstatus = 'F' then o_totalprice end) as biggest_f,
  min(case when o_orderpriority = '1-URGENT' then o_orderpriority end) as urgent
  from customer left join orders on o_custkey = c_custkey group by 1"""


def _buys(spark, folder):
    c = scan_table(spark, folder, "customer", ["c_custkey"])
    o = scan_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("biggest"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("biggest_f"),
        F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority"))).alias("urgent"),
    )
    return c.join(o, "c_custkey", "left")


@query("dropna_fillna", f"""
select c_custkey, biggest, coalesce(biggest_f, 0) as biggest_f, coalesce(urgent, 'none') as urgent
from ({_BUYS_SQL}) where biggest is not null""")
def _(spark, folder):
    return R.tidy(_buys(spark, folder), required=["biggest"], fill={"biggest_f": 0.0, "urgent": "none"})


@query("null_counts", f"""
select count(*) - count(biggest) as null_biggest, count(*) - count(biggest_f) as null_biggest_f,
       count(*) - count(urgent) as null_urgent from ({_BUYS_SQL})""")
def _(spark, folder):
    return R.null_counts(_buys(spark, folder), ["biggest", "biggest_f", "urgent"])
