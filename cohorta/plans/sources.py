"""Sources, sinks and parameters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohorta.operators.joins import in_ids
from cohorta.operators.splits import assign_by_hash
from cohorta.plans.base import lines, orders, query, r, scan_table
from cohorta.session import scratch_dir
from cohorta.sources import tables as T


@query("scan_table", """
select o_orderkey, o_custkey, o_totalprice from orders""")
def _(spark, folder):
    return scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("render_params", """
select o_orderstatus, count(*) as n_orders, round(sum(o_totalprice), 2) as total
from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'
  and o_totalprice > 1000.0 group by o_orderstatus""")
def _(spark, folder):
    return T.run_sql(
        spark,
        """select o_orderstatus, count(*) as n_orders, round(sum(o_totalprice), 2) as total
           from {orders} where o_orderdate >= :from_day and o_orderdate < :to_day and o_totalprice > :min_price
           group by o_orderstatus""",
        {"from_day": date(1997, 1, 1), "to_day": date(1998, 1, 1), "min_price": 1000.0},
        {"orders": scan_table(spark, folder, "orders")},
    )


@query("in_list_param", """
select l_suppkey, count(*) as n_lines from lineitem
where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000) group by l_suppkey""")
def _(spark, folder):
    stores = scan_table(spark, folder, "supplier").where("s_acctbal > 5000")
    return in_ids(lines(spark, folder, "l_suppkey"), "l_suppkey", stores, "s_suppkey").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines")
    )


@query("read_csv", """
select c_mktsegment, count(*) as n_customers, round(sum(c_acctbal), 2) as balance
from customer group by c_mktsegment""")
def _(spark, folder):
    path = scratch_dir(spark)
    T.write_csv(scan_table(spark, folder, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]), path)
    back = T.read_csv(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double")
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("result_cache", """
select cast(o_orderdate as date) as day, count(*) as n_orders from orders group by 1""")
def _(spark, folder):
    build = lambda: orders(spark, folder).groupBy("day").agg(F.count(F.lit(1)).alias("n_orders"))
    path = scratch_dir(spark)
    T.cached_result(spark, path, build)
    return T.cached_result(spark, path, build)


@query("read_dated_files", """
select make_date(cast(year(o_orderdate) as bigint), 1, 1) as file_day, count(*) as n_orders,
       round(sum(o_totalprice), 2) as total
from orders group by 1""")
def _(spark, folder):
    path = scratch_dir(spark)
    dated = orders(spark, folder).select("o_orderkey", "o_totalprice", F.date_format("day", "yyyy-01-01").alias("d"))
    dated.write.partitionBy("d").csv(path, header=True)
    files = T.read_dated_files(spark, f"{path}/*/*.csv", "o_orderkey long, o_totalprice double")
    return files.groupBy("file_day").agg(F.count(F.lit(1)).alias("n_orders"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("write_assignment", """
select case when cast('0x' || substr(md5('stores' || s_suppkey), 1, 8) as bigint) % 1000 < 800
            then 'Treat' else 'Control' end as variant, count(*) as n_stores
from supplier group by 1""")
def _(spark, folder):
    stores = scan_table(spark, folder, "supplier", ["s_suppkey"])
    path = scratch_dir(spark)
    T.write_assignment(assign_by_hash(stores, "s_suppkey", "stores", [(800, "Treat"), (1000, "Control")]), path)
    return spark.read.parquet(path).groupBy("variant").agg(F.count(F.lit(1)).alias("n_stores"))
