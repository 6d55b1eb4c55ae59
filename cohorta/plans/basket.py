"""Orders, products, stores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import activity as V
from cohorta.operators import aggregates as A
from cohorta.operators import basket as B
from cohorta.operators import inference as I
from cohorta.operators import joins as J
from cohorta.operators.splits import assign_by_hash
from cohorta.plans.base import lines, orders, query, r, scan_table
from cohorta.plans.filters import VERSIONS_CTE, part_versions
from cohorta.plans.joins import LINES_CTE, order_lines

# -- availability -------------------------------------------------------------

# Ordered quantities are cut to tens so that a replacement may have none; products are
# told apart by a small number so that some are replaced by the same product.
_MISSING = """
(complaint or (qty > 0 and replaced_by is not null and o_orderstatus = 'F' and
 (new_product <> product or (new_qty < qty and new_qty > 0) or (new_qty = 0 and new_product = product))))"""

_AVAIL_CTE = LINES_CTE + f""",
o as (select l.*, o_orderstatus, o_orderpriority, o_custkey, l.l_partkey % 3 as product,
  case when o_orderpriority = '5-LOW' then 0 else floor(l.l_quantity / 10) end as qty,
  l.l_linenumber = 7 and l.l_linestatus = 'O' as complaint, floor(n.l_quantity / 10) as new_qty, n.l_partkey % 3 as new_product
  from order_lines l join orders on l.l_orderkey = o_orderkey left join order_lines n on l.replaced_by = n.line_id),
flags as (select *, coalesce({_MISSING}, false) as missing, o_orderstatus = 'P' and o_orderpriority = '1-URGENT' as order_missing from o)"""


def availability_lines(spark, folder):
    raw = order_lines(spark, folder).withColumn("product", F.col("l_partkey") % 3).withColumn("amount", F.floor(F.col("l_quantity") / 10))
    l = J.replacement_join(raw, "line_id", "replaced_by", ["product", "amount"])
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    l = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = B.effective_quantity(F.col("amount"), F.col("o_orderpriority") == "5-LOW")
    delivered, replaced = F.col("o_orderstatus") == "F", F.col("replaced_by").isNotNull()
    complaint = (F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O")
    missing = B.not_available(complaint, quantity, delivered, replaced, F.col("product"), F.col("new_product"), F.col("new_amount"))
    return l.select(
        "line_id", "l_orderkey", "l_suppkey", missing.alias("missing"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("order_missing"),
        delivered.alias("delivered"), replaced.alias("was_replaced"), (F.col("l_linestatus") == "F").alias("is_original"),
        quantity.alias("quantity"), (quantity * (F.col("l_extendedprice") / F.col("l_quantity") * 0.9)).alias("line_value"),
    )


@query("not_available_flag", f"with {_AVAIL_CTE} select line_id, missing from flags")
def _(spark, folder):
    return availability_lines(spark, folder).select("line_id", "missing")


@query("not_available_orders", f"""
with {_AVAIL_CTE} select l_suppkey, count(distinct l_orderkey) as n_orders,
 count(distinct case when missing or order_missing then l_orderkey end) as orders_not_available from flags group by 1""")
def _(spark, folder):
    m = B.availability_metrics(availability_lines(spark, folder), ["l_suppkey"], "line_id", "l_orderkey")
    return m.select("l_suppkey", "n_orders", "orders_not_available")


@query("placed_products", f"""
with {_AVAIL_CTE} select l_suppkey, count(distinct case when missing then line_id end) as products_not_available,
 count(distinct case when replaced_by is null then line_id end) as products_placed, count(distinct l_orderkey) as n_orders,
 count(distinct case when o_orderstatus = 'F' then l_orderkey end) as n_delivered,
 coalesce(sum(case when l_linestatus = 'F' then qty end), 0) as quantity_placed,
 round(coalesce(sum(case when l_linestatus = 'F' then qty * (l_extendedprice / l_quantity * 0.9) end), 0), 2) as value_placed from flags group by 1""")
def _(spark, folder):
    m = B.availability_metrics(availability_lines(spark, folder), ["l_suppkey"], "line_id", "l_orderkey")
    return m.drop("orders_not_available").withColumn("value_placed", r("value_placed", 2))


@query("gmv_loss", """
with v as (select l_orderkey as order_id, o_orderpriority, week(o_orderdate) as week_no,
  sum(case when l_returnflag = 'R' then -l_extendedprice * l_discount end) as refunded, sum(case when l_returnflag = 'A' then -l_tax * l_extendedprice end) as removed,
  sum(l_extendedprice) as original from lineitem join orders on l_orderkey = o_orderkey group by all),
bad as (select distinct l_orderkey from lineitem where l_extendedprice / l_quantity > 2090),
s as (select o_orderpriority, week_no, abs(sum(coalesce(refunded, 0))) as refunds, sum(coalesce(removed, 0)) as removals, sum(coalesce(original, 0)) as base
  from v where order_id not in (select l_orderkey from bad) group by all)
select o_orderpriority, week_no, round(removals - refunds, 2) as numerator, round(base, 2) as denominator, round((removals - refunds) / base, 6) as loss from s""")
def _(spark, folder):
    l = lines(spark, folder, "l_orderkey", "l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    v = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(flag == "R", -price * F.col("l_discount"))).alias("refunded"), F.sum(F.when(flag == "A", -F.col("l_tax") * price)).alias("removed"),
        F.sum(price).alias("original"),
    )
    v = v.join(orders(spark, folder).select("o_orderkey", "o_orderpriority", F.weekofyear("day").alias("week_no")), "o_orderkey")
    bad = l.where(price / F.col("l_quantity") > 2090).select(F.col("l_orderkey").alias("o_orderkey"))
    out = B.gmv_loss(v, bad, "o_orderkey", ["o_orderpriority", "week_no"], ["removed"], ["refunded"], "original")
    return out.select("o_orderpriority", "week_no", r("gmv_loss_numerator", 2).alias("numerator"), r("gmv_loss_denominator", 2).alias("denominator"), r("gmv_loss_share").alias("loss"))


@query("contribution_margin_by_group", """
select cast(date_trunc('month', o_orderdate) as date) as month, n_regionkey, count(distinct o_orderkey) as n_orders,
 round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.8), 4) as margin,
 count_if(l_extendedprice * (1 - l_discount) < p_retailprice * l_quantity * 0.8)::bigint as n_negative
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey group by all""")
def _(spark, folder):
    l = lines(spark, folder, "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_quantity")
    p = scan_table(spark, folder, "part", ["p_partkey", "p_retailprice"])
    margin = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("p_retailprice") * F.col("l_quantity") * 0.8
    loss = F.col("l_extendedprice") * (1 - F.col("l_discount")) < F.col("p_retailprice") * F.col("l_quantity") * 0.8
    per_order = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sum(margin).alias("m"), F.count_if(loss).alias("neg"))
    o = orders(spark, folder).select("o_orderkey", "o_custkey", F.to_date(F.date_trunc("month", "day")).alias("month"))
    c = scan_table(spark, folder, "customer", ["c_custkey", "c_nationkey"]).join(scan_table(spark, folder, "nation", ["n_nationkey", "n_regionkey"]), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("month", "n_regionkey").agg(F.count(F.lit(1)).alias("n_orders"), r(F.sum("m"), 4).alias("margin"), F.sum("neg").alias("n_negative"))


# -- categories ---------------------------------------------------------------

def typed_lines(spark, folder):
    l = lines(spark, folder, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return l.join(scan_table(spark, folder, "part", ["p_partkey", "p_type", "p_brand"]), F.col("l_partkey") == F.col("p_partkey"))


def _store_country(spark, folder):
    s = scan_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal", "s_name"])
    return s.join(scan_table(spark, folder, "nation", ["n_nationkey", "n_name", "n_regionkey"]), F.col("s_nationkey") == F.col("n_nationkey"))


def located_lines(spark, folder):
    return typed_lines(spark, folder).join(_store_country(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))


def located_volumes(spark, folder):
    """Quantity per store and product, with both dimensions."""
    sums = lines(spark, folder, "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("l_quantity"))
    typed = sums.join(scan_table(spark, folder, "part", ["p_partkey", "p_type"]), F.col("l_partkey") == F.col("p_partkey"))
    return typed.join(_store_country(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))


_FRESH_SQL = "p_type in ('PROMO', 'SMALL')"
_LOCATED = "lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"
_SEGMENT_SQL = "case when s_acctbal > 8000 then 'top' when s_acctbal > 3000 and n_regionkey = 1 then 'regional' when s_acctbal < 0 then 'debt' else 'tail' end"


def is_fresh():
    return F.col("p_type").isin("PROMO", "SMALL")


def segment_rules():
    b = F.col("s_acctbal")
    return [(b > 8000, "top"), ((b > 3000) & (F.col("n_regionkey") == 1), "regional"), (b < 0, "debt")]


@query("units_and_value_per_order", f"""
with o as (select n_regionkey, l_orderkey, bool_or({_FRESH_SQL}) as f, sum(l_quantity) as u, sum(l_extendedprice) as v from {_LOCATED} group by all)
select n_regionkey, {", ".join(f"count(case when {c} then 1 end) as n_orders_{n}, round(sum(case when {c} then u end) / nullif(count(case when {c} then 1 end), 0), 6) as units_per_order_{n}, round(sum(case when {c} then v end) / nullif(count(case when {c} then 1 end), 0), 4) as value_per_order_{n}"
 for n, c in (("all", "true"), ("special", "f"), ("other", "not f")))} from o group by 1""")
def _(spark, folder):
    out = B.units_and_value_per_order(located_lines(spark, folder), ["n_regionkey"], "l_orderkey", "l_quantity", "l_extendedprice", is_fresh())
    for n in ("all", "special", "other"):
        out = out.withColumn(f"units_per_order_{n}", r(f"units_per_order_{n}")).withColumn(f"value_per_order_{n}", r(f"value_per_order_{n}", 4))
    return out


@query("contains_category_orders", f"""
select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem join part on l_partkey = p_partkey where {_FRESH_SQL})""")
def _(spark, folder):
    l = typed_lines(spark, folder).withColumnRenamed("l_orderkey", "o_orderkey")
    return B.orders_with_category(scan_table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), l, "o_orderkey", is_fresh())


@query("contains_no_category_orders", f"""
select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem join part on l_partkey = p_partkey where {_FRESH_SQL})""")
def _(spark, folder):
    l = typed_lines(spark, folder).withColumnRenamed("l_orderkey", "o_orderkey")
    return B.orders_without_category(scan_table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), l, "o_orderkey", is_fresh())


@query("segment_stores", f"select s_suppkey, n_name, {_SEGMENT_SQL} as segment from supplier join nation on s_nationkey = n_nationkey")
def _(spark, folder):
    return B.segment_stores(_store_country(spark, folder), segment_rules(), "tail").select("s_suppkey", "n_name", "segment")


@query("migration_share", f"""
select n_name, count(distinct s_suppkey) as n_stores, count(distinct case when m.k is not null then s_suppkey end) as n_migrated,
 round(count(distinct case when m.k is not null then s_suppkey end) / nullif(count(distinct s_suppkey), 0), 6) as migrated_share
from supplier join nation on s_nationkey = n_nationkey left join (select distinct l_suppkey as k from lineitem join part on l_partkey = p_partkey where p_brand = 'Brand#7' and l_quantity > 40) m on m.k = s_suppkey group by 1""")
def _(spark, folder):
    stores = _store_country(spark, folder).select("s_suppkey", "n_name")
    inventory = typed_lines(spark, folder).where("p_brand = 'Brand#7' and l_quantity > 40").select(F.col("l_suppkey").alias("s_suppkey"))
    return B.migration_share(stores, inventory, "s_suppkey", ["n_name"]).withColumn("migrated_share", r("migrated_share"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("category_mix", f"""
with s as (select n_name, p_type, sum(l_quantity) as w from {_LOCATED} group by all)
select n_name, sum(w) as volume, {", ".join(f"coalesce(round(sum(case when p_type = '{t}' then w end) / sum(w), 6), 0) as {t}" for t in TYPES)} from s group by 1 order by volume desc""")
def _(spark, folder):
    # Lines shrink to one row per store and product before they meet the dimensions.
    out = B.category_mix(located_volumes(spark, folder), "n_name", "p_type", TYPES, F.col("l_quantity"))
    return out.select("n_name", "volume", *[r(t).alias(t) for t in TYPES]).orderBy(F.col("volume").desc(), "n_name")


@query("category_penetration", f"""
select n_name, {_SEGMENT_SQL} as segment, count(distinct l_orderkey) as n_orders, count(distinct case when {_FRESH_SQL} then l_orderkey end) as n_category_orders,
 round(count(distinct case when {_FRESH_SQL} then l_orderkey end) / count(distinct l_orderkey), 6) as penetration from {_LOCATED} group by all""")
def _(spark, folder):
    l = B.segment_stores(located_lines(spark, folder), segment_rules(), "tail")
    out = B.category_penetration(l, ["n_name", "segment"], "l_orderkey", is_fresh())
    return out.withColumn("penetration", r("penetration"))


@query("products_by_category_segment", f"""
select n_name, {_SEGMENT_SQL} as segment, p_type, count(distinct (l_orderkey, l_linenumber)) as n_lines from {_LOCATED} group by all""")
def _(spark, folder):
    l = B.segment_stores(located_lines(spark, folder), segment_rules(), "tail")
    return A.conditional_distinct(l, ["n_name", "segment", "p_type"], ["l_orderkey", "l_linenumber"], {"n_lines": F.lit(True)})


@query("partner_share_of_city", """
with x as (select cast(date_trunc('month', l_shipdate) as date) as month, s_nationkey, l_suppkey, l_orderkey from lineitem join supplier on l_suppkey = s_suppkey),
c as (select month, s_nationkey, count(distinct l_orderkey) as n_parent from x group by all)
select month, s_nationkey, l_suppkey, count(distinct l_orderkey) as n_part, n_parent, round(count(distinct l_orderkey) / n_parent, 6) as share
from x join c using (month, s_nationkey) group by month, s_nationkey, l_suppkey, n_parent""")
def _(spark, folder):
    s = scan_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    l = lines(spark, folder, "l_suppkey", "l_orderkey", "l_shipdate").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    l = l.withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))
    out = B.share_of_parent(l, ["month", "s_nationkey"], ["l_suppkey"], "l_orderkey")
    return out.withColumn("share", r("share"))


@query("event_time_alignment", """
with f as (select l_suppkey, min(cast(l_shipdate as date)) as first_day from lineitem where l_discount >= 0.1 and l_shipdate >= timestamp '1997-01-01' group by 1),
d as (select l_suppkey, cast(l_shipdate as date) as day, count(*) as n from lineitem group by all),
a as (select *, day - first_day as day_offset from d join f using (l_suppkey) where day - first_day between -60 and 60)
select l_suppkey, day, first_day, n, day_offset, case when day_offset > 0 then 'after' when day_offset < 0 then 'before' else 'start' end as period,
 count(case when day_offset < 0 then 1 end) over (partition by l_suppkey) as n_pre, count(case when day_offset > 0 then 1 end) over (partition by l_suppkey) as n_post from a""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_shipdate", "l_discount").withColumn("day", F.to_date("l_shipdate"))
    starts = l.where((F.col("l_discount") >= 0.1) & (F.col("l_shipdate") >= F.lit(date(1997, 1, 1)))).groupBy("l_suppkey").agg(F.min("day").alias("first_day"))
    daily = l.groupBy("l_suppkey", "day").agg(F.count(F.lit(1)).alias("n"))
    return B.event_time_alignment(daily, starts, "l_suppkey", "day", "first_day", 60)


@query("first_enabled_date", f"with {VERSIONS_CTE} select l_partkey, min(start_date) as first_enabled_day from versions where discount >= 0.08 group by 1")
def _(spark, folder):
    return B.first_enabled_day(part_versions(spark, folder), "l_partkey", F.col("discount") >= 0.08, "start_date")


@query("buyers_of_partner", """
select o_custkey, count(distinct o_orderkey) as n_orders, count(case when l_returnflag <> 'R' then 1 end) as n_original
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where s_nationkey = 3 group by 1""")
def _(spark, folder):
    s = scan_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"]).where("s_nationkey = 3")
    l = J.in_ids(lines(spark, folder, "l_orderkey", "l_suppkey", "l_returnflag"), "l_suppkey", s, "s_suppkey")
    per_order = l.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("n"))
    o = scan_table(spark, folder, "orders", ["o_orderkey", "o_custkey"]).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("n").alias("n_original"))


@query("activity_density", """
select l_suppkey, count(distinct cast(l_shipdate as date)) as active_days, round(count(distinct cast(l_shipdate as date)) / 365, 6) as density
from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_shipdate").where((F.col("l_shipdate") >= F.lit(date(1997, 1, 1))) & (F.col("l_shipdate") < F.lit(date(1998, 1, 1))))
    out = V.activity_density(l.select("l_suppkey", F.to_date("l_shipdate").alias("day")), "l_suppkey", "day", 365)
    return out.withColumn("density", r("density"))


@query("weighted_mean", """
select isodow(l_shipdate) as weekday_no, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as weighted_mean, round(avg(l_discount), 8) as plain_mean from lineitem group by 1""")
def _(spark, folder):
    l = lines(spark, folder, "l_shipdate", "l_discount", "l_quantity").withColumn("weekday_no", C.iso_weekday("l_shipdate"))
    out = A.weighted_mean(l, ["weekday_no"], "l_discount", "l_quantity")
    return out.select("weekday_no", r("weighted_mean", 8).alias("weighted_mean"), r("plain_mean", 8).alias("plain_mean"))


@query("switchback_compare", """
with d as (select l_suppkey, cast(l_shipdate as date) as day, count(*) as n_lines, count(case when l_returnflag = 'R' then 1 end) as n_back, sum(l_extendedprice) as gmv from lineitem group by all),
c as (select *, cast('0x' || substr(md5('switch' || l_suppkey || '-' || strftime(day, '%Y-%m-%d')), 1, 8) as bigint) % 1000 < 500 as on_day from d),
s as (select s_nationkey, sum(case when on_day then n_lines end) as l1, sum(case when not on_day then n_lines end) as l0, sum(case when on_day then n_back end) as b1,
 sum(case when not on_day then n_back end) as b0, sum(case when on_day then gmv end) as g1, sum(case when not on_day then gmv end) as g0 from c join supplier on l_suppkey = s_suppkey group by 1)
select s_nationkey, l0 as n_lines_config_0, l1 as n_lines_config_1, round(100 * (l0 - l1) / l1, 6) as n_lines_change_percent,
 round(100 * b0 / l0, 6) as back_config_0, round(100 * b1 / l1, 6) as back_config_1, round(100 * b0 / l0 - 100 * b1 / l1, 6) as back_change_points, round(100 * (b0 / l0 - b1 / l1) / (b0 / l0), 6) as back_change_percent,
 round(100 * g0 / l0, 4) as value_config_0, round(100 * g1 / l1, 4) as value_config_1, round(100 * g0 / l0 - 100 * g1 / l1, 4) as value_change_points, round(100 * (g0 / l0 - g1 / l1) / (g0 / l0), 4) as value_change_percent from s""")
def _(spark, folder):
    s = scan_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    l = lines(spark, folder, "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    daily = l.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_back"), F.sum("l_extendedprice").alias("gmv")
    )
    # The coin of each store and day stands in for the configuration file.
    coin = C.hash_bucket(F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.date_format("day", "yyyy-MM-dd")), "switch")
    config = daily.select("l_suppkey", "day", F.when(coin < 500, 1).otherwise(0).alias("config"))
    daily = daily.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    out = B.switchback_compare(daily, config, "l_suppkey", "day", "s_nationkey", {"back": ("n_back", "n_lines"), "value": ("gmv", "n_lines")}, ["n_lines"])
    digits = {c: 4 if c.startswith("value") else 6 for c in out.columns if c.startswith(("back", "value")) or c.endswith("percent")}
    return out.select(*[r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("customer_distribution", """
with c as (select o_custkey, count(*) as n_orders from orders group by 1), t as (select n_orders, count(*) as n_customers from c group by 1)
select n_orders, n_customers, round(100 * n_customers / sum(n_customers) over (), 6) as frequency_percent,
 round(100 * sum(n_customers) over (order by n_orders) / sum(n_customers) over (), 6) as cumulative_percent from t""")
def _(spark, folder):
    out = B.customer_distribution(scan_table(spark, folder, "orders", ["o_custkey"]), "o_custkey")
    return out.withColumn("frequency_percent", r("frequency_percent")).withColumn("cumulative_percent", r("cumulative_percent"))


@query("matched_relative_diff", """
with d as (select *, cast(o_orderdate as date) as day from orders),
n as (select o_custkey, o_orderpriority = '1-URGENT' as treated, count(*) over (partition by o_custkey order by day range between interval 1 day following and interval 31 day following) as next_orders from d),
m as (select c_nationkey, avg(case when treated then next_orders end) as mean_treated, avg(case when not treated then next_orders end) as mean_untreated from n join customer on o_custkey = c_custkey group by 1)
select c_nationkey, round(mean_treated, 6) as mean_treated, round(mean_untreated, 6) as mean_untreated, round(100 * (mean_treated - mean_untreated) / mean_untreated, 6) as relative_diff_percent from m""")
def _(spark, folder):
    o = V.activity_around(orders(spark, folder), ["o_custkey"], "day", F.lit(0.0), F.lit(True), {"next": (1, 31)})
    o = o.withColumn("treated", F.col("o_orderpriority") == "1-URGENT")
    c = scan_table(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    out = I.relative_difference(o.join(c, F.col("o_custkey") == F.col("c_custkey")), ["c_nationkey"], "n_next", "treated")
    return out.select("c_nationkey", *[r(n).alias(n) for n in ("mean_treated", "mean_untreated", "relative_diff_percent")])


# -- metric tables ------------------------------------------------------------

def ab_customers(spark, folder):
    c = scan_table(spark, folder, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return assign_by_hash(c, "c_custkey", "ab", [(500, "control"), (1000, "variant")])


AB_CTE = """
ab as (select c_custkey, c_nationkey, c_mktsegment, case when cast('0x' || substr(md5('ab' || c_custkey), 1, 8) as bigint) % 1000 < 500 then 'control' else 'variant' end as variant from customer)"""


def units(spark, folder):
    o = scan_table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    l = lines(spark, folder, "l_orderkey", "l_returnflag").where("l_returnflag = 'R'")
    # One pass over orders: returned lines are counted per order first.
    back = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_back"))
    done = F.col("o_orderstatus") == "F"
    sums = o.join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("c_custkey").agg(
        F.count_if(done).alias("n_delivered"), F.sum(F.when(done, F.col("o_totalprice"))).alias("gmv"),
        F.coalesce(F.sum("n_back"), F.lit(0)).alias("n_returned"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
    )
    return B.metrics_per_unit(ab_customers(spark, folder), "c_custkey", {"orders": sums})


UNITS_CTE = AB_CTE + """,
units as (select ab.*, coalesce(n_delivered, 0) as n_delivered, coalesce(gmv, 0) as gmv, coalesce(n_returned, 0) as n_returned, coalesce(n_urgent, 0) as n_urgent from ab
 left join (select o_custkey, count(*) as n_delivered, sum(o_totalprice) as gmv from orders where o_orderstatus = 'F' group by 1) a on a.o_custkey = c_custkey
 left join (select o_custkey, count(*) as n_returned from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1) b on b.o_custkey = c_custkey
 left join (select o_custkey, count(*) as n_urgent from orders where o_orderpriority = '1-URGENT' group by 1) u on u.o_custkey = c_custkey)"""


@query("metrics_per_unit", f"with {UNITS_CTE} select c_custkey, variant, n_delivered, round(gmv, 2) as gmv, n_returned, n_urgent from units")
def _(spark, folder):
    return units(spark, folder).select("c_custkey", "variant", "n_delivered", r("gmv", 2).alias("gmv"), "n_returned", "n_urgent")


@query("stitch_metric_tables", f"""
with {AB_CTE}, x as (select cast(date_trunc('month', o_orderdate) as date) as month, variant, o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders join ab on o_custkey = c_custkey),
a as (select month, variant, count(distinct o_custkey) as customers, count(distinct o_orderkey) as orders from x group by all),
b as (select month, variant, round(sum(o_totalprice), 2) as gmv_delivered from x where o_orderstatus = 'F' group by all),
c as (select month, variant, max(o_totalprice) as biggest_open from x where o_orderstatus = 'O' and o_totalprice > 300000 group by all)
select * from a left join b using (month, variant) left join c using (month, variant)""")
def _(spark, folder):
    o = orders(spark, folder).join(ab_customers(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("month", F.to_date(F.date_trunc("month", "day")))
    keys = ["month", "variant"]
    # The three metric tables have the same keys and source, so they are columns of one aggregate.
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    per_customer = o.groupBy(*keys, "o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(status == "F", price)).alias("v"), F.max(F.when((status == "O") & (price > 300000), price)).alias("m")
    )
    return per_customer.groupBy(*keys).agg(
        F.count("o_custkey").alias("customers"), F.sum("n").alias("orders"), r(F.sum("v"), 2).alias("gmv_delivered"), F.max("m").alias("biggest_open")
    )


@query("discount_metrics", f"""
with {AB_CTE}, e as (select c_custkey, variant, date '1997-01-01' + cast(c_custkey % 30 as integer) as first_exposure_at from ab),
o as (select e.c_custkey, o_orderkey, o_totalprice from e join orders on o_custkey = e.c_custkey and cast(o_orderdate as date) >= first_exposure_at where o_orderstatus = 'F'),
m as (select c_custkey, count(distinct o_orderkey) as n_orders, sum(o_totalprice) as gmv from o group by 1),
p as (select c_custkey, count(distinct l_orderkey) as n_discounted, sum(coalesce(l_extendedprice * (1 - l_discount), 0)) as discounted from o left join lineitem on l_orderkey = o_orderkey and l_discount >= 0.05 group by 1)
select e.c_custkey, variant, first_exposure_at, coalesce(n_orders, 0) as n_orders, round(coalesce(gmv, 0), 2) as gmv, coalesce(n_discounted, 0) as n_discounted, round(coalesce(discounted, 0), 4) as discounted_gmv
from e left join m using (c_custkey) left join p using (c_custkey)""")
def _(spark, folder):
    e = ab_customers(spark, folder).select("c_custkey", "variant", F.expr("date_add(date'1997-01-01', cast(c_custkey % 30 as int))").alias("first_exposure_at"))
    o = orders(spark, folder).where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "day", "o_totalprice")
    o = o.join(e.select("c_custkey", "first_exposure_at"), "c_custkey").where(F.col("day") >= F.col("first_exposure_at"))
    l = lines(spark, folder, "l_orderkey", "l_discount", "l_extendedprice").where("l_discount >= 0.05")
    promoted = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    # One row per order before customers are summed, so no order is counted twice.
    per_order = o.join(promoted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    m = per_order.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), r(F.sum("o_totalprice"), 2).alias("gmv"), F.count("l_orderkey").alias("n_discounted"),
        r(F.sum(F.coalesce("v", F.lit(0.0))), 4).alias("discounted_gmv"),
    )
    return B.metrics_per_unit(e, "c_custkey", {"orders": m})


OBSERVATIONS_CTE = """
e as (select c_custkey, date '1997-01-01' + cast(c_custkey % 14 as integer) as exposed from customer),
ob as (select o_custkey, cast(o_orderdate as date) as day, cast(count(*) as double) as n_orders, cast(count(case when o_orderstatus = 'F' then 1 end) as double) as n_delivered
       from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' group by all),
long as (unpivot ob on n_orders, n_delivered into name metric value value),
x as (select c_custkey, exposed, metric, value, (day - date '1997-01-01') // 7 + 1 as week, (exposed - date '1997-01-01') // 7 + 1 as exposure_week
      from e join long on o_custkey = c_custkey where value <> 0 and day > exposed),
w as (select c_custkey, exposed, exposure_week, metric, week, sum(value) as value from x group by all),
c as (select *, sum(value) over (partition by c_custkey, exposed, exposure_week, metric order by week) as running from w),
observed as (select c_custkey, exposed, exposure_week, week, sum(case when metric = 'n_orders' then running else 0 end) as n_orders,
 sum(case when metric = 'n_delivered' then running else 0 end) as n_delivered from c group by all
 union all select c_custkey, exposed, (exposed - date '1997-01-01') // 7 + 1, null, 0, 0 from e where c_custkey not in (select o_custkey from ob where o_custkey is not null))"""


@query("cumulative_observations", f"with {OBSERVATIONS_CTE} select * from observed")
def _(spark, folder):
    return weekly_observations(spark, folder)


def weekly_observations(spark, folder):
    e = scan_table(spark, folder, "customer", ["c_custkey"]).withColumn("exposed", F.expr("date_add(date'1997-01-01', cast(c_custkey % 14 as int))"))
    o = orders(spark, folder).where((F.col("o_orderdate") >= F.lit(date(1997, 1, 1))) & (F.col("o_orderdate") < F.lit(date(1998, 1, 1))))
    ob = o.groupBy(F.col("o_custkey").alias("c_custkey"), "day").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_delivered"))
    return B.cumulative_observations(ob, e, "c_custkey", "day", "exposed", F.lit(date(1997, 1, 1)), ["n_orders", "n_delivered"])
