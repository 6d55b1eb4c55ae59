"""Scalar functions, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import nested as N
from cohorta.operators.splits import assign_by_hash
from cohorta.plans.base import events, lines, query, r, scan_table


@query("string_functions", """
select p_partkey, concat(p_brand, '/', p_type) as joined, concat_ws(' | ', p_brand, p_type, p_name) as separated, trim('  ' || p_name || ' ') as trimmed,
 lower(p_brand) as lowered, upper(p_name) as uppered, substr(p_brand, 7) as brand_no, string_split(p_name, ' ')[1] as first_word, length(p_name) as n_chars from part""")
def _(spark, folder):
    return scan_table(spark, folder, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.concat_ws(" | ", "p_brand", "p_type", "p_name").alias("separated"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.lower("p_brand").alias("lowered"), F.upper("p_name").alias("uppered"),
        F.expr("substr(p_brand, 7)").alias("brand_no"), F.split("p_name", " ")[0].alias("first_word"), F.length("p_name").alias("n_chars"),
    )


@query("date_functions", """
select event_id, cast(ts as date) as day, cast(ts + interval 36 hour as date) as later_day, date_diff('day', cast(ts as date), date '2024-02-01') as days_left,
 cast(date_trunc('week', ts) as date) as week_start, cast(date_trunc('month', ts) as date) as month_start, strftime(ts, '%Y-%m') as month, week(ts) as week_no,
 isodow(ts) as weekday_no, dayname(ts) as weekday_name, ts - interval 2 minute as before, date_sub('second', ts, timestamp '2024-02-01') as seconds_left,
 date_sub('hour', ts, timestamp '2024-02-01') as hours_left from events""")
def _(spark, folder):
    limit = F.lit("2024-02-01").cast("timestamp_ntz")
    return events(spark, folder, "event_id", "ts").select(
        "event_id", F.to_date("ts").alias("day"), F.to_date(F.col("ts") + F.expr("interval 36 hours")).alias("later_day"),
        F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("days_left"),
        F.to_date(F.date_trunc("week", "ts")).alias("week_start"), F.to_date(F.date_trunc("month", "ts")).alias("month_start"),
        C.month_key("ts").alias("month"), F.weekofyear("ts").alias("week_no"), C.iso_weekday("ts").alias("weekday_no"),
        F.date_format("ts", "EEEE").alias("weekday_name"), (F.col("ts") - F.expr("interval 2 minutes")).alias("before"),
        C.seconds_between("ts", limit).alias("seconds_left"), F.timestamp_diff("HOUR", F.col("ts"), limit).alias("hours_left"),
    )


@query("math_functions", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 0) as rounded, floor(l_extendedprice) as floored, abs(l_linenumber - 4) as distance,
 l_orderkey % 7 as remainder, l_orderkey // 28 as whole, cast(round(l_quantity / 7, 0) as bigint) as nearest from lineitem""")
def _(spark, folder):
    # Integer division is `div`; a cast to integer cuts, so it is rounded first where a
    # rounding cast is meant.
    return lines(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 0).alias("rounded"), F.floor("l_extendedprice").alias("floored"),
        F.abs(F.col("l_linenumber") - 4).alias("distance"), (F.col("l_orderkey") % 7).alias("remainder"), F.expr("l_orderkey div 28").alias("whole"),
        F.round(F.col("l_quantity") / 7, 0).cast("long").alias("nearest"),
    )


@query("conditional_functions", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N'), 'none') as flag, nullif(l_discount, 0) as discount,
 if(l_tax > 0.04, 'high', 'low') as tax_level, case l_linestatus when 'F' then 1 else 0 end as is_closed from lineitem""")
def _(spark, folder):
    return lines(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("none")).alias("flag"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("tax_level"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("is_closed"),
    )


@query("cast_functions", """
select o_orderkey, cast(o_orderkey as varchar) as as_text, try_cast(substr(o_orderpriority, 1, 1) as bigint) as as_long, try_cast(o_orderpriority as bigint) as not_a_number,
 cast(o_totalprice as decimal(18, 2)) as as_decimal, cast('2024-01-01 10:00:00' as timestamp) + to_seconds(o_orderkey % 60) as as_ts from orders""")
def _(spark, folder):
    return scan_table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("as_text"), F.expr("try_cast(substr(o_orderpriority, 1, 1) as bigint)").alias("as_long"),
        F.expr("try_cast(o_orderpriority as bigint)").alias("not_a_number"), F.col("o_totalprice").cast("decimal(18,2)").alias("as_decimal"),
        F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, o_orderkey % 60)").alias("as_ts"),
    )


@query("array_functions", """
select vec_id, len(embedding) as n, round(cast(list_sort(embedding)[1] as double), 6) as lowest, round(cast(embedding[1] as double), 6) as first_value, round(cast(embedding[-1] as double), 6) as last_value,
 list_contains(list_transform(embedding, lambda x: x > 0.3), true) as any_large, len(list_filter(embedding, lambda x: x < 0)) as n_negative from embeddings""")
def _(spark, folder):
    v = F.col("embedding")
    return scan_table(spark, folder, "embeddings").select(
        "vec_id", F.size(v).alias("n"), r(F.element_at(F.array_sort(v), 1).cast("double")).alias("lowest"), r(v[0].cast("double")).alias("first_value"),
        r(F.element_at(v, -1).cast("double")).alias("last_value"), F.array_contains(F.transform(v, lambda x: x > F.lit(0.3)), True).alias("any_large"),
        F.size(F.filter(v, lambda x: x < 0)).alias("n_negative"),
    )


@query("unnest_positions", """
select label, pos, count(*) as n, round(sum(cast(val as double)), 4) as total
from (select label, unnest(range(len(embedding))) as pos, unnest(embedding) as val from embeddings) group by all""")
def _(spark, folder):
    rows = scan_table(spark, folder, "embeddings", ["label", "embedding"]).select("label", F.posexplode("embedding").alias("pos", "val"))
    return rows.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("val").cast("double")), 4).alias("total"))


@query("json_functions", """
select event_id, json_extract_string(props, '$.k') as k_text, cast(json_extract_string(props, '$.k') as bigint) as k,
 json_extract_string(props, '$.absent') as absent from events""")
def _(spark, folder):
    parsed = F.from_json("props", "k long")
    return events(spark, folder, "event_id", "props").select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"), parsed["k"].alias("k"), F.get_json_object("props", "$.absent").alias("absent")
    )


@query("hash_functions", """
select o_orderkey, md5(o_orderpriority || o_orderkey) as digest, cast('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 14) as bigint) as number,
 cast('0x' || substr(md5('salt' || o_custkey), 1, 8) as bigint) % 1000 as bucket from orders""")
def _(spark, folder):
    return scan_table(spark, folder, "orders").select(
        "o_orderkey", F.md5(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("digest"),
        F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 14), 16, 10).cast("long").alias("number"),
        C.hash_bucket("o_custkey", "salt").alias("bucket"),
    )


@query("random_choice_weighted", """
select case when b < 100 then 'hold-out' when b < 550 then 'control' else 'variant' end as choice, count(*) as n
from (select cast('0x' || substr(md5('draw' || c_custkey), 1, 8) as bigint) % 1000 as b from customer) group by 1""")
def _(spark, folder):
    bounds = [(100, "hold-out"), (550, "control"), (1000, "variant")]
    c = assign_by_hash(scan_table(spark, folder, "customer", ["c_custkey"]), "c_custkey", "draw", bounds, name="choice")
    return c.groupBy("choice").agg(F.count(F.lit(1)).alias("n"))


def dispatched(spark, folder):
    """Dispatch events, several per order, each with up to three products (or none) and
    a strategy per product as JSON text; made from the lines of an order."""
    l = lines(spark, folder, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")

    def product(i):
        number = F.col("l_partkey") + i
        text = F.when(number % 3 == 0, '{"action":"REMOVE"}').otherwise(
            F.format_string('{"action":"REPLACE","alternativeproducts":[{"externalid":"%d"},{"externalid":"%d"}]}', number + 1, number + 2)
        )
        return F.struct(number.cast("string").alias("external_id"), text.alias("strategy"))

    three = F.array(product(1), product(2), product(3))
    return l.withColumn("products", F.slice(three, F.lit(1), F.col("l_linenumber") % 4))


EVENT_ORDER = ["l_shipdate", "l_suppkey", "l_linenumber", "l_partkey"]

_LAST_CTE = """
e as (select * from lineitem
      qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_suppkey desc, l_linenumber desc, l_partkey desc) = 1),
p as (select l_orderkey, l_partkey + unnest(range(1, 1 + l_linenumber % 4)) as product from e)"""


@query("nested_unnest", f"with {_LAST_CTE} select l_orderkey, cast(product as varchar) as external_id from p")
def _(spark, folder):
    rows = N.unpack_products(dispatched(spark, folder), "l_orderkey", EVENT_ORDER, "products")
    return rows.select("l_orderkey", "external_id")


@query("unpack_instructions", f"""
with {_LAST_CTE} select l_orderkey, cast(product as varchar) as external_id, case when product % 3 = 0 then 'REMOVE' else 'REPLACE' end as action,
 case when product % 3 = 0 then 0 else 2 end as n_alternatives,
 case when product % 3 = 0 then '' else (product + 1) || ',' || (product + 2) end as alternatives from p""")
def _(spark, folder):
    rows = N.unpack_instructions(dispatched(spark, folder), "l_orderkey", EVENT_ORDER, "products", "strategy")
    return rows.select("l_orderkey", "external_id", "action", F.size("alternatives").alias("n_alternatives"), F.concat_ws(",", "alternatives").alias("alternatives"))
