"""Registry of queries and the frames several of them start from.

The test tables hold no experiments, sessions or surfaces, so those are derived: an
exposure is a ``signup`` event whose variant comes from a salted hash, a session is a
run of a user's events without a silence of more than six hours, a store is a supplier.
Every SQL text says the same in its own way, mostly as plain joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions.columns import col, hash_bucket
from cohorta.operators.exposure import exposure_windows
from cohorta.operators.funnel import sessionize
from cohorta.operators.scans import GROUP_LIMIT, HotGroups, hot_groups
from cohorta.session import tune
from cohorta.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL when it has one."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def r(value: str | Column, digits: int = 6) -> Column:
    return F.round(col(value), digits)


SESSION_GAP = 6 * 3600
OPEN_END = "2024-02-01 00:00:00"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp_ntz")


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


class SomeKeysUnknown(str):
    """A folder whose tables are read with one key in seven unknown."""


UNKNOWN = {"events": ["user_id"], "orders": ["o_custkey"], "lineitem": ["l_partkey"]}


def scan_table(spark, folder, name, columns=None):
    df = tables.scan_table(spark, folder, name, columns, SCHEMAS[name])
    if isinstance(folder, SomeKeysUnknown):
        keys = [k for k in UNKNOWN.get(name, []) if k in df.columns]
        df = df.withColumns({k: F.when(F.col(k) % 7 != 0, F.col(k)) for k in keys})
    return df


def events(spark, folder, *columns):
    return scan_table(spark, folder, "events", columns or None)


def orders(spark, folder):
    """Orders with a day column."""
    o = scan_table(spark, folder, "orders")
    return o.withColumn("day", F.to_date("o_orderdate"))


def lines(spark, folder, *columns):
    return scan_table(spark, folder, "lineitem", columns or None)


def calm_users(spark, folder) -> HotGroups | None:
    """One measurement for all scans by user. The frames made from events hold at most two
    rows per event, so with half the limit here none of them can pass the limit; when
    some user has more, every operator measures for itself."""
    found = hot_groups(events(spark, folder, "user_id"), ["user_id"], GROUP_LIMIT // 2)
    return None if found.groups else found


def exposures(spark, folder):
    e = events(spark, folder, "event_id", "ts", "user_id", "event_type").where("event_type = 'signup'")
    variant = F.when(hash_bucket("event_id", "exp1") < 500, "control").otherwise("treatment")
    return e.select(F.col("user_id").alias("customer_id"), "event_id", variant.alias("variant"), "ts")


def windows(spark, folder, calm=None):
    return exposure_windows(exposures(spark, folder), ["customer_id"], "ts", open_end(), ["event_id"], hot=calm)


def sessions(spark, folder, calm=None):
    e = events(spark, folder)
    return sessionize(e, "user_id", "ts", SESSION_GAP, ["event_id"], hot=calm).withColumn("day", F.to_date("ts"))


EXPOSURES_CTE = """
exposures as (
  select user_id as customer_id, event_id, ts,
         case when cast('0x' || substr(md5('exp1' || event_id), 1, 8) as bigint) % 1000 < 500
              then 'control' else 'treatment' end as variant
  from events where event_type = 'signup')"""

WINDOWS_CTE = EXPOSURES_CTE + f""",
windows as (
  select customer_id, event_id, variant, ts as start_time,
         coalesce(lead(ts) over (partition by customer_id order by ts, event_id),
                  timestamp '{OPEN_END}') as end_time
  from exposures)"""

SESSIONS_CTE = """
marked as (
  select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 6 hour then ts end as begin_ts
  from events window w as (partition by user_id order by ts, event_id)),
sessions as (
  select event_id, ts, user_id, event_type, value, props, cast(ts as date) as day,
         max(begin_ts) over (partition by user_id order by ts, event_id rows unbounded preceding) as session_start,
         user_id || '-' || epoch_us(max(begin_ts) over (partition by user_id order by ts, event_id
                                                        rows unbounded preceding)) as session_id
  from marked)"""
