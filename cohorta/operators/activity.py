"""Retention and activity around an order.

All "orders of the same customer in the following N days" questions have day
resolution. Orders are therefore first added up per key and day; windows over days
then see at most one row per calendar day, however many orders a customer has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import all_of, safe_ratio
from cohorta.operators.scans import GROUP_LIMIT, next_known, ordered_scans


def _per_day(orders: DataFrame, keys: Sequence[str], day: str, sums: dict[str, Column]) -> DataFrame:
    return orders.groupBy(*keys, F.col(day).alias("_day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def _back_to_orders(orders: DataFrame, daily: DataFrame, keys: Sequence[str], day: str, names: Sequence[str]) -> DataFrame:
    right = daily.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_day", *names)
    match = all_of([orders[k].eqNullSafe(right[f"_r_{k}"]) for k in keys] + [orders[day] == right["_day"]])
    return orders.join(right, match, "left").select(*orders.columns, *names)


def activity_around(orders: DataFrame, keys: Sequence[str], day: str, value: Column, counts: Column, frames: dict[str, tuple[int, int]]) -> DataFrame:
    """Per order, for each named frame of days (from, to) relative to its day: number of
    orders, their total value and average value. ``counts`` says which orders count
    (their day matters, the order looked at need not count itself)."""
    sums = {"_n": F.when(counts, 1).otherwise(0).cast("long"), "_v": F.when(counts, value)}
    daily = _per_day(orders, keys, day, sums).withColumn("_at", F.unix_date("_day"))
    spec = Window.partitionBy(*keys).orderBy("_at")
    names = []
    for name, (lo, hi) in frames.items():
        frame = spec.rangeBetween(lo, hi)
        daily = daily.withColumn(f"n_{name}", F.coalesce(F.sum("_n").over(frame), F.lit(0)))
        daily = daily.withColumn(f"value_{name}", F.coalesce(F.sum("_v").over(frame), F.lit(0.0)))
        daily = daily.withColumn(f"average_{name}", F.coalesce(safe_ratio(f"value_{name}", f"n_{name}"), F.lit(0.0)))
        names += [f"n_{name}", f"value_{name}", f"average_{name}"]
    return _back_to_orders(orders, daily, keys, day, names)


def subsequent_orders(orders: DataFrame, keys: Sequence[str], day: str, days: int, flag: Column) -> DataFrame:
    """Per order, how many other orders of the same keys fall on its day or the ``days``
    after it, in total and among the flagged ones. Other orders of the same day count,
    earlier ones too. An order with a null key has no others."""
    flagged = F.coalesce(flag, F.lit(False))
    sums = {"_all": F.lit(1).cast("long"), "_flagged": F.when(flagged, 1).otherwise(0).cast("long")}
    daily = _per_day(orders, keys, day, sums).withColumn("_at", F.unix_date("_day"))
    frame = Window.partitionBy(*keys).orderBy("_at").rangeBetween(0, days)
    daily = daily.withColumn("_all", F.sum("_all").over(frame)).withColumn("_flagged", F.sum("_flagged").over(frame))
    out = _back_to_orders(orders, daily, keys, day, ["_all", "_flagged"])
    unknown = ~all_of([F.col(k).isNotNull() for k in keys])
    out = out.withColumn("_all", F.when(unknown, 1).otherwise(F.col("_all")))
    out = out.withColumn("_flagged", F.when(unknown, F.when(flagged, 1).otherwise(0)).otherwise(F.col("_flagged")))
    return (
        out.withColumn("orders_after", F.col("_all") - 1)
        .withColumn("flagged_orders_after", F.col("_flagged") - F.when(flagged, 1).otherwise(0))
        .drop("_all", "_flagged")
    )


def retention(orders: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, days: int, *, name: str = "is_retained", null_keys: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Add the day of the next order of the same keys and whether it is at most
    ``days`` away. No next order gives false, and so does a null key, unless ``null_keys``
    lets orders with equal null keys follow each other."""
    found = ordered_scans(orders, keys, order, {"_next": next_known(day)}, group_limit=group_limit, probe=orders.select(*keys))
    known = all_of([F.col(k).isNotNull() for k in keys])
    following = F.col("_next") if null_keys else F.when(known, F.col("_next"))
    near = F.coalesce(F.datediff(following, F.col(day)) <= days, F.lit(False))
    return found.withColumn("next_day", following).withColumn(name, near).drop("_next")


def activity_density(df: DataFrame, unit: str, day: str, period_days: int) -> DataFrame:
    """Days with activity over days in the period, per unit."""
    return df.groupBy(unit).agg(F.countDistinct(day).alias("active_days")).withColumn(
        "density", safe_ratio("active_days", F.lit(period_days))
    )
