"""Experiment exposures: windows, variants at event time, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import safe_ratio
from cohorta.operators.scans import GROUP_LIMIT, HotGroups, last_known, next_value, ordered_scans
from cohorta.operators.spine import DAY


def exposure_windows(
    exposures: DataFrame,
    keys: Sequence[str],
    time: str,
    open_end: Column,
    tie: Sequence[str] = (),
    *,
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Give every exposure the window [start_time, end_time) until the next one of
    the same keys; the last window ends at ``open_end``.

    ``keys`` should name the experiment as well as the customer, otherwise windows
    of two experiments cut each other short. ``tie`` orders exposures of equal time;
    all but the last of them get a window of length zero.
    """
    scanned = ordered_scans(
        exposures, keys, [time, *tie], {"_next": next_value(time)},
        group_limit=group_limit, probe=exposures.select(*keys), hot=hot,
    )
    return (
        scanned.withColumn("end_time", F.coalesce("_next", open_end))
        .withColumnRenamed(time, "start_time")
        .drop("_next")
    )


def assign_variant(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    at: str,
    take: Sequence[str] = ("variant",),
    how: str = "inner",
    *,
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Window of the same keys that holds the event: start <= time < end.

    Windows of one key must not overlap (``exposure_windows`` makes such). Events
    and windows are put in one time order and each event takes the last window
    seen, which costs one sort per key; a join would first build every pair of an
    event and a window of that key.
    """
    scanned = _with_last_window(events, windows, keys, at, take, group_limit, hot)
    inside = F.col(at) < F.col("_w.end_time")
    if how == "inner":
        return scanned.where(inside).select(*events.columns, *[F.col(f"_w.{c}").alias(c) for c in take])
    return scanned.select(*events.columns, *[F.when(inside, F.col(f"_w.{c}")).alias(c) for c in take])


def assign_variant_closed(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    at: str,
    take: Sequence[str] = ("variant",),
    how: str = "inner",
    *,
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Same with both ends included: start <= time <= end, so an event on a border
    is repeated for each different window that touches it.

    Besides the window of the half-open rule these are the windows that end exactly
    at the event, which an equi join on (keys, time) finds.
    """
    scanned = _with_last_window(events, windows, keys, at, take, group_limit, hot)
    inside = F.col(at) < F.col("_w.end_time")
    fields = F.struct(*[F.col(f"_w.{c}").alias(c) for c in take])
    own = F.when(inside, fields)
    # At most one window of positive length ends at an instant, and equal windows count
    # once, so these lists hold no more than one entry per variant and one over.
    ends = (
        windows.select(*keys, "start_time", "end_time", *take).distinct()
        .groupBy(*keys, F.col("end_time").alias("_at"))
        .agg(F.collect_list(F.struct(*take)).alias("_ended"))
    )
    joined = scanned.withColumn("_at", F.col(at)).join(ends, [*keys, "_at"], "left")
    matched = F.array_compact(F.concat(F.array(own), F.coalesce("_ended", F.array().cast(ends.schema["_ended"].dataType))))
    spread = F.explode(matched) if how == "inner" else F.explode_outer(matched)
    return (
        joined.select(*events.columns, spread.alias("_m"))
        .select(*events.columns, *[F.col(f"_m.{c}").alias(c) for c in take])
    )


def _with_last_window(events, windows, keys, at, take, group_limit, hot):
    window_rows = windows.select(
        *keys,
        F.col("start_time").alias("_t"),
        F.lit(0).alias("_kind"),
        F.struct("end_time", *take).alias("_window"),
    )
    event_rows = events.withColumn("_t", F.col(at)).withColumn("_kind", F.lit(1))
    both = event_rows.unionByName(window_rows, allowMissingColumns=True)
    probe = events.select(*keys).unionByName(windows.select(*keys))
    scanned = ordered_scans(
        both, keys, ["_t", "_kind", "_window"], {"_w": last_known("_window")},
        group_limit=group_limit, probe=probe, hot=hot, match_nulls=False,
    )
    return scanned.where(F.col("_kind") == 1)


def first_exposure(exposures: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Earliest exposure per keys (customer and variant, as a rule)."""
    return exposures.groupBy(*keys).agg(F.min(time).alias("first_exposure_at"))


def with_pre_exposure(windows: DataFrame, keys: Sequence[str], period_start: Column, label: str = "before exposure") -> DataFrame:
    """Windows plus one window per customer from the period's start to the first exposure."""
    before = (
        windows.groupBy(*keys).agg(F.min("start_time").alias("end_time"))
        .withColumn("start_time", period_start)
        .withColumn("variant", F.lit(label))
        .where(F.col("start_time") < F.col("end_time"))
    )
    columns = [*keys, "variant", "start_time", "end_time"]
    return windows.select(*columns).unionByName(before.select(*columns))


def filtered_exposure(exposures: DataFrame, touches: DataFrame, keys: Sequence[str], exposed_at: str, touch_time: str, condition: Column) -> DataFrame:
    """Exposures count from the customer's first touch that meets ``condition`` and is
    not earlier than the exposure; others drop out.

    The touch taken is the first qualifying one after exposure to any variant, and it
    then counts for every variant whose exposure is not later than it.
    """
    firsts = exposures.groupBy(*keys).agg(F.min(exposed_at).alias("_from"))
    touch = (
        touches.where(condition).join(firsts, list(keys))
        .where(F.col(touch_time) >= F.col("_from"))
        .groupBy(*keys).agg(F.min(touch_time).alias("_touch"))
    )
    return (
        exposures.join(touch, list(keys))
        .where(F.col("_touch") >= F.col(exposed_at))
        .groupBy(*keys, "variant").agg(F.min(F.to_date("_touch")).alias("first_exposure_at"))
    )


def exposures_by_day(exposures: DataFrame, customer: str, time: str) -> DataFrame:
    """New customers per variant and first day; unknown customers count as none."""
    firsts = first_exposure(exposures, [customer, "variant"], time)
    return firsts.groupBy(F.to_date("first_exposure_at").alias("exposure_day"), "variant").agg(
        F.count(customer).alias("n_customers")
    )


def exposure_split(exposures: DataFrame, day: Column, customer: str, variants: Sequence[str]) -> DataFrame:
    """Distinct known customers per day and variant, side by side, with each one's share."""
    counts = (
        exposures.where(F.col(customer).isNotNull()).select(day.alias("day"), customer, "variant").distinct()
        .groupBy("day").pivot("variant", list(variants)).count().fillna(0, list(variants))
    )
    total = sum((F.col(v) for v in variants[1:]), F.col(variants[0]))
    return counts.select(
        "day",
        *[F.col(v).alias(f"n_{v}") for v in variants],
        *[safe_ratio(v, total).alias(f"share_{v}") for v in variants],
    )


def active_windows_by_day(windows: DataFrame, spine: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Per day and variant (None for an unknown one, counted as ``n_null``), how many
    windows cover that day's midnight, both ends included.

    Every window adds one on its first covered day and takes one off after its last,
    so the cost is two rows per window and a running total over days, rather than
    one row per window and day.
    """
    first = F.when(F.to_date("start_time").cast("timestamp_ntz") == F.col("start_time"), F.to_date("start_time")).otherwise(
        F.date_add(F.to_date("start_time"), 1)
    )
    after = F.date_add(F.to_date("end_time"), 1)
    covered = windows.select("variant", first.alias("_first"), after.alias("_after")).where(F.col("_first") < F.col("_after"))
    steps = covered.select(
        "variant",
        F.explode(
            F.array(
                F.struct(F.col("_first").alias("day"), F.lit(1).alias("step")),
                F.struct(F.col("_after").alias("day"), F.lit(-1).alias("step")),
            )
        ).alias("s"),
    )
    names = {v: "null" if v is None else v for v in variants}
    daily = steps.groupBy(F.col("s.day").alias(DAY)).agg(
        *[F.sum(F.when(F.col("variant").eqNullSafe(F.lit(v)), F.col("s.step"))).alias(f"_{n}") for v, n in names.items()]
    )
    # Days are few: one row per day of the period.
    whole = Window.partitionBy(F.lit(0)).orderBy(DAY)
    joined = daily.withColumn("_in", F.lit(False)).unionByName(
        spine.select(DAY).withColumn("_in", F.lit(True)), allowMissingColumns=True
    )
    per_day = joined.groupBy(DAY).agg(
        F.max("_in").alias("_in"), *[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(f"_{n}") for n in names.values()]
    )
    return (
        per_day.select(DAY, "_in", *[F.sum(f"_{n}").over(whole).alias(f"n_{n}") for n in names.values()])
        .where("_in").drop("_in")
    )


def conflict_customers(exposures: DataFrame, customer: str, known: Sequence[str]) -> DataFrame:
    """Customers with a variant outside the known ones (null included)."""
    odd = F.col("variant").isNull() | ~F.col("variant").isin(list(known))
    return exposures.where(odd).select(customer).distinct()
