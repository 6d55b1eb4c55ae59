"""Date spines and the day filters built on them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "calendar_date"


def date_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(DAY))


def data_spine(df: DataFrame, day: str) -> DataFrame:
    """Spine from the first to the last day found in ``df``; no driver round trip."""
    bounds = df.agg(F.min(F.to_date(day)).alias("lo"), F.max(F.to_date(day)).alias("hi"))
    days = F.sequence("lo", "hi", F.expr("interval 1 day"))
    return bounds.where(F.col("lo").isNotNull()).select(F.explode(days).alias(DAY))


def date_spine_offset(spark: SparkSession, start: date, end: date, days_before: int) -> DataFrame:
    """Spine that begins some days before ``start``, for exposures made earlier."""
    return date_spine(spark, start - timedelta(days=days_before), end)


def date_spine_relative(spark: SparkSession, today: date, first_offset: int, last_offset: int) -> DataFrame:
    """Spine between two offsets from ``today``, which the caller names so that
    a run can be repeated."""
    return date_spine(spark, today + timedelta(days=first_offset), today + timedelta(days=last_offset))


def retention_spines(spark: SparkSession, start: date, end: date, look_ahead: int) -> tuple[DataFrame, DataFrame]:
    """The period looked at, and the same with look-ahead days after it."""
    return date_spine(spark, start, end), date_spine(spark, start, end + timedelta(days=look_ahead))


def previous_full_week(today: date) -> tuple[date, date]:
    """Monday and Sunday of the last complete week before ``today``."""
    monday = today - timedelta(days=today.weekday() + 7)
    return monday, monday + timedelta(days=6)


def within_days(df: DataFrame, day: str, start: date, end: date) -> DataFrame:
    """Rows of a period, both days included. The predicate compares the stored
    column with literals, so files and row groups outside it are not read."""
    column = F.col(day)
    if df.schema[day].dataType.simpleString() == "date":
        return df.where(column.between(F.lit(start), F.lit(end)))
    return df.where((column >= F.lit(start)) & (column < F.lit(end + timedelta(days=1))))


def filter_by_spine(df: DataFrame, day: str, spine: DataFrame) -> DataFrame:
    """Rows whose day is in the spine (which may have gaps)."""
    return df.join(spine, F.to_date(df[day]) == spine[DAY], "left_semi")


def spine_left_join(spine: DataFrame, daily: DataFrame, day: str, zero: list[str] = ()) -> DataFrame:
    """Daily rows with the empty days put in; ``zero`` columns become 0 there."""
    joined = spine.join(daily.withColumnRenamed(day, DAY), DAY, "left")
    return joined.fillna(0, list(zero)) if zero else joined
