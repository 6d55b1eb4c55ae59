"""Validity intervals (SCD2) made from dated snapshots, all at once or one day at a time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators.scans import GROUP_LIMIT, ordered_scans, previous_value, running_sum

FROM, TO = "valid_from", "valid_to"


def _state(columns: Sequence[str]) -> Column:
    """What a version consists of; null is a value like any other."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def versions(snapshots: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """keys, columns, valid_from, valid_to (exclusive; null where the version is in the last
    snapshot): one row per run of snapshots in which a key has the same columns.

    A version ends on the first snapshot that shows the key otherwise, or not at all. Snapshot days are
    those found in the table; they need not follow each other daily. One row per key and day. Keys of any
    number of snapshots are scanned in bounded chunks.
    """
    days = snapshots.select(day).distinct()
    # One row per snapshot: a list as short as the history is long.
    seen = days.withColumn("_one", F.lit(1).cast("long"))
    numbered = ordered_scans(seen, [], [day], {"_nth": running_sum("_one")}, group_limit=group_limit).drop("_one")
    following = numbered.select((F.col("_nth") - 1).alias("_nth"), F.col(day).alias("_next_day"))
    calendar = numbered.join(following, "_nth", "left")
    s = snapshots.select(*keys, day, *columns).withColumn("_state", _state(columns)).join(calendar, day)

    def starts(scanned):
        same = (F.col("_state") == F.col("_before")) & (F.col("_nth") == F.col("_nth_before") + 1)
        return scanned.withColumn("_starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)), {"_version": running_sum("_starts")}

    scans = {"_before": previous_value("_state"), "_nth_before": previous_value("_nth")}
    marked = ordered_scans(s, keys, [day], scans, group_limit=group_limit, then=starts)
    last = F.max_by("_next_day", day)
    return marked.groupBy(*keys, "_version").agg(
        *[F.min_by(c, day).alias(c) for c in columns], F.min(day).alias(FROM), last.alias(TO)
    ).select(*keys, *columns, FROM, TO)


def _open(spark: SparkSession, path: str, as_of: date, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/open/as_of={as_of}")


def add_snapshot(path: str, snapshot: DataFrame, keys: Sequence[str], columns: Sequence[str], day: date, previous: date | None) -> None:
    """Bring the history under ``path`` from the snapshot of ``previous`` to that of ``day``.

    Versions that go on live in ``open/as_of=<day>``, those that ended in ``closed/closed_on=<day>``.
    Only the last open part is read, and only this day's two parts are written, whole, so a day
    can be repeated; closed days are never touched. The first snapshot has no ``previous``.
    """
    spark = snapshot.sparkSession
    new = snapshot.select(*keys, *columns).withColumn("_state", _state(columns))
    names = [*keys, *columns]
    if previous is None:
        new.select(*names, F.lit(day).alias(FROM)).write.mode("overwrite").parquet(f"{path}/open/as_of={day}")
        return
    schema = snapshot.select(*names, F.lit(day).alias(FROM)).schema
    old = _open(spark, path, previous, schema).withColumn("_old_state", _state(columns))
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in [*names, FROM]], "_old_state")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    both = new.join(o, match, "full")
    here, there = F.col("_state").isNotNull(), F.col("_old_state").isNotNull()
    same = here & there & (F.col("_state") == F.col("_old_state"))
    since = F.when(same, F.col(f"_o_{FROM}")).otherwise(F.lit(day)).alias(FROM)
    both.where(here).select(*names, since).write.mode("overwrite").parquet(f"{path}/open/as_of={day}")
    ended = both.where(there & ~F.coalesce(same, F.lit(False))).select(*[F.col(f"_o_{c}").alias(c) for c in [*names, FROM]], F.lit(day).alias(TO))
    ended.write.mode("overwrite").parquet(f"{path}/closed/closed_on={day}")


def read_history(spark: SparkSession, path: str, days: Sequence[date], like: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The history after the last of ``days``, the days added so far in order."""
    schema = like.select(*keys, *columns, F.lit(days[-1]).alias(FROM)).schema
    out = _open(spark, path, days[-1], schema).withColumn(TO, F.lit(None).cast("date"))
    closed = like.select(*keys, *columns, F.lit(days[-1]).alias(FROM), F.lit(days[-1]).alias(TO)).schema
    if len(days) > 1:
        out = out.unionByName(spark.read.schema(closed).parquet(*[f"{path}/closed/closed_on={d}" for d in days[1:]]))
    return out
