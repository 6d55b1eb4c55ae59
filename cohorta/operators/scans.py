"""Ordered scans over groups of any size.

A window function sorts a whole group in one task. That is the best plan while
groups are small, and the wrong one when a single key (or no key at all) holds a
large part of the data. ``ordered_scans`` counts rows per group first and sends
every row one of two ways, with equal results:

* groups of at most ``group_limit`` rows go through plain window functions;
* the rows of larger groups are range-partitioned on (keys, order) into chunks of
  bounded size, every chunk is scanned by itself, and each (chunk, key) is completed
  from a summary with one row per (chunk, key). A key meets several chunks only
  where it crosses a chunk border, so the part of the summary that is joined back
  has at most two rows per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.session import ensure_checkpoint_dir

GROUP_LIMIT = 2_000_000
LONE = "_lone"


@dataclass(frozen=True)
class Scan:
    """One scan: what to compute (``kind``) from which column (``source``)."""

    kind: str
    source: str


def next_value(source: str) -> Scan:
    """Value in the next row, null included."""
    return Scan("next", source)


def previous_value(source: str) -> Scan:
    """Value in the row before, null included."""
    return Scan("previous", source)


def next_known(source: str) -> Scan:
    """First non-null value in the rows after this one."""
    return Scan("next_known", source)


def last_known(source: str) -> Scan:
    """Last non-null value up to and including this row."""
    return Scan("last_known", source)


def upcoming(source: str) -> Scan:
    """First non-null value from this row on, this row included."""
    return Scan("upcoming", source)


def seen(source: str) -> Scan:
    """Set of the distinct non-null values up to and including this row. Meant for columns
    with few different values per key (variants, countries), whatever the number of rows."""
    return Scan("seen", source)


def running_sum(source: str) -> Scan:
    """Sum up to and including this row; null counts as nothing."""
    return Scan("running_sum", source)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count per group. Counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))


@dataclass(frozen=True)
class HotGroups:
    """Groups too large for one task: their keys, how many there are, their rows."""

    keys: DataFrame
    groups: int
    rows: int
    limit: int


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, coarse: Sequence[str] = ()) -> HotGroups:
    """Find the groups with more than ``limit`` rows. This runs a job that reads the key
    columns only; at most (all rows / limit) groups can be hot.

    ``coarse`` is a part of the keys that is cheaper to read. Where no coarse group is too
    large no finer one is, and the finer keys are not looked at.
    """
    if coarse:
        first = hot_groups(df, coarse, limit)
        if not first.groups:
            return HotGroups(df.select(*keys).limit(0), 0, 0, limit)
    sizes = group_sizes(df.select(*keys), keys) if keys else df.agg(F.count(F.lit(1)).alias("_size"))
    over = F.col("_size") > limit
    groups, rows = sizes.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_size"))), F.lit(0))).first()
    return HotGroups(sizes.where(over).select(*keys), groups, rows, limit)


def lone_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a key column that leaves every row with a null key alone: null where all keys
    are known, else a number of its own. With it among the keys of a scan, null keys meet
    nothing, as in a join, and are no hot group."""
    unknown = reduce(or_, [F.col(k).isNull() for k in keys])
    return df.withColumn(LONE, F.when(unknown, F.monotonically_increasing_id()))


def _known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))


def ordered_scans(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: dict[str, Scan],
    *,
    group_limit: int = GROUP_LIMIT,
    probe: DataFrame | None = None,
    hot: HotGroups | None = None,
    match_nulls: bool = True,
    then: Callable[[DataFrame], tuple[DataFrame, dict[str, Scan]]] | None = None,
) -> DataFrame:
    """Add one column per scan, computed within ``keys`` in ascending ``order``.

    ``order`` should put equal rows in a fixed sequence, otherwise rows with the
    same order values may swap. ``probe`` is a cheaper frame with the same keys
    to measure group sizes on; ``hot`` is such a measurement already made.

    Rows with equal null keys are one group, as in a window function. Without
    ``match_nulls`` each of them is a group by itself, as in a join.

    ``then`` takes the scanned frame, may add columns to it, and names further scans over
    the same groups in the same order; hot rows are cut into chunks only once for both.
    """
    keys = list(keys)
    if not match_nulls:
        hot = hot or hot_groups(_known_keys(df if probe is None else probe, keys), keys, group_limit)
        if hot.groups:
            hot = replace(hot, keys=_known_keys(hot.keys, hot.keys.columns))
        return ordered_scans(lone_nulls(df, keys), [*keys, LONE], order, scans, hot=hot, then=then).drop(LONE)
    hot = hot or hot_groups(df if probe is None else probe, keys, group_limit)

    def run(frame, scan, order=order):
        out = scan(frame, keys, order, scans)
        if then is None:
            return out
        again, more = then(out)
        return scan(again, keys, order, more)

    def run_hot(frame):
        return run(_cut(frame, keys, order, chunks), _by_chunks, [*order, "_spread"]).drop("_chunk", "_spread")

    if not hot.groups:
        return run(df, _within)
    chunks = max(2, -(-hot.rows // max(1, hot.limit // 2)))
    if not keys:
        return run_hot(df)

    # A measurement on part of the keys sends all groups of a hot part the chunked way.
    measured = [k for k in keys if k in hot.keys.columns]
    hot_keys = hot.keys.select(*[F.col(k).alias(f"_hot_{k}") for k in measured])
    is_hot = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in measured])
    cold_part = run(df.join(hot_keys, is_hot, "left_anti"), _within)
    return cold_part.unionByName(run_hot(df.join(hot_keys, is_hot, "left_semi")))


def _spec(keys, order, descending=False):
    partition = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return partition.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])


def _scan_column(scan: Scan, keys, order):
    ahead = _spec(keys, order)
    back = _spec(keys, order, descending=True)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    source = F.col(scan.source)
    if scan.kind == "next":
        return F.lead(source).over(ahead)
    if scan.kind == "previous":
        return F.lag(source).over(ahead)
    # "From here to the end" is taken as "from the end to here" in reverse order:
    # frames with an unbounded end are recomputed for every row.
    if scan.kind == "next_known":
        before = back.rowsBetween(Window.unboundedPreceding, -1)
        return F.last(source, ignorenulls=True).over(before)
    if scan.kind == "upcoming":
        return F.last(source, ignorenulls=True).over(back.rowsBetween(*so_far))
    if scan.kind == "last_known":
        return F.last(source, ignorenulls=True).over(ahead.rowsBetween(*so_far))
    if scan.kind == "running_sum":
        return F.sum(source).over(ahead.rowsBetween(*so_far))
    if scan.kind == "seen":
        return F.collect_set(source).over(ahead.rowsBetween(*so_far))
    raise ValueError(scan.kind)


def _same_direction_first(scans):
    """Scans in the same direction next to each other share one sort."""
    return sorted(scans.items(), key=lambda kv: kv[1].kind in ("next_known", "upcoming"))


def _within(df, keys, order, scans):
    out = df
    columns = df.columns
    for name, scan in _same_direction_first(scans):
        out = out.withColumn(name, _scan_column(scan, keys, order))
    return out.select(*columns, *scans)


def _cut(df, keys, order, chunks):
    """Number the rows' chunks. Range bounds come from a sample that is drawn anew per
    plan, so the numbers are written down once and all later readers see the same ones.
    Rows equal in keys and order may go to either side of a border: a spread number after
    the order columns keeps chunks bounded where most rows are equal."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.withColumn("_spread", F.rand(11)).repartitionByRange(chunks, *keys, *order, "_spread")
    return ranged.withColumn("_chunk", F.spark_partition_id()).checkpoint()


def _by_chunks(ranged, keys, order, scans):
    columns = ranged.columns
    position = F.struct(*[F.col(c) for c in order])
    known = lambda c: F.when(F.col(c).isNotNull(), position)

    facts = []
    for name, scan in scans.items():
        source = F.col(scan.source)
        if scan.kind == "next":
            facts.append(F.min_by(F.struct(source), position).alias(f"_{name}_edge"))
        elif scan.kind == "previous":
            facts.append(F.max_by(F.struct(source), position).alias(f"_{name}_edge"))
        elif scan.kind in ("next_known", "upcoming"):
            facts.append(F.min_by(source, known(scan.source)).alias(f"_{name}_edge"))
        elif scan.kind == "last_known":
            facts.append(F.max_by(source, known(scan.source)).alias(f"_{name}_edge"))
        elif scan.kind == "seen":
            facts.append(F.collect_set(source).alias(f"_{name}_edge"))
        else:
            facts.append(F.sum(source).alias(f"_{name}_edge"))
    summary = ranged.groupBy(*keys, "_chunk").agg(*facts)

    # One row per (chunk, key): these windows see at most `chunks` rows per key.
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    forward = per_key.orderBy("_chunk")
    reverse = per_key.orderBy(F.col("_chunk").desc())
    summary = summary.withColumn("_spans", F.count(F.lit(1)).over(per_key))
    for name, scan in scans.items():
        edge = F.col(f"_{name}_edge")
        if scan.kind == "next":
            summary = summary.withColumn(f"_{name}_in", F.lead(edge).over(forward))
        elif scan.kind == "previous":
            summary = summary.withColumn(f"_{name}_in", F.lag(edge).over(forward))
        else:
            start = reverse if scan.kind in ("next_known", "upcoming") else forward
            before = start.rowsBetween(Window.unboundedPreceding, -1)
            if scan.kind == "running_sum":
                value = F.sum(edge).over(before)
            elif scan.kind == "seen":
                value = F.array_distinct(F.flatten(F.collect_list(edge).over(before)))
            else:
                value = F.last(edge, ignorenulls=True).over(before)
            summary = summary.withColumn(f"_{name}_in", value)
    incoming = summary.where(F.col("_spans") > 1).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_chunk").alias("_key_chunk"),
        *[f"_{name}_in" for name in scans],
    )

    local = ranged
    inner = ["_chunk", *keys]
    for name, scan in _same_direction_first(scans):
        local = local.withColumn(name, _scan_column(scan, inner, order))
        if scan.kind in ("next", "previous"):
            # Tells "the neighbour's value is null" from "no neighbour in this chunk".
            shift = F.lead if scan.kind == "next" else F.lag
            local = local.withColumn(f"_{name}_has", shift(F.lit(True)).over(_spec(inner, order)))

    match = F.col("_chunk") == F.col("_key_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    # At most two rows per chunk, whatever the data: a proven bound for broadcast.
    joined = local.join(F.broadcast(incoming), match, "left")

    result = []
    for name, scan in scans.items():
        here, other = F.col(name), F.col(f"_{name}_in")
        if scan.kind in ("next", "previous"):
            value = F.when(F.col(f"_{name}_has").isNotNull(), here).otherwise(other.getField(scan.source))
        elif scan.kind == "running_sum":
            value = F.when(here.isNull(), other).otherwise(here + F.coalesce(other, F.lit(0)))
        elif scan.kind == "seen":
            value = F.when(other.isNull(), here).otherwise(F.array_union(other, here))
        else:
            value = F.coalesce(here, other)
        result.append(value.alias(name))
    return joined.select(*columns, *result)
