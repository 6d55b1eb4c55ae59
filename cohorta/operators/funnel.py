"""Sessions, time-ordered funnels and follow-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import seconds_between
from cohorta.operators.joins import interval_join
from cohorta.operators.rows import keep_smallest_with_ties
from cohorta.operators.scans import (
    GROUP_LIMIT,
    LONE,
    HotGroups,
    hot_groups,
    last_known,
    lone_nulls,
    ordered_scans,
    previous_value,
    running_sum,
    seen,
    upcoming,
)


def sessionize(events: DataFrame, key: str, time: str, gap_seconds: int, tie: Sequence[str] = (), *, group_limit: int = GROUP_LIMIT, hot: HotGroups | None = None) -> DataFrame:
    """Add ``session_start`` and ``session_id``; a session ends after a silence longer
    than the gap. The id is the key and the session's first instant, null for a null key."""
    hot = hot or hot_groups(events, [key], group_limit)

    def begin_of_session(rows):
        silence = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
        new = F.col("_before").isNull() | (silence > F.lit(gap_seconds * 1_000_000))
        marked = rows.withColumn("_begin", F.when(new, F.col(time))).drop("_before")
        return marked, {"session_start": last_known("_begin")}

    out = ordered_scans(events, [key], [time, *tie], {"_before": previous_value(time)}, hot=hot, then=begin_of_session)
    session_id = F.concat(F.col(key).cast("string"), F.lit("-"), F.unix_micros(F.col("session_start").cast("timestamp")).cast("string"))
    return out.drop("_begin").withColumn("session_id", session_id)


def funnel_rows(
    events: DataFrame,
    session: Sequence[str],
    time: str,
    steps: Sequence[tuple[str, Column]],
    dims: Sequence[str] = (),
    anchor: str = "previous",
    strict: bool = False,
    *,
    coarse: Sequence[str] = (),
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Events that take part in a funnel: first-step events and those later-step events
    that follow the step before (``anchor='previous'``) or the first step
    (``anchor='first'``) in their session, once for each first-step value of ``dims``
    they follow. ``_step`` numbers the steps from 0.

    "Not earlier than some event of the step before" needs no join: in time order it
    means that such an event has been seen, so one sort per session answers every step.
    ``dims`` are for columns with few values (variant, country, platform); one with many,
    such as the store, belongs in the session key.
    With ``strict`` an event at the same instant does not count. ``coarse`` names a part
    of the session key on which group sizes are cheaper to measure.
    """
    outer = [d for d in dims if d not in session]
    numbers = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(steps)]))
    rows = events.select(*session, *outer, time, F.explode(numbers).alias("_step"))
    # Steps of one instant: earlier steps first, unless they must not count.
    rows = rows.withColumn("_turn", -F.col("_step") if strict else F.col("_step"))
    rows = rows.withColumn("_dims", F.when(F.col("_step") == 0, F.struct(F.lit(True).alias("_first"), *outer)))
    # A null session key goes with no other event, not even with another null one.
    rows = lone_nulls(rows, session)
    group = [*session, LONE]
    hot = hot or hot_groups(rows, group, group_limit, coarse)
    rows = ordered_scans(rows, group, [time, "_turn"], {"_seen": seen("_dims")}, hot=hot)
    own = F.when(F.col("_step") == 0, F.array("_dims")).otherwise(F.col("_seen"))
    rows = rows.select(*group, time, "_step", "_turn", F.explode(own).alias("_d"))
    rows = rows.select(*group, time, "_step", "_turn", *[F.col(f"_d.{c}").alias(c) for c in outer])
    if anchor == "previous":
        for step in range(1, len(steps) - 1):
            rows = rows.withColumn("_hit", F.when(F.col("_step") == step, F.lit(True)))
            rows = ordered_scans(rows, [*group, *outer], [time, "_turn"], {"_done": last_known("_hit")}, hot=hot)
            # Rows of the next step stay only behind a row of this one.
            rows = rows.where((F.col("_step") != step + 1) | F.col("_done").isNotNull()).drop("_hit", "_done")
    return rows.drop("_turn", LONE)


def session_funnel(events, session, time, steps, dims=(), anchor="previous", strict=False, **options) -> DataFrame:
    """One row per session and first-step ``dims`` with ``t_<step>``: when it first reached
    each step in order, null if it did not. Arguments as for ``funnel_rows``."""
    rows = funnel_rows(events, session, time, steps, dims, anchor, strict, **options)
    outer = [d for d in dims if d not in session]
    return rows.groupBy(*session, *outer).agg(
        *[F.min(F.when(F.col("_step") == i, F.col(time))).alias(f"t_{name}") for i, (name, _) in enumerate(steps)]
    )


def funnel_events(events, session, time, steps, dims=(), anchor="previous", strict=False, **options) -> DataFrame:
    """Per first-step ``dims``, the number of events of each step in the funnel. Input has
    one row per event. Arguments as for ``funnel_rows``."""
    rows = funnel_rows(events, session, time, steps, dims, anchor, strict, **options)
    return rows.groupBy(*dims).agg(*[F.count_if(F.col("_step") == i).alias(f"n_{name}") for i, (name, _) in enumerate(steps)])


def funnel_counts(reached: DataFrame, session: str, steps: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Distinct known sessions per step. Sessions are made unique per group first, with a
    flag per step, so any number of steps costs one distinct."""
    flags = reached.groupBy(*by, session).agg(*[F.max(F.col(f"t_{s}").isNotNull()).alias(f"_{s}") for s in steps])
    return flags.groupBy(*by).agg(*[F.count_if(F.col(f"_{s}") & F.col(session).isNotNull()).alias(f"n_{s}") for s in steps])


def mark_starts(events: DataFrame, start: Column, follow: Column) -> DataFrame:
    """Rows that are starts (``_kind`` 0) or follow-ups (1); a row that is both comes twice."""
    kinds = F.array_compact(F.array(F.when(start, F.lit(0)), F.when(follow, F.lit(1))))
    return events.withColumn("_kind", F.explode(kinds))


def with_next_times(marked: DataFrame, keys: Sequence[str], time: str, picks: dict[str, Column], **options) -> DataFrame:
    """Add, per pick, the time of the first follow-up at or after each row that meets the
    pick's condition; null when there is none. All picks share one sort per key, and no
    start is paired with more than the one follow-up it needs."""
    rows = marked.withColumns({f"_at_{n}": F.when((F.col("_kind") == 1) & c, F.col(time)) for n, c in picks.items()})
    found = ordered_scans(rows, keys, [time, "_kind"], {n: upcoming(f"_at_{n}") for n in picks}, match_nulls=False, **options)
    return found.drop(*[f"_at_{n}" for n in picks])


def next_within(
    starts: DataFrame,
    follows: DataFrame,
    keys: Sequence[str],
    start_time: str,
    follow_time: str,
    seconds: int | None = None,
    name: str = "followed_at",
    *,
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """First follow-up, from another table, at or after each start, within a time limit
    if one is given."""
    s = starts.withColumn("_t", F.col(start_time)).withColumn("_kind", F.lit(0))
    f = follows.select(*keys, F.col(follow_time).alias("_t"), F.lit(1).alias("_kind"))
    probe = starts.select(*keys).unionByName(follows.select(*keys))
    both = s.unionByName(f, allowMissingColumns=True)
    found = with_next_times(both, keys, "_t", {name: F.lit(True)}, probe=probe, group_limit=group_limit, hot=hot)
    found = found.where("_kind = 0").select(*starts.columns, name)
    if seconds is None:
        return found
    ok = F.col(name) <= F.col(start_time) + F.expr(f"interval {int(seconds)} seconds")
    return found.withColumn(name, F.when(ok, F.col(name)))


def conversion_within(
    events: DataFrame,
    start: Column,
    follow: Column,
    keys: Sequence[str],
    time: str,
    seconds: int,
    session: str,
    by: Sequence[str],
    *,
    coarse: Sequence[str] = (),
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Distinct sessions with a start, and those followed up in time, per ``by``."""
    marked = mark_starts(events, start, follow)
    hot = hot or hot_groups(marked, keys, group_limit, coarse)
    found = with_next_times(marked, keys, time, {"_next": F.lit(True)}, hot=hot).where("_kind = 0")
    in_time = F.col("_next") <= F.col(time) + F.expr(f"interval {int(seconds)} seconds")
    reached = found.withColumn("t_started", F.col(time)).withColumn("t_converted", F.when(in_time, F.col("_next")))
    return funnel_counts(reached, session, ["started", "converted"], by)


def nearest_follow_up(
    touches: DataFrame,
    accesses: DataFrame,
    customer: str,
    session: str,
    touch_time: str,
    access_time: str,
    fields: Sequence[str],
    seconds: int,
    *,
    group_limit: int = GROUP_LIMIT,
    hot: HotGroups | None = None,
) -> DataFrame:
    """First touch of each session and the access of that customer closest after it,
    at most ``seconds`` whole seconds later. Accesses in the same whole second as
    the closest one are all kept; touches without an access stay, with nulls."""
    per_customer = touches.groupBy(session, customer).agg(F.min(touch_time).alias(touch_time))
    first = keep_smallest_with_ties(per_customer, [session], touch_time)
    closest = next_within(
        first, accesses, [customer], touch_time, access_time, None, "_closest", group_limit=group_limit, hot=hot
    ).withColumn("delta_seconds", seconds_between(touch_time, "_closest"))
    closest = closest.withColumn("delta_seconds", F.when(F.col("delta_seconds") <= seconds, F.col("delta_seconds")))
    # Ties lie at most one second after the closest access.
    right = accesses.select(customer, F.col(access_time).alias("_access"), F.col(session).alias("_access_session"), *fields)
    pairs = interval_join(closest.where(F.col("delta_seconds").isNotNull()), right, [customer], "_closest", "_access", 1)
    pairs = pairs.where(seconds_between(touch_time, "_access") == F.col("delta_seconds"))
    same = F.when(F.col(session) == F.col("_access_session"), 1).otherwise(0).alias("is_same_session")
    found = pairs.select(session, customer, *fields, "delta_seconds", same)
    alone = closest.where(F.col("delta_seconds").isNull()).select(session, customer)
    return found.unionByName(alone, allowMissingColumns=True)


def follow_up_counts(
    starts: DataFrame,
    follows: DataFrame,
    keys: Sequence[str],
    time: str,
    bounds: Sequence[int],
    *,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """How many (start, follow-up) pairs lie in each gap bucket, without making pairs.

    ``bounds`` are rising whole seconds; a bucket holds gaps of more than its lower and at
    most its upper bound, counted in whole seconds elapsed (-1 is the bound before "at
    once"). Each start asks, once per bound, how many follow-ups come before that gap is
    exceeded; the difference of two answers is the number between.
    """
    asks = starts.select(*keys, F.explode(F.array(*[F.lit(b) for b in bounds])).alias("_bound"), time)
    exceeded = (F.col("_bound").cast("long") + 1) * 1_000_000
    asks = asks.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")) + exceeded)
    asks = asks.select(*keys, "_bound", "_t", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_one"))
    rows = follows.select(
        *keys, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.lit(1).alias("_kind"), F.lit(1).cast("long").alias("_one")
    )
    probe = starts.select(*keys).unionByName(follows.select(*keys))
    both = asks.unionByName(rows, allowMissingColumns=True)
    seen = ordered_scans(both, keys, ["_t", "_kind"], {"_seen": running_sum("_one")}, group_limit=group_limit, probe=probe, match_nulls=False)
    totals = seen.where("_kind = 0").agg(
        *[F.coalesce(F.sum(F.when(F.col("_bound") == b, F.col("_seen"))), F.lit(0)).alias(f"b{b}") for b in bounds]
    )
    buckets = [
        F.struct(F.lit(lo).alias("gap_from"), F.lit(hi).alias("gap_to"), (F.col(f"b{hi}") - F.col(f"b{lo}")).alias("n_pairs"))
        for lo, hi in zip(bounds, bounds[1:])
    ]
    return totals.select(F.inline(F.array(*buckets)))


def session_timeline(events: DataFrame, session: str, wanted: Column, time: str, columns: Sequence[str]) -> DataFrame:
    """Events of the wanted sessions in time order."""
    return events.where(wanted).select(session, time, *columns).orderBy(session, time, *columns)
