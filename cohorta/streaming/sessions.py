"""Sessions and funnels over an unbounded stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_funnels(events: DataFrame, key: str, time: str, gap_seconds: int, steps: Sequence[tuple[str, Column]], late_seconds: int) -> DataFrame:
    """One row per finished session: key, session_start, last_event, n_events, and ``t_<step>``, when it first
    reached each step in order (null if it did not), as ``session_funnel`` with a previous step's anchor.

    Rows may come up to ``late_seconds`` behind the latest seen; later ones are dropped. A
    session is put out, once, when no row within the lateness can still reach it: ``gap_seconds`` after its last
    event and ``late_seconds`` more. Its state then goes. The state of a session is its count and the times of
    its step events. Rows with an unknown key or time take no part.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{late_seconds} seconds")
    # A silence of exactly the gap does not end a session.
    window = F.session_window(time, f"{gap_seconds} seconds 1 microsecond")
    times = [F.collect_set(F.when(c, F.col(time))).alias(f"_{name}") for name, c in steps]
    s = rows.groupBy(key, window.alias("_w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(time).alias("last_event"), *times)
    reached: list[Column] = []
    for name, _ in steps:
        reached.append(F.array_min(_not_before(F.col(f"_{name}"), reached[-1]) if reached else F.col(f"_{name}")))
    return s.select(key, F.col("_w.start").alias("session_start"), "last_event", "n_events", *[t.alias(f"t_{name}") for (name, _), t in zip(steps, reached)])


def _not_before(times: Column, first: Column) -> Column:
    return F.when(first.isNotNull(), F.filter(times, lambda t: t >= first))
