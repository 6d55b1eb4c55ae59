"""Joins of two streams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, seconds: int, late_seconds: int) -> DataFrame:
    """All pairs of two streams with equal keys and ``left_time <= right_time <= left_time + seconds``.

    Rows of either stream may come up to ``late_seconds`` behind the latest seen. The interval and the
    watermarks tell when a row can meet no more: a left row's state goes ``seconds`` after it, a
    right row's at once (both after the lateness). The frames share no column names but the keys.
    """
    a = left.withWatermark(left_time, f"{late_seconds} seconds")
    b = right.withWatermark(right_time, f"{late_seconds} seconds")
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys])
    inside = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {int(seconds)} seconds"))
    return a.join(b, same & inside).drop(*[f"_{k}" for k in keys])
