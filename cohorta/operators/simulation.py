"""Thousands of repeated random splits in one pass.

A digest of a unit's key is 128 fair coins, so it places the unit in 128 even splits at once. Per
batch of units the coins are a matrix of 0 and 1, and counts, sums and sums of squares of all
splits are one matrix product with it; no row is copied. A task hands on one row per split.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import col, safe_ratio
from cohorta.operators.inference import welch_from_moments

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COINS = 128
#: Coins that are unpacked at once, rows times splits.
CELLS = 20_000_000


def coins(keys: list[str], salt: str, n: int) -> np.ndarray:
    """One row of n coins per key: the bits, first to last, of md5(salt + number + "-" + key) for the numbers from 0 on."""
    digests = -(-n // COINS)
    marks = [f"{salt}{h}-".encode() for h in range(digests)]
    raw = b"".join(hashlib.md5(mark + key.encode()).digest() for key in keys for mark in marks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(keys), 16 * digests), axis=1, count=n)


def _partial(salt: str, n: int, shift: float):
    def run(batches):
        totals = np.zeros((3, n + 1))
        for batch in batches:
            values, keys = batch.column(1).to_numpy(zero_copy_only=False) - shift, batch.column(0).to_pylist()
            rows = np.vstack((np.ones(len(values)), values, values * values))
            step = max(1, CELLS // max(n, 1))
            for at in range(0, len(keys), step):
                totals[:, :n] += rows[:, at : at + step] @ coins(keys[at : at + step], salt, n)
            totals[:, n] += rows.sum(1)
        if totals[0, n]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), *(pa.array(t) for t in totals)], names=["split", "n", "s", "q"])

    return run


def split_tests(df: DataFrame, unit: str | Column, value: str | Column, n_splits: int, salt: str) -> DataFrame:
    """Welch test of ``value`` between the two halves of each of ``n_splits`` random splits of the
    units: one row per split, with the columns of ``two_sample``. A unit's half is coin number
    split % 128 of its digest number split // 128: 0 is control, 1 is variant. Rows are one per unit;
    null values are left out."""
    u = df.select(col(unit).cast("string").alias("unit"), col(value).cast("double").alias("value")).dropna()
    # Sums of squares are taken around the mean, or a large mean would drown them.
    shift = u.agg(F.avg("value")).first()[0] or 0.0
    sums = u.mapInArrow(_partial(salt, n_splits, shift), "split long, n double, s double, q double").groupBy("split").agg(*[F.sum(c).alias(c) for c in "nsq"])
    whole = sums.where(F.col("split") == n_splits).select(F.struct("n", "s", "q"))
    per = sums.where(F.col("split") < n_splits).withColumn("all", whole.scalar())
    out = per.select("split", *[m.alias(name) for name, m in _halves(shift).items()])
    return welch_from_moments(out.where("n_control > 0 and n_variant > 0"))


def _halves(shift: float) -> dict[str, Column]:
    out = {}
    for side in ("control", "variant"):
        n, s, q = (F.col(c) if side == "variant" else F.col(f"all.{c}") - F.col(c) for c in "nsq")
        out |= {
            f"n_{side}": n.cast("long"), f"mean_{side}": safe_ratio(s, n) + F.lit(shift),
            f"var_{side}": F.greatest(safe_ratio(q - safe_ratio(s * s, n), n - 1), F.lit(0.0)),
        }
    return out


#: Splits that one digest places a unit in when the shares are not even: 16 bits each.
SHARES = 8


def draws(keys: list[str], salt: str, n: int) -> np.ndarray:
    """One row of n numbers below 65,536 per key: the 16-bit parts of md5(salt + number + "-" + key) for the numbers from 0 on."""
    digests = -(-n // SHARES)
    marks = [f"{salt}{h}-".encode() for h in range(digests)]
    raw = b"".join(hashlib.md5(mark + key.encode()).digest() for key in keys for mark in marks)
    return np.frombuffer(raw, ">u2").reshape(len(keys), SHARES * digests)[:, :n]


def _partial_sums(salt: str, n: int, limit: int, metrics: int):
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            units, where = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            treated = (draws(units.tolist(), salt, n) < limit).astype(float)
            days = batch.column(1).to_numpy(zero_copy_only=False)
            values = [batch.column(2 + m).to_numpy(zero_copy_only=False).astype(float) for m in range(metrics)]
            for day in np.unique(days):
                own = np.flatnonzero(days == day)
                rows = [x for v in values for x in (~np.isnan(v[own]), np.nan_to_num(v[own]))]
                part = np.vstack(rows).astype(float)
                both = np.hstack((part @ treated[where[own]], part.sum(1, keepdims=True)))
                totals[int(day)] = totals.get(int(day), 0.0) + both
        for day, both in totals.items():
            columns = [pa.array(both[k, :n]) for k in range(2 * metrics)] + [pa.array(np.full(n, both[k, n])) for k in range(2 * metrics)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, day, np.int32)), *columns], names=_names(metrics))

    return run


def _names(metrics: int) -> list[str]:
    return ["split", "_day", *[f"{c}{m}_{side}" for side in ("t", "a") for m in range(metrics) for c in "ns"]]


def split_sums(df: DataFrame, unit: str, day: str, metrics: list[str], n_splits: int, treat_share: float, salt: str) -> DataFrame:
    """Sums of each metric over treated and other units per split and day, for ``n_splits`` random splits at once: split,
    day, and t_<metric>, c_<metric> (null where a side has no known value that day). A unit is
    treated in a split if its draw is below ``treat_share`` of 65,536. No row is copied: a task hands on one row per split and day."""
    rows = df.where(F.col(unit).isNotNull() & F.col(day).isNotNull())
    rows = rows.select(F.col(unit).cast("string").alias("unit"), F.unix_date(day).alias("_day"), *[F.col(m).cast("double").alias(m) for m in metrics])
    k = len(metrics)
    schema = "split long, _day int, " + ", ".join(f"{c} double" for c in _names(k)[2:])
    sums = rows.mapInArrow(_partial_sums(salt, n_splits, round(treat_share * 65_536), k), schema).groupBy("split", "_day").agg(*[F.sum(c).alias(c) for c in _names(k)[2:]])
    out = [F.col("split"), F.date_from_unix_date("_day").alias(day)]
    for i, m in enumerate(metrics):
        out.append(F.when(F.col(f"n{i}_t") > 0, F.col(f"s{i}_t")).alias(f"t_{m}"))
        out.append(F.when(F.col(f"n{i}_a") > F.col(f"n{i}_t"), F.col(f"s{i}_a") - F.col(f"s{i}_t")).alias(f"c_{m}"))
    return sums.select(*out)
