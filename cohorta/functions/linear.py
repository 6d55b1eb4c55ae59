"""Small linear systems and the local-level filter, for aggregated rows only.

One row is a whole model here: sums that Spark has made, or one series as long as the
period. Nothing in this module sees the rows behind the sums.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

# Executors need not have this package: the functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Share of a column's own variation that the columns before it must leave unexplained.
ALIAS = 1e-10
#: Ratios of level to observation variance that the likelihood is compared at.
RATIOS = (0.0, *(10.0 ** (k / 2) for k in range(-8, 5)))


def solve_gram(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and inverse of a matrix of sums of products. A column that those before it
    explain (or that never varies) gets NaN; so does everything else of it."""
    k = len(right)
    size = np.sqrt(np.diag(gram))
    scaled = np.divide(gram, np.outer(size, size), out=np.zeros_like(gram, dtype=float), where=np.outer(size, size) > 0)
    kept: list[int] = []
    for j in range(k):
        left = scaled[j, j]
        if kept:
            part = scaled[np.ix_(kept, kept)]
            left -= scaled[j, kept] @ np.linalg.solve(part, scaled[kept, j])
        if left > ALIAS:
            kept.append(j)
    solution, inverse = np.full(k, math.nan), np.full((k, k), math.nan)
    if kept:
        at = np.ix_(kept, kept)
        inverse[at] = np.linalg.inv(scaled[at]) / np.outer(size[kept], size[kept])
        solution[kept] = inverse[at] @ right[kept]
    return solution, inverse


# Types, not text: text is read by a session, and there may be none when this is imported.
@F.pandas_udf(StructType().add("beta", ArrayType(DoubleType())).add("inverse", ArrayType(DoubleType())))
def solve_rows(gram: pd.Series, right: pd.Series) -> pd.DataFrame:
    """``solve_gram`` per row; the matrix comes and goes row after row. Columns left out have coefficient and entries 0."""
    out = []
    for g, r in zip(gram, right):
        r = np.asarray(r, float)
        g = np.asarray(g, float).reshape(len(r), len(r))
        if np.isfinite(g).all() and np.isfinite(r).all():
            beta, inverse = solve_gram(g, r)
            out.append((np.nan_to_num(beta).tolist(), np.nan_to_num(inverse).ravel().tolist()))
        else:
            out.append((None, None))
    return pd.DataFrame(out, columns=["beta", "inverse"])


def local_level(y: np.ndarray, x: np.ndarray, known: np.ndarray, ratio: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Filter of y = level + x'b + noise, level a random walk, with ``ratio`` the variance of the
    level's steps in units of the noise's. Starts without any knowledge of level and b.

    Returns log-likelihood (noise variance at its best), that variance, and mean and
    covariance (in its units) of level and b after the last known value.
    """
    p = x.shape[1]
    state, cov = np.zeros(1 + p), np.zeros((1 + p, 1 + p))
    # What is not known yet: directions of the state that no value has fixed.
    free = np.eye(1 + p)
    squares = logs = 0.0
    n = 0
    for t in range(len(y)):
        if t:
            cov[0, 0] += ratio
        if not known[t]:
            continue
        z = np.concatenate(([1.0], x[t]))
        along = free @ z
        spread = cov @ z
        f = z @ spread + 1.0
        error = y[t] - z @ state
        unknown = along @ along
        if len(free) and unknown > 1e-12 * (z @ z):
            # The value fixes one direction; it says nothing about the variances.
            gain = free.T @ along / unknown
            state = state + gain * error
            cov = cov - np.outer(gain, spread) - np.outer(spread, gain) + np.outer(gain, gain) * f
            u = along / math.sqrt(unknown)
            rest = np.linalg.qr(np.column_stack((u, np.eye(len(free)))))[0][:, 1 : len(free)].T
            free = rest @ free
        else:
            state = state + spread * error / f
            cov = cov - np.outer(spread, spread) / f
            squares += error * error / f
            logs += math.log(f)
            n += 1
    noise = squares / n if n else math.nan
    likelihood = -0.5 * (n * math.log(noise) + logs) if n and noise > 0 else math.inf if n else math.nan
    return likelihood, noise, state, cov


def best_ratio(y, x, known, ratios=RATIOS, refine: bool = True) -> float:
    """Ratio of the greatest likelihood: among ``ratios``, then between the best one's neighbours."""
    found = [local_level(y, x, known, r)[0] for r in ratios]
    if not np.isfinite(found).any():
        return ratios[0]
    k = int(np.nanargmax(found))
    if not refine or ratios[k] == 0:
        return ratios[k]
    low = math.log(ratios[k - 1]) if k and ratios[k - 1] > 0 else math.log(ratios[k]) - 2
    high = math.log(ratios[k + 1]) if k + 1 < len(ratios) else math.log(ratios[k]) + 2
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if local_level(y, x, known, math.exp(a))[0] >= local_level(y, x, known, math.exp(b))[0]:
            high = b
        else:
            low = a
    return math.exp((low + high) / 2)


LEVEL = "predicted array<double>, error array<double>, cumulative_error array<double>, noise_variance double, level_ratio double"


def local_level_rows(ratios=RATIOS, refine: bool = True):
    """Column function over one series per row: values, controls one after the other, and 1 for
    days before the cut. Days are in order; a value that is not a number is not known."""

    def one(y, x, pre):
        y, pre = np.asarray(y, float), np.asarray(pre, float) > 0
        x = np.asarray(x, float).reshape(len(y), len(x) // max(1, len(y)))
        usable = np.isfinite(x).all(1)
        x = np.where(usable[:, None], x, 0.0)
        last = int(np.flatnonzero(pre)[-1]) + 1 if pre.any() else 0
        # Controls are moved to the mean of the days before the cut and to unit size, for the arithmetic only.
        shift = x[:last].mean(0) if last else np.zeros(x.shape[1])
        size = x[:last].std(0) if last else np.ones(x.shape[1])
        x = (x - shift) / np.where(size > 0, size, 1.0)
        known = pre & np.isfinite(y) & usable
        ratio = best_ratio(y[:last], x[:last], known[:last], ratios, refine)
        _, noise, state, cov = local_level(y[:last], x[:last], known[:last], ratio)
        none = [None] * len(y)
        if not math.isfinite(noise):
            return none, none, none, None, None
        predicted, error, total = list(none), list(none), list(none)
        sums = np.zeros(1 + x.shape[1])
        for h, t in enumerate(range(last, len(y)), start=1):
            z = np.concatenate(([1.0], x[t]))
            sums = sums + z
            predicted[t] = float(z @ state) if usable[t] else None
            error[t] = math.sqrt(noise * (z @ cov @ z + h * ratio + 1.0))
            total[t] = math.sqrt(noise * (sums @ cov @ sums + ratio * h * (h + 1) * (2 * h + 1) / 6 + h))
        return predicted, error, total, noise, ratio

    @F.pandas_udf(LEVEL)  # made with the query, so there is a session to read the text
    def run(y: pd.Series, x: pd.Series, pre: pd.Series) -> pd.DataFrame:
        rows = [one(*series) for series in zip(y, x, pre)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LEVEL.split(", ")])

    return run
