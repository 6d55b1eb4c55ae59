"""Poisson regression by Newton's method: every round is one aggregation in Spark.

The rows' part in a round are sums: X'WX, X'(y - mu) and the log-likelihood, k(k+1)/2 + k + 1
numbers for k terms. The driver solves the k equations and names the next coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import col
from cohorta.functions.distributions import normal_quantile
from cohorta.functions.linear import solve_gram
from cohorta.session import ensure_checkpoint_dir

INTERCEPT = "intercept"
RESULT = "term string, coefficient double, standard_error double, z_statistic double, p_value double, lower double, upper double, rounds int, converged boolean"
#: Beyond it the exponential of a linear predictor is not taken; no sensible mean is there.
FAR = 500.0


@dataclass(frozen=True)
class Term:
    name: str
    value: Column


def numeric(name: str, value: str | Column | None = None) -> list[Term]:
    return [Term(name, col(name if value is None else value).cast("double"))]


def category(df: DataFrame, column: str, base=None) -> list[Term]:
    """One 0/1 term per level but the first in order (or ``base``). Levels are read from the data;
    each is a coefficient, so a column with many levels does not belong here."""
    levels = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    first = levels[0] if base is None and levels else base
    return [Term(f"{column}[{v}]", (F.col(column) == F.lit(v)).cast("double")) for v in levels if v != first]


def interaction(left: Sequence[Term], right: Sequence[Term]) -> list[Term]:
    return [Term(f"{a.name}:{b.name}", a.value * b.value) for a in left for b in right]


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'(y - mu) and the log-likelihood (up to what does not depend on the coefficients)."""
    k = len(beta)
    eta = reduce(lambda a, b: a + b, [F.col(f"x{i}") * F.lit(float(beta[i])) for i in range(k)])
    r = rows.withColumn("eta", F.least(F.greatest(eta, F.lit(-FAR)), F.lit(FAR))).withColumn("mu", F.col("n") * F.exp("eta"))
    r = r.withColumns({f"w{i}": F.col("mu") * F.col(f"x{i}") for i in range(k)})
    places = [(i, j) for i in range(k) for j in range(i, k)]
    made = [F.sum(F.col(f"w{i}") * F.col(f"x{j}")) for i, j in places]
    made += [F.sum((F.col("y") - F.col("mu")) * F.col(f"x{i}")) for i in range(k)]
    made += [F.sum(F.col("y") * F.col("eta") - F.col("mu"))]
    got = [0.0 if v is None else float(v) for v in r.agg(*[m.alias(f"s{i}") for i, m in enumerate(made)]).first()]
    gram = np.zeros((k, k))
    for (i, j), v in zip(places, got):
        gram[i, j] = gram[j, i] = v
    return gram, np.array(got[len(places) : -1]), got[-1]


def poisson_regression(
    df: DataFrame, y: str | Column, terms: Sequence[Term], confidence: float = 0.95, collapse: bool = False, tolerance: float = 1e-9, rounds: int = 50
) -> DataFrame:
    """Coefficients of log(mean of y) = intercept + terms: one row per term with standard error,
    z, p and interval (normal), the rounds taken and whether they converged.

    Rows with a null or NaN in y or a term are left out. A term that the ones before it explain has null
    figures. A level without any event has no finite coefficient: the rounds then end without
    converging. With ``collapse`` rows of equal terms become one first, which is right for any
    terms and pays for categories. No rows, no result.
    """
    spark = df.sparkSession
    names = [INTERCEPT, *(t.name for t in terms)]
    k = len(names)
    values = [F.lit(1.0), *(t.value.cast("double") for t in terms)]
    rows = df.select(col(y).cast("double").alias("y"), F.lit(1.0).alias("n"), *[v.alias(f"x{i}") for i, v in enumerate(values)]).dropna()
    if collapse:
        rows = rows.groupBy(*[f"x{i}" for i in range(k)]).agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    ensure_checkpoint_dir(spark)
    rows = rows.checkpoint()  # narrow, and read once per round

    total, n = rows.agg(F.sum("y"), F.sum("n")).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    beta = np.zeros(k)
    beta[0] = math.log(max(total, 0.5) / n)
    gram, score, likelihood = _sums(rows, beta)
    converged, taken = False, 0
    while taken < rounds and not converged:
        taken += 1
        step = np.nan_to_num(solve_gram(gram, score)[0])
        converged = bool((np.abs(step) <= tolerance * (1 + np.abs(beta))).all())
        for _ in range(30):  # shorter steps where a full one leads downhill
            new = _sums(rows, beta + step)
            if new[2] >= likelihood - 1e-9 * abs(likelihood):
                break
            step = step / 2
        beta, (gram, score, likelihood) = beta + step, new
    inverse = solve_gram(gram, score)[1]
    wide = normal_quantile(0.5 + confidence / 2)
    out = []
    for i, name in enumerate(names):
        error = math.sqrt(inverse[i, i]) if inverse[i, i] > 0 else None
        if error is None:
            out.append((name, None, None, None, None, None, None, taken, converged))
            continue
        b = float(beta[i])
        out.append((name, b, error, b / error, math.erfc(abs(b / error) / math.sqrt(2)), b - wide * error, b + wide * error, taken, converged))
    return spark.createDataFrame(out, RESULT)
