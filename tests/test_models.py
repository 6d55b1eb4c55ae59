"""Regression, counterfactuals, clustered effects, repeated splits, exact power, stored forms."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.functions import distributions as P
from cohorta.functions import linear
from cohorta.operators import clusters, distinct, effects, history, inference, regression, simulation
from cohorta.operators import spine as S
from cohorta.plans import QUERIES
from cohorta.plans.lake import DAILY, store_events
from cohorta.sources import tables


# -- Poisson regression -------------------------------------------------------

def plain_poisson(x, y):
    """Newton's method on all rows at once."""
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.mean())
    for _ in range(100):
        mu = np.exp(x @ b)
        b = b + np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
    mu = np.exp(x @ b)
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * mu[:, None]))))


@pytest.fixture(scope="module")
def visits(spark):
    rng = np.random.default_rng(6)
    n = 900
    prime, treated, city, tenure = rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 3, n), rng.gamma(2, 8, n)
    y = rng.poisson(np.exp(0.2 + 0.3 * prime + 0.1 * treated - 0.2 * (city == 2) + 0.15 * treated * prime + 0.08 * np.sqrt(tenure)))
    rows = [(int(a), int(b), "abc"[c], float(t), int(v)) for a, b, c, t, v in zip(prime, treated, city, tenure, y)]
    frame = spark.createDataFrame(rows + [(None, 1, "a", 1.0, 3), (1, 1, None, 1.0, 2), (1, 1, "a", float("nan"), 2), (0, 0, "a", 4.0, None)], "prime int, treated int, city string, tenure double, y int")
    x = np.column_stack((np.ones(n), treated, prime, treated * prime, city == 1, city == 2, np.sqrt(tenure))).astype(float)
    return frame, x, y.astype(float)


def terms(frame):
    treated, prime = regression.numeric("treated"), regression.numeric("prime")
    return treated + prime + regression.interaction(treated, prime) + regression.category(frame, "city") + regression.numeric("tenure", F.sqrt("tenure"))


@pytest.mark.parametrize("collapse", [False, True])
def test_poisson_matches_newton(visits, collapse):
    frame, x, y = visits
    got = regression.poisson_regression(frame, "y", terms(frame), collapse=collapse).collect()
    b, se = plain_poisson(x, y)
    assert [r.term for r in got] == ["intercept", "treated", "prime", "treated:prime", "city[b]", "city[c]", "tenure"]
    assert np.allclose([r.coefficient for r in got], b, atol=1e-8) and np.allclose([r.standard_error for r in got], se, atol=1e-8)
    assert all(r.converged for r in got) and all(r.lower < r.coefficient < r.upper for r in got)


def test_poisson_odd_designs(spark, visits):
    frame, x, y = visits
    twice = regression.numeric("treated") + regression.numeric("again", F.col("treated") * 2 + 1) + regression.numeric("prime")
    got = {r.term: r for r in regression.poisson_regression(frame, "y", twice).collect()}
    assert got["again"].coefficient is None and got["again"].standard_error is None
    b, _ = plain_poisson(x[:, [0, 1, 2]], y)
    rest = regression.poisson_regression(frame.where("tenure is not null and not isnan(tenure) and city is not null"), "y", twice).collect()
    assert np.allclose([r.coefficient for r in rest if r.term != "again"], b, atol=1e-8)
    none = spark.createDataFrame([("a", 0), ("a", 0), ("b", 3), ("b", 4)], "g string, y int")
    apart = {r.term: r for r in regression.poisson_regression(none, "y", regression.category(none, "g", "b"), rounds=12).collect()}
    assert not apart["g[a]"].converged and apart["g[a]"].coefficient < -5
    assert math.isclose(apart["intercept"].coefficient, math.log(3.5), abs_tol=1e-6)
    assert regression.poisson_regression(none.limit(0), "y", []).collect() == []
    big = spark.createDataFrame([(float(i), int(math.exp(i / 100))) for i in range(1500)], "x double, y long")
    assert all(r.converged for r in regression.poisson_regression(big, "y", regression.numeric("x")).collect())


# -- counterfactuals ----------------------------------------------------------

def series(spark, n=60, cut=45, seed=3, keys=("k1", "k2")):
    rng = np.random.default_rng(seed)
    rows, arrays = [], {}
    for k in keys:
        x = rng.normal(100, 10, (n, 3))
        y = 5 + x @ [0.5, -0.3, 0.2] + np.cumsum(rng.normal(0, 0.5, n)) + rng.normal(0, 1, n)
        arrays[k] = x, y
        rows += [(k, t, *map(float, x[t]), float(y[t])) for t in range(n)]
    return spark.createDataFrame(rows, "k string, day int, a double, b double, c double, y double"), arrays, n, cut


def test_several_controls_match_least_squares(spark):
    frame, arrays, n, cut = series(spark)
    frame = frame.withColumn("same", F.col("a") + F.col("b"))  # explained by the two before it
    out = effects.counterfactual_with_controls(frame, ["k"], "day", "y", ["a", "b", "same", "c"], F.col("day") < cut, F.col("day") >= cut)
    rows = {(r.k, r.day): r for r in out.collect()}
    for k, (x, y) in arrays.items():
        design = np.column_stack((np.ones(n), x))
        beta, *_ = np.linalg.lstsq(design[:cut], y[:cut], rcond=None)
        left = y[:cut] - design[:cut] @ beta
        inverse = np.linalg.inv(design[:cut].T @ design[:cut])
        noise = left @ left / (cut - 5)  # the explained control still counts among the coefficients
        g = np.cumsum(design[cut:], 0)
        for i in range(n - cut):
            r = rows[k, cut + i]
            assert math.isclose(r.predicted, design[cut + i] @ beta, rel_tol=1e-8)
            assert math.isclose(r.standard_error, math.sqrt(noise * (i + 1 + g[i] @ inverse @ g[i])), rel_tol=1e-6)
    one = effects.counterfactual_with_controls(frame.where("k = 'k1'"), [], "day", "y", ["a", "b", "c"], F.col("day") < cut, F.col("day") >= cut)
    assert one.count() == n - cut
    short = effects.counterfactual_with_controls(frame.where("day >= 42"), ["k"], "day", "y", ["a", "b", "c"], F.col("day") < cut, F.col("day") >= cut)
    assert all(r.standard_error is None and r.p_value is None for r in short.collect())


def plain_level(y, x, ratio, horizon_x):
    """Generalised least squares with the full covariance of level and noise, without a filter."""
    n, h = len(y), len(horizon_x)
    t = np.arange(n + h)
    cov = ratio * np.minimum.outer(t, t) + np.eye(n + h)
    design = np.column_stack((np.ones(n + h), np.vstack((x, horizon_x))))
    v, d = cov[:n, :n], design[:n]
    w = np.linalg.inv(v)
    a = np.linalg.inv(d.T @ w @ d)
    b = a @ d.T @ w @ y
    left = y - d @ b
    noise = left @ w @ left / (n - d.shape[1])
    likelihood = -0.5 * ((n - d.shape[1]) * math.log(noise) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(d.T @ w @ d)[1])
    gain = cov[n:, :n] @ w
    mean = design[n:] @ b + gain @ left
    rest = design[n:] - gain @ d
    spread = noise * (cov[n:, n:] - gain @ cov[:n, n:] + rest @ a @ rest.T)
    total = [math.sqrt(spread[: k + 1, : k + 1].sum()) for k in range(h)]
    return likelihood, noise, mean, np.sqrt(np.diag(spread)), total


@pytest.mark.parametrize("controls", [[], ["a"], ["a", "b", "c"]])
def test_local_level_matches_least_squares(spark, controls):
    frame, arrays, n, cut = series(spark)
    out = effects.local_level_effect(frame, ["k"], "day", "y", controls, F.col("day") < cut, F.col("day") >= cut, ratios=[0.0, 0.05, 0.5, 5.0], refine=False)
    rows = {(r.k, r.day): r for r in out.collect()}
    for k, (x, y) in arrays.items():
        x = x[:, : len(controls)]
        found = {q: plain_level(y[:cut], x[:cut], q, x[cut:]) for q in (0.0, 0.05, 0.5, 5.0)}
        best = max(found, key=lambda q: found[q][0])
        _, noise, mean, error, total = found[best]
        for i in range(n - cut):
            r = rows[k, cut + i]
            assert r.level_ratio == best
            assert np.allclose([r.noise_variance, r.predicted, r.prediction_error, r.standard_error], [noise, mean[i], error[i], total[i]], rtol=1e-6)
        errors = [rows[k, cut + i].standard_error for i in range(n - cut)]
        assert errors == sorted(errors)


def test_local_level_odd_series(spark):
    frame, arrays, n, cut = series(spark, keys=("k1",))
    pre, post = F.col("day") < cut, F.col("day") >= cut
    holes = frame.withColumn("y", F.when(~F.col("day").isin(5, 6, 30, cut + 2), F.col("y")))
    out = effects.local_level_effect(holes, ["k"], "day", "y", ["a"], pre, post).collect()
    assert len(out) == n - cut - 1 and all(r.standard_error > 0 for r in out)
    # Refining never loses likelihood against the coarse ratios.
    x, y = arrays["k1"]
    known = np.ones(cut, bool)
    best = linear.best_ratio(y[:cut], x[:cut, :1], known)
    assert linear.local_level(y[:cut], x[:cut, :1], known, best)[0] >= max(linear.local_level(y[:cut], x[:cut, :1], known, q)[0] for q in linear.RATIOS) - 1e-9
    few = effects.local_level_effect(frame.where("day >= 44"), ["k"], "day", "y", ["a", "b"], pre, post)
    assert few.collect() == [] and effects.local_level_effect(frame.limit(0), [], "day", "y", [], pre, post).collect() == []


# -- clusters -----------------------------------------------------------------

def test_clusters_across_variants(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(80):
        shared = rng.normal(0, 2)
        for _ in range(rng.integers(1, 8)):
            rows.append((c if c % 9 else None, "control" if rng.random() < 0.5 else "variant", float(10 + shared + rng.normal()), float(rng.integers(0, 2)) if rng.random() > 0.1 else None))
    rows.append((1, "other", 1e9, 1e9))
    frame = spark.createDataFrame(rows, "c int, v string, x double, z double")
    got = {r.metric: r for r in clusters.clustered_test(frame, [], ["x", "z"], "c", "v", "control", "variant").collect()}
    kept = [(c if c is not None else f"own {i}", v, x, z) for i, (c, v, x, z) in enumerate(rows) if v != "other"]
    influence = {}
    for m, column in (("x", 2), ("z", 3)):
        known = [r for r in kept if r[column] is not None]
        side = {v: np.array([r[column] for r in known if r[1] == v]) for v in ("control", "variant")}
        u = {r[0]: 0.0 for r in kept}
        for r in known:
            values = side[r[1]]
            u[r[0]] += (r[column] - values.mean()) / len(values) * (1 if r[1] == "variant" else -1)
        influence[m] = u, side
        count = len(u)
        se = math.sqrt(sum(x * x for x in u.values()) * count / (count - 1))
        assert math.isclose(got[m].standard_error, se, rel_tol=1e-9) and got[m].n_clusters == count
        assert math.isclose(got[m].difference, side["variant"].mean() - side["control"].mean(), rel_tol=1e-9)
    out = clusters.composite_effect(frame, [], {"x": 2.0, "z": -1.0}, "c", "v", "control", "variant", relative=False).first()
    both = [2 * influence["x"][0][c] - influence["z"][0][c] for c in influence["x"][0]]
    assert math.isclose(out.standard_error, math.sqrt(sum(x * x for x in both) * len(both) / (len(both) - 1)), rel_tol=1e-9)
    # With a row per cluster it is nearly Welch's error, which divides each side by n - 1 of its own.
    alone = frame.where("v <> 'other'").withColumn("own", F.monotonically_increasing_id())
    robust = clusters.clustered_test(alone, [], ["x"], "own", "v", "control", "variant").first()
    welch = inference.two_sample(alone, [], "x", "v", "control", "variant").first()
    assert math.isclose(robust.difference / robust.standard_error, -welch.t_statistic, rel_tol=0.01)
    assert clusters.clustered_test(frame.limit(0), ["c"], ["x"], "c", "v", "control", "variant").collect() == []


# -- repeated splits ----------------------------------------------------------

def test_split_tests_match_single_tests(spark):
    rng = random.Random(1)
    rows = [(i, 1e6 + rng.gauss(0, 3)) for i in range(400)] + [(900, None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "unit int, v double").repartition(7)
    got = {r.split: r for r in simulation.split_tests(frame, "unit", "v", 300, "s").collect()}
    assert sorted(got) == list(range(300))
    for split in (0, 5, 127, 128, 299):
        bit = lambda u: hashlib.md5(f"s{split // 128}-{u}".encode()).digest()[split % 128 // 8] >> (7 - split % 8) & 1
        side = [[v for u, v in rows[:400] if bit(u) == b] for b in (0, 1)]
        r = got[split]
        assert (r.n_control, r.n_variant) == (len(side[0]), len(side[1]))
        assert math.isclose(r.mean_control, np.mean(side[0]), rel_tol=1e-12) and math.isclose(r.var_variant, np.var(side[1], ddof=1), rel_tol=1e-7)
    assert simulation.split_tests(frame.limit(0), "unit", "v", 10, "s").collect() == []


def test_no_row_is_copied_per_split(spark, small):
    plan = QUERIES["false_positive_rate"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


# -- power --------------------------------------------------------------------

@pytest.mark.parametrize("n", [5, 30, 1000, 10**6, 10**9])
@pytest.mark.parametrize("shift", [0.0, 0.5, 2.8, 6.0])
def test_exact_power_matches_integral(n, shift):
    df = 2.0 * n - 2
    t = P.critical_t(0.05, df)
    assert math.isclose(P.student_t_two_sided_value(t, df), 0.05, abs_tol=1e-7)
    wide = 10 / math.sqrt(2 * df)
    u = np.linspace(max(1e-9, 1 - wide), 1 + wide, 40_001)
    log = (df - 1) * np.log(u) - df * u * u / 2
    weight = np.exp(log - log.max())
    phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    inside = np.trapezoid(weight * (phi(t * u - shift) - phi(-t * u - shift)), u) / np.trapezoid(weight, u)
    assert math.isclose(P.exact_power_value(shift, df, 0.05), 1 - inside, abs_tol=1e-8)


def test_detectable_shift_inverts_power():
    for df in (1.0, 3.0, 48.0, 1e4, 1e9):
        s = P.detectable_shift_value(0.8, df, 0.1)
        assert math.isclose(P.exact_power_value(s, df, 0.1), 0.8, abs_tol=1e-9)
    assert P.exact_power_value(60.0, 20.0, 0.05) > 1 - 1e-12


# -- stored forms -------------------------------------------------------------

def test_only_days_of_the_spine_are_read(spark, small):
    path = store_events(spark, small)
    spine = S.date_spine(spark, dt.date(2024, 1, 3), dt.date(2024, 1, 24)).where(F.weekday(S.DAY).isin(0, 6))
    found = tables.read_days(spark, path, "day", spine, S.DAY, DAILY)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    days = {r.day for r in found.select("day").distinct().collect()}
    assert days and {d.weekday() for d in days} <= {0, 6}
    found = tables.read_days(spark, path, "day", spine, S.DAY, DAILY)
    found.collect()
    plan, scan = found._jdf.queryExecution().executedPlan(), None
    leaves = plan.collectLeaves() if "AdaptiveSparkPlan" not in plan.nodeName() else plan.executedPlan().collectLeaves()
    for k in range(leaves.size()):
        metrics = leaves.apply(k).metrics()
        if metrics.contains("numPartitions"):
            scan = metrics.apply("numPartitions").value()
    assert scan is None or scan <= len(days)


def test_numbers_and_bitmaps(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(100_000) if rng.random() > 0.02 else None, dt.date(2024, 1, 1 + rng.randrange(20)), "ab"[rng.randrange(2)]) for _ in range(6_000)]
    frame = spark.createDataFrame(rows, "id long, day date, kind string")
    numbers = distinct.number_ids(frame.where("day <= date'2024-01-10'"), "id", group_limit=500)  # numbered in chunks
    first = {r.id: r.id_number for r in numbers.collect()}
    assert sorted(first.values()) == list(range(len(first)))
    again = {r.id: r.id_number for r in distinct.number_ids(frame, "id", known=numbers).collect()}
    assert sorted(again.values()) == list(range(len(again))) and all(again[k] == v for k, v in first.items())
    bitmaps = distinct.daily_bitmaps(frame, distinct.number_ids(frame, "id", known=numbers), "id", ["day", "kind"])
    for low, high in ((1, 20), (3, 9), (7, 7)):
        part = bitmaps.where(F.col("day").between(dt.date(2024, 1, low), dt.date(2024, 1, high)))
        got = {r.kind: r.n_distinct for r in distinct.distinct_in(part, ["kind"]).collect()}
        assert got == {k: len({i for i, d, kind in rows if i is not None and kind == k and low <= d.day <= high}) for k in "ab"}


def test_history_day_by_day_equals_all_at_once(spark, tmp_path):
    rng = random.Random(5)
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=d) for d in (0, 1, 3, 4, 9, 10)]
    rows = [(k, d, rng.choice(["x", "y", None]), rng.choice([1.5, None])) for d in days for k in [None, *range(40)] if rng.random() > 0.25]
    frame = spark.createDataFrame(rows, "k int, day date, state string, price double")
    path, keys, columns = str(tmp_path / "history"), ["k"], ["state", "price"]
    for i, d in enumerate(days):
        for _ in range(2 if i == 3 else 1):  # a day may be repeated
            history.add_snapshot(path, frame.where(F.col("day") == d), keys, columns, d, days[i - 1] if i else None)
    stepwise = sorted(map(tuple, history.read_history(spark, path, days, frame, keys, columns).collect()), key=repr)
    for limit in (2_000_000, 20):
        at_once = history.versions(frame, keys, "day", columns, group_limit=limit)
        assert sorted(map(tuple, at_once.select(*keys, *columns, "valid_from", "valid_to").collect()), key=repr) == stepwise
    assert any(r[-1] is None for r in stepwise) and any(r[-1] is not None for r in stepwise)


# -- densities and split sums ---------------------------------------------------

def test_smoothed_density_matches_direct_sum(spark):
    rng = np.random.default_rng(8)
    values = {"a": np.concatenate((rng.normal(50, 9, 3_000), rng.normal(90, 3, 500))), "b": rng.exponential(4, 800), "same": np.full(5, 2.0)}
    frame = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None)], "k string, x double")
    from cohorta.operators import reshape

    rows = reshape.smoothed_density(frame, ["k"], "x", points=50).collect()
    assert {r.k for r in rows} == {"a", "b"} and len(rows) == 100
    for k in ("a", "b"):
        own, v = sorted((r for r in rows if r.k == k), key=lambda r: r.point), values[k]
        h = 0.9 * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2
        assert math.isclose(own[0].bandwidth, h, rel_tol=1e-9)
        x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
        direct = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose([r.x for r in own], x) and np.allclose([r.density for r in own], direct, atol=2e-5 * direct.max())
    whole = reshape.smoothed_density(frame.where("k = 'b'"), [], "x", points=30, bandwidth=0.5).collect()
    assert len(whole) == 30 and math.isclose(sum(r.density for r in whole) * (max(r.x for r in whole) - min(r.x for r in whole)) / 29, 1, rel_tol=0.05)
    assert reshape.smoothed_density(frame.limit(0), ["k"], "x").collect() == []


def rows_out_of_joins(plan):
    """Rows that each join of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_out_of_joins(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return rows_out_of_joins(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for k in range(plan.children().size()) for n in rows_out_of_joins(plan.children().apply(k))]


def test_smoothed_density_joins_values_not_rows(spark):
    """Rows of a large group must not meet in the join with the groups' figures."""
    from cohorta.operators import reshape

    frame = spark.createDataFrame([(k, float(x % 7)) for k in ("a", "b", None) for x in range(500)], "k string, x double")
    out = reshape.smoothed_density(frame, ["k"], "x", points=20, bins=None)
    assert len(out.collect()) == 40
    joins = rows_out_of_joins(out._jdf.queryExecution().executedPlan())
    assert joins and max(joins) <= 14


def test_split_sums_match_single_splits(spark):
    rng = random.Random(3)
    rows = [(u, dt.date(2024, 1, 1 + d), float(rng.randrange(100)) if rng.random() > 0.1 else None) for u in [None, *range(30)] for d in range(5)]
    frame = spark.createDataFrame(rows, "unit int, day date, x double").repartition(6)
    got = {(r.split, r.day): (r.t_x, r.c_x) for r in simulation.split_sums(frame, "unit", "day", ["x"], 20, 0.3, "s").collect()}
    assert len(got) == 100
    for split in range(20):
        draw = lambda u: int(hashlib.md5(f"s{split // 8}-{u}".encode()).hexdigest()[4 * (split % 8) :][:4], 16)
        for d in range(5):
            own = [(draw(u) < round(0.3 * 65_536), x) for u, day, x in rows if u is not None and day.day == d + 1 and x is not None]
            sums = tuple(sum(x for t, x in own if t == side) if any(t == side for t, _ in own) else None for side in (True, False))
            assert got[split, dt.date(2024, 1, 1 + d)] == sums
