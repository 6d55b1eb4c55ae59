"""Streams in several runs against the batch operators on the same rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cohorta.operators import funnel
from cohorta.operators import joins as batch_joins
from cohorta.streaming import joins, runs, sessions

SCHEMA = "event_id long, ts timestamp, user_id long, kind string"
GAP, LATE = 600, 300
STEPS = ["view", "click", "purchase"]
BEGIN = dt.datetime(2024, 5, 1)


def made(seed, n, start, end):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = BEGIN + dt.timedelta(seconds=rng.randrange(start, end))
        rows.append((seed * 10_000 + i, at, rng.randrange(12) if rng.random() > 0.03 else None, rng.choice([*STEPS, "other", "view"])))
    return rows


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def steps():
    return [(k, F.col("kind") == k) for k in STEPS]


def run_sessions(spark, folder, out, check):
    stream = runs.read_files(spark, folder, SCHEMA, "ts", files_per_batch=1)
    return runs.run_to_end(sessions.session_funnels(stream, "user_id", "ts", GAP, steps(), LATE), out, check)


def batch_sessions(spark, rows):
    e = funnel.sessionize(spark.createDataFrame(rows, SCHEMA).where("user_id is not null"), "user_id", "ts", GAP, ["event_id"])
    reached = funnel.session_funnel(e, ["user_id", "session_start"], "ts", steps())
    whole = e.groupBy("user_id", "session_start").agg(F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n_events"))
    out = whole.join(reached, ["user_id", "session_start"], "left")
    return {(r.user_id, r.session_start): (r.last_event, r.n_events, r.t_view, r.t_click, r.t_purchase) for r in out.collect()}


def test_sessions_over_restarts(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first, second, third = made(1, 250, 0, 20_000), made(2, 250, 19_900, 40_000), made(3, 1, 90_000, 90_001)
    add_file(spark, folder, first)
    one = run_sessions(spark, folder, out, check)
    n_first = one.count()
    assert 0 < n_first
    assert run_sessions(spark, folder, out, check).count() == n_first  # nothing new, nothing twice
    add_file(spark, folder, second)
    run_sessions(spark, folder, out, check)
    late = [(99_999, BEGIN + dt.timedelta(seconds=5), 3, "purchase")]  # far behind: dropped
    add_file(spark, folder, third + late)
    got = {(r.user_id, r.session_start): (r.last_event, r.n_events, r.t_view, r.t_click, r.t_purchase) for r in run_sessions(spark, folder, out, check).collect()}
    edge = max(r[1] for r in third) - dt.timedelta(seconds=LATE)
    want = {k: v for k, v in batch_sessions(spark, first + second).items() if v[0] + dt.timedelta(seconds=GAP, microseconds=1) <= edge}
    assert got == want and any(v[-1] for v in got.values())
    assert len(want) == len(batch_sessions(spark, first + second))  # the last file closes them all


def test_state_leaves_after_the_gap(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    add_file(spark, folder, made(1, 200, 0, 5_000))
    kept = []
    for k in range(2):
        stream = runs.read_files(spark, folder, SCHEMA, "ts")
        s = sessions.session_funnels(stream, "user_id", "ts", GAP, steps(), LATE)
        q = s.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        kept.append([json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1])
        add_file(spark, folder, [(1, BEGIN + dt.timedelta(days=2 + k), 500 + k, "view")])
    assert kept[0] > 1 and kept[1] == 1


@pytest.mark.parametrize("files", [1, 3])
def test_interval_join_equals_batch(spark, tmp_path, files):
    folder = str(tmp_path / "in")
    rows = made(5, 400, 0, 30_000)
    rows.sort(key=lambda r: r[1])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def side(frame, kind):
        return frame.where(F.col("kind") == kind).select("user_id", F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_ts"))

    for k in range(files):
        add_file(spark, folder, rows[k * len(rows) // files : (k + 1) * len(rows) // files])
        stream = lambda: runs.read_files(spark, folder, SCHEMA, "ts")
        joined = joins.interval_join(side(stream(), "view"), side(stream(), "click"), ["user_id"], "view_ts", "click_ts", 900, LATE)
        got = runs.run_to_end(joined, out, check)
    b = spark.createDataFrame(rows, SCHEMA)
    want = batch_joins.interval_join(side(b, "view"), side(b, "click"), ["user_id"], "view_ts", "click_ts", 900)
    key = lambda df: sorted((r.view_id, r.click_id) for r in df.collect())
    assert key(got) == key(want) and key(got)
