"""Exact top-k inner products as a Voronoi join.

1. Pivots: centres of a bounded sample of distinct vectors. The sample's vectors are real
   rows, so they also give every query a score that its k-th best cannot fall below.
2. Every row goes to its nearest pivot's cell; a cell's summary is its number of rows and
   its largest distance to the pivot.
3. Of x = p + d, a query's score is q.x <= q.p + |q| |d|. A row at distance r from its
   pivot can be among a query's best only where q.p + |q| r reaches the query's bound; the
   smallest such r over a group of queries decides which rows of a cell that group gets.
4. Rows and queries meet by (group of queries, cell, part of the cell), all of bounded
   size, whose best k per query are found by blocks of matrix products, then merged.

Nothing is approximate: the bounds only leave out rows that cannot be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.llm.registry import cut

#: Rows the pivots are taken from, pivots, rounds of their placing.
SAMPLE, PIVOTS, ROUNDS = 2_048, 128, 6
#: Queries in a group, and rows in a part of a cell, that meet in one task.
QUERY_BLOCK, DATA_BLOCK = 8_192, 4_096
#: Queries whose scores with a part are held at once.
SCORED = 512
SCALE = 256
RESULT = "query_id long, rank int, vec_id long, score long"
EXACT = 2.0**53
LONGS = (-(2**63), 2**63 - 1)


def whole_numbers(vectors, width: int) -> np.ndarray:
    """floor(256 x) of each component as float64 (whole numbers), padded with zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return np.floor(out * SCALE)


def place_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the sample by a few rounds of k-means; any points would do for right
    results, central ones leave out more."""
    centres = sample[:: max(1, len(sample) // pivots)][:pivots].copy()
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(0)
    return centres


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of x by rows of p, too large by what rounding may take away."""
    size = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :]
    return np.sqrt(np.maximum(size - 2 * (x @ p.T), 0.0) + 1e-13 * size)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where no sum can pass 2**53, else in
    integers of any length, ended at the range of a long."""
    if q.size and x.size and q.shape[1] * np.abs(q).max() * np.abs(x).max() < EXACT:
        return q @ x.T
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, *LONGS) if q.size and x.size else np.zeros((len(q), len(x)))


def least_distances(q: np.ndarray, ids: np.ndarray, pivots: np.ndarray, members: np.ndarray, member_ids: np.ndarray, k: int) -> np.ndarray:
    """Per query and pivot the distance from which a row can be among the query's best k."""
    scores = products(q, members).astype(float)
    scores[ids[:, None] == member_ids[None, :]] = -np.inf
    bound = np.full(len(q), -np.inf)
    if members.shape[0] >= k:
        bound = np.partition(scores, members.shape[0] - k, axis=1)[:, members.shape[0] - k]
    at = q @ pivots.T
    norm = np.sqrt((q * q).sum(1))
    # Sums of doubles: the bound is widened by far more than their rounding.
    gap = bound[:, None] - at - 1e-9 * (np.abs(bound[:, None]) + np.abs(at) + norm[:, None] * np.sqrt((pivots * pivots).sum(1))[None, :] + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = gap / norm[:, None]
    return np.where(gap <= 0, 0.0, np.where(norm[:, None] > 0, least, np.inf))


def best(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Per query its best k rows of x: place of the query, places of the rows, scores. Ties go to
    the smaller id, and rows with the query's own id are left out."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    low, high = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for start in range(0, len(q), SCORED):
        scores = products(q[start : start + SCORED], x)
        for r, row in enumerate(scores):
            at = start + r
            rest = row if low[at] == high[at] else np.delete(row, slice(low[at], high[at]))
            if not len(rest):
                continue
            edge = np.partition(rest, len(rest) - k)[len(rest) - k] if len(rest) > k else rest.min()
            found = np.flatnonzero(rest >= edge)
            # Equal rows may be many: all above the edge, and of those at the edge the first ones.
            above = found[rest[found] > edge]
            found = np.concatenate((above, found[rest[found] == edge][: k - len(above)])) if len(found) > k else found
            found = found[np.lexsort((found, -rest[found]))]
            places = np.where(found >= low[at], found + (high[at] - low[at]), found)
            yield at, order[places], [int(v) for v in rest[found]]


def _assign(pivots: np.ndarray, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(whole_numbers(batch["embedding"], width), pivots)
                cell = d.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), dist=d[np.arange(len(d)), cell])

    return run


def _needed(pivots: np.ndarray, reach: np.ndarray, members: np.ndarray, member_ids: np.ndarray, width: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = whole_numbers(batch["embedding"], width)
                least = least_distances(q, batch["vec_id"].to_numpy(), pivots, members, member_ids, k)
                row, cell = np.nonzero(least <= reach[None, :])
                out = batch.iloc[row].reset_index(drop=True)
                yield out.assign(cell=cell.astype("int32"), least=least[row, cell])

    return run


def _solve(width: int, k: int):
    def run(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            keys, query_ids, ids = queries["query_key"].to_numpy(), queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            q, x = whole_numbers(queries["embedding"], width), whole_numbers(rows["embedding"], width)
            for at, places, scores in best(q, query_ids, x, ids, k):
                found += [(keys[at], query_ids[at], ids[p], s) for p, s in zip(places, scores)]
        return pd.DataFrame(found, columns=["query_key", "query_id", "vec_id", "score"]).astype("int64")

    return run


def _groups(counts: dict[int, int], cells: int, block: int) -> list[tuple[int, int]]:
    """First group and number of groups of the queries at home in each cell: small cells
    share a group, large ones are cut."""
    out, group, held = [], 0, 0
    for cell in range(cells):
        n = counts.get(cell, 0)
        if n > block:
            group += 1 if held else 0
            parts = -(-n // block)
            out.append((group, parts))
            group, held = group + parts, 0
            continue
        if held + n > block:
            group, held = group + 1, 0
        out.append((group, 1))
        held += n
    return out


def knn_join(
    vectors: DataFrame, is_query: str, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK
) -> DataFrame:
    """Each query row's k best rows by the inner product of floor(256 x): query_id, rank
    (from 1), vec_id, score; ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding (other columns are not read); ``is_query`` is a condition on
    vec_id. Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part. A row with the query's own id is no candidate. Repeated
    candidate rows count each; of repeated equal query rows one is asked. Vectors of
    unlike length are compared as if padded with zeros; scores outside a long's range end at it.
    No rows, no result. The driver holds ``sample`` vectors and one summary row per pivot.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: ~F.coalesce(F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False)))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    n, width = v.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], RESULT)

    h = F.xxhash64("embedding")
    share = min(1.0, 4 * sample / n)
    drawn = v if share == 1.0 else v.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    drawn = drawn.groupBy(h.alias("h")).agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    members = drawn.orderBy("h").limit(sample).collect() or v.limit(1).collect()
    member_ids = np.array([m.vec_id for m in members], np.int64)
    points = whole_numbers([m.embedding for m in members], width)
    centres = place_pivots(points, pivots)

    data = cut(v.mapInPandas(_assign(centres, width), f"{_ddl(v)}, cell int, dist double"))
    asked = F.expr(is_query)
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far"), F.count_if(asked).alias("asked")).collect()
    reach, parts = np.full(len(centres), -1.0), [1] * len(centres)
    for s in summary:
        reach[s.cell], parts[s.cell] = s.far, -(-s.n // data_block)
    groups = _groups({s.cell: s.asked for s in summary}, len(centres), query_block)
    at = lambda values, key: F.element_at(F.array(*[F.lit(x) for x in values]), F.col(key) + 1)

    key = F.xxhash64("vec_id", "embedding")
    queries = data.where(asked).select(
        "vec_id", "embedding", key.alias("query_key"), (at([g for g, _ in groups], "cell") + F.pmod(key, at([p for _, p in groups], "cell")).cast("int")).alias("group")
    ).dropDuplicates(["vec_id", "query_key"])
    wanted = cut(queries.mapInPandas(_needed(centres, reach, points, member_ids, width, k), f"{_ddl(v)}, query_key long, group int, cell int, least double"))

    # Group and cell meet once: groups x pivots rows at most, joined to the rows of their cell.
    least = wanted.groupBy("group", "cell").agg(F.min("least").alias("least"))
    near = data.join(least, "cell").where("dist >= least")
    rows = near.select(F.col("group").alias("for_group"), F.col("cell").alias("of_cell"), F.pmod(key, at(parts, "cell")).cast("int").alias("in_part"), F.col("vec_id"), F.col("embedding"))
    asking = wanted.select("group", "cell", F.explode(F.sequence(F.lit(0), at(parts, "cell") - 1)).alias("part"), "query_key", "vec_id", "embedding")
    found = asking.groupBy("group", "cell", "part").cogroup(rows.groupBy("for_group", "of_cell", "in_part")).applyInPandas(_solve(width, k), "query_key long, query_id long, vec_id long, score long")

    # At most k rows per query and part of a cell.
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _ddl(v: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in v.dtypes)
