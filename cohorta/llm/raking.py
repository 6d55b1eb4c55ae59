"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking multiplies the cells of each
source, then language, then topic, by what their marginal lacks, until all three hold. A document's factor is its cell's. Its probability
to be sampled is the factor times a constant, one at most; the constant makes the expected
tokens the wanted share of all. Where one is the most, the rest of the factor stays as the
sample's weight, so that weighted expected tokens have the target mix exactly. The draw is
a hash of the document's id and text, so a run can be repeated.

Topics are nearest centroids of a spherical k-means over hashed words, fitted on all
documents; only the start centroids are chosen among TOPIC_DOCS texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohorta.llm.registry import cut
from cohorta.llm.udf import on_texts
from cohorta.llm.words import WordHashes, spaced_words

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
TOPIC_DOCS = 2000
BUCKETS = 1024
#: Vectors that are unpacked at once.
BLOCK = 64
#: Length of vectors, which are kept in whole numbers of 16 bits.
SCALE = 2**15
#: Expected share of the tokens that is sampled.
KEEP = 0.5
#: Exponent of the default targets: shares grow with tokens to this power, 0 is uniform.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Cells that the driver rakes at most; more are raked by Spark, with the same factors.
MAX_CELLS = 1_000_000
#: Rounds of raking at most, and the change at which they end.
ROUNDS, CLOSE = 500, 1e-10
NONE = "(none)"


def word_counts(hashes: WordHashes, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and vectors of damped counts of hashed words, of length SCALE and in
    whole numbers: sums and products of them are exact, whatever the order and the batches."""
    words = [spaced_words(t, lower=True) for t in values]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = hashes(list(chain.from_iterable(words)))
    places = np.repeat(np.arange(0, n.size * BUCKETS, BUCKETS), n) + ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(places, minlength=n.size * BUCKETS).reshape(-1, BUCKETS)
    damped = np.log1p(np.arange(counts.max(initial=0) + 1))[counts]
    scale = np.array([SCALE / max(np.linalg.norm(d), 1e-9) for d in damped])
    damped *= scale[:, None]
    return n, np.rint(damped, out=damped)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Per row buckets and values of what is not zero; ``unpacked`` undoes it."""
    row, at = np.nonzero(vectors)
    pairs = np.stack((at, vectors[row, at]), 1).astype("<u2").tobytes()
    ends = (4 * np.cumsum(np.bincount(row, minlength=len(vectors)))).tolist()
    return [pairs[a:b] for a, b in zip([0, *ends], ends)]


def unpacked(blobs: list[bytes]) -> np.ndarray:
    pairs = np.frombuffer(b"".join(blobs), "<u2").reshape(-1, 2)
    out = np.zeros((len(blobs), BUCKETS))
    first = np.repeat(np.arange(0, out.size, BUCKETS), [len(x) // 4 for x in blobs])
    out.reshape(-1)[first + pairs[:, 0]] = pairs[:, 1]
    return out


def nearest(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of rows as they are. Products of whole numbers are exact, so the middle may come off last."""
    middle, centres = model
    return (x @ centres.T - centres @ middle).argmax(1)


def of_length(x: np.ndarray) -> np.ndarray:
    """Rows brought to length SCALE, in whole numbers; rows of zeros stay."""
    out = x * (SCALE / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))
    return np.rint(out, out=out)


def vector_column(column: str | Column = "text") -> Column:
    """Struct of n_tokens (words between white space) and vector (packed)."""

    def make():
        hashes = WordHashes()

        def work(values: list[str]) -> dict:
            out = {"n_tokens": [], "vector": []}
            for at in range(0, len(values), 64):
                n, x = word_counts(hashes, values[at : at + 64])
                out["n_tokens"] += n.tolist()
                out["vector"] += packed(x)
            return out

        return work

    return on_texts(make, "n_tokens long, vector binary", column)


def doc_vectors(docs: DataFrame) -> DataFrame:
    """Per row with words: hash of the text, n_tokens, vector."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("h"), vector_column(text).alias("w")).where("w.n_tokens > 0").select("h", "w.*")


def summed(vectors: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """Number and sum of all vectors by nearest centroid, each seen from the middle and
    brought to length SCALE; without a model of all vectors as they are, under 0. Each task
    adds up its own, so at most topics x (BUCKETS + 1) numbers come to the driver."""
    topics = 1 if model is None else len(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((topics, BUCKETS + 1))  # the last one counts
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for at in range(0, len(blobs), BLOCK):
                x = unpacked(blobs[at : at + BLOCK])
                if model is None:
                    total[0, :-1] += x.sum(0)
                    total[0, -1] += len(x)
                    continue
                own = nearest(x, model)
                x -= model[0]
                total[:, :-1] += (own == np.arange(topics)[:, None]).astype(float) @ of_length(x)
                total[:, -1] += np.bincount(own, minlength=topics)
        topic, bucket = np.nonzero(total)
        arrays = [pa.array(v.astype(kind)) for v, kind in ((topic, np.int32), (bucket, np.int32), (total[topic, bucket], np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, ["topic", "bucket", "total"])

    parts = vectors.select("vector").mapInArrow(run, "topic int, bucket int, total long")
    out = {k: np.zeros(BUCKETS + 1) for k in range(topics)}
    for r in parts.groupBy("topic", "bucket").agg(F.sum("total").alias("total")).collect():
        out[r.topic][r.bucket] = r.total
    return {k: (int(v[-1]), v[:-1]) for k, v in out.items()}


def first_centres(vectors: DataFrame, middle: np.ndarray, topics: int, limit: int) -> np.ndarray:
    """Start centroids from the ``limit`` distinct texts with the smallest hashes: the first
    of them, then each time the one least like any so far."""
    edge = vectors.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    few = vectors.where(F.col("h") <= edge).groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").limit(limit).collect()
    x = of_length(unpacked([bytes(r.vector) for r in few]) - middle)
    centres = [x[0]]
    for _ in range(min(topics, len(x)) - 1):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    return np.array(centres)


def fit_topics(docs: DataFrame, topics: int = TOPICS, limit: int = TOPIC_DOCS, rounds: int = 12, vectors: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and centroids around it, each round a pass over all rows of
    ``docs`` (or of ``vectors``, when they are there already). Deterministic; no words at
    all give one topic. Only the start centroids come from ``limit`` texts."""
    vectors = cut(doc_vectors(docs)) if vectors is None else vectors
    n, total = summed(vectors)[0]
    if not n:
        return np.zeros(BUCKETS), np.zeros((1, BUCKETS))
    middle = np.rint(total / n)
    c = first_centres(vectors, middle, topics, limit)
    for _ in range(rounds):
        before = c.copy()
        for k, (_, total) in summed(vectors, (middle, c)).items():
            if total.any():
                c[k] = of_length(total[None])[0]
        if (c == before).all():
            break
    return middle, c


def vector_topic(model: tuple[np.ndarray, np.ndarray], column: str | Column = "vector") -> Column:
    """Nearest centroid of a packed vector."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            blobs = batch.tolist()
            parts = [nearest(unpacked(blobs[at : at + BLOCK]), model) for at in range(0, len(blobs), BLOCK)]
            yield pd.Series(np.concatenate([np.zeros(0, int), *parts]))

    return pandas_udf(run, "int")(column)


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares that grow with the totals to a power."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: dict[tuple, float], targets: list[Mapping[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple, float]:
    """Factor of each cell such that weighted totals have the target shares.

    Categories without a target (or with target zero) get factor zero; targets of
    categories without tokens are left out and the others scaled up. Where no exact
    solution exists the last round's factors are returned.
    """
    keys = list(cells)
    tokens = np.array([cells[k] for k in keys], float)
    if not keys or not tokens.sum():
        return dict.fromkeys(keys, 0.0)
    codes, goals = [], []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        codes.append(np.searchsorted(names, [k[d] for k in keys]))
        goals.append(np.array([max(0.0, target.get(n, 0.0)) for n in names]))
    live = (tokens > 0) & np.all([g[c] > 0 for c, g in zip(codes, goals)], axis=0)
    factor = live.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals):
            sums = np.bincount(code, factor * tokens, goal.size)
            there = sums > 0
            share = np.where(there, goal, 0) / max(goal[there].sum(), 1e-300) * tokens.sum()
            step = np.divide(share, sums, out=np.zeros_like(sums), where=there)
            worst = max(worst, np.abs(step[there] - 1).max(initial=0))
            factor = factor * step[code]
        if worst < close:
            break
    return dict(zip(keys, factor.tolist()))


def calibrated(cells: dict[tuple, float], factors: dict[tuple, float], keep: float = KEEP) -> float:
    """The constant c for which tokens * min(1, c * factor) make up ``keep`` of all tokens,
    or of what cells with a factor hold if that is less."""
    f = np.array([factors[k] for k in cells])
    tokens = np.array([float(cells[k]) for k in cells])
    order = np.argsort(-f)
    f, tokens = f[order][f[order] > 0], tokens[order][f[order] > 0]
    if not f.size:
        return 0.0
    want = min(keep * sum(cells.values()), tokens.sum())
    full = np.concatenate(([0.0], np.cumsum(tokens)[:-1]))  # tokens of cells at one
    rest = np.cumsum((f * tokens)[::-1])[::-1]
    options = (want - full) / rest
    return float(options[np.flatnonzero(options * f <= 1 + 1e-12)[0]]) if (options * f <= 1 + 1e-12).any() else float(1 / f[-1])


def _chances(cells: dict[tuple, float], targets: Mapping[str, Mapping[str, float]], keep: float) -> list[tuple]:
    """Per cell its names, factor, probability and weight."""
    goals = []
    for d, name in enumerate(DIMENSIONS):
        totals: dict[str, float] = {}
        for key, tokens in cells.items():
            totals[key[d]] = totals.get(key[d], 0) + tokens
        goals.append(targets.get(name) or tempered(totals, TEMPER[name]))
    factors = rake(cells, goals)
    scale = calibrated(cells, factors, keep)
    chances = {k: min(1.0, scale * v) for k, v in factors.items()}
    return [(*k, v, chances[k], scale * v / chances[k] if v else 0.0) for k, v in factors.items()]


def rake_by_spark(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float, rounds: int | None = None, close: float | None = None) -> DataFrame:
    """What ``rake`` and ``calibrated`` do, for any number of cells: per dimension and round one sum by
    category and one join with it, and one table written per round. Cells (source, lang, topic, tokens) without a factor are left out."""
    spark = cells.sparkSession
    live, goals = cells.where("tokens > 0").withColumn("f", F.lit(1.0)), {}
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    for name in DIMENSIONS:
        if targets.get(name):
            goal = spark.createDataFrame([(k, float(v)) for k, v in targets[name].items() if v > 0], f"{name} string, goal double")
        else:
            goal = cells.where("tokens > 0").groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), TEMPER[name]).alias("goal"))
        goals[name] = cut(goal)
        live = live.join(goals[name].select(name), name, "left_semi")
    live = cut(live.select(*DIMENSIONS, "tokens", "f"))
    # Categories that no cell is left of pass their share on.
    goals = {name: cut(goal.join(live.select(name).distinct(), name)) for name, goal in goals.items()}
    shares = {name: goal.agg(F.sum("goal")).first()[0] or 1.0 for name, goal in goals.items()}
    for _ in range(rounds or ROUNDS):
        now = live.withColumn("was", F.col("f"))
        for name in DIMENSIONS:
            sums = now.groupBy(name).agg(F.sum(F.col("f") * F.col("tokens")).alias("sum"))
            step = sums.join(goals[name], name).select(name, (F.col("goal") / shares[name] * whole / F.col("sum")).alias("step"))
            now = now.join(step, name).select(*DIMENSIONS, "tokens", "was", (F.col("f") * F.col("step")).alias("f"))
        live = cut(now)
        if (live.agg(F.max(F.abs(F.col("f") / F.col("was") - 1))).first()[0] or 0.0) < (close or CLOSE):
            break
    want = min(keep * whole, live.agg(F.sum("tokens")).first()[0] or 0)
    scale, full = 0.0, -1
    while True:  # cells at one stay there, and the others share what is left
        at_one = F.col("f") * scale >= 1
        n, held, rest, low = live.agg(F.count_if(at_one), F.sum(F.when(at_one, F.col("tokens"))), F.sum(F.when(~at_one, F.col("f") * F.col("tokens"))), F.min("f")).first()
        if n == full or low is None:
            break
        full, scale = n, (want - (held or 0)) / rest if rest else 1 / low
    chance = F.least(F.lit(1.0), F.col("f") * scale)
    return live.select(*DIMENSIONS, F.col("f").alias("__f"), chance.alias("__p"), (F.col("f") * scale / chance).alias("__w"))


def _categories() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in ("source", "lang")]


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, seed: int = 17) -> DataFrame:
    """``docs`` with a struct column __mix: source, lang, topic, n_tokens, factor,
    probability, sample_weight, sampled.

    ``targets`` gives shares per dimension; one left out is tempered from the totals. A
    null source or language is a category of its own; texts without words weigh nothing
    and are not sampled. Repeated rows share one decision.
    """
    source, lang = _categories()
    # Texts are read once: rows go to the shared folder with their vectors, and come back for the answer.
    rows = cut(docs.withColumn("__vector", vector_column(F.col("text").cast("string"))))
    worded = rows.where("__vector.n_tokens > 0")
    model = fit_topics(docs, vectors=worded.select(F.xxhash64(F.col("text").cast("string")).alias("h"), "__vector.vector"))
    topic = F.when(F.col("__vector.n_tokens") > 0, F.col("__topic")).otherwise(-1).cast("string")
    tagged = rows.withColumn("__topic", vector_topic(model, F.col("__vector.vector")))
    tagged = tagged.withColumn("__cell", F.struct(source.alias("source"), lang.alias("lang"), topic.alias("topic")))
    sums = tagged.where("__vector.n_tokens > 0").groupBy("__cell").agg(F.sum("__vector.n_tokens").alias("tokens")).select("__cell.*", "tokens")
    sums = cut(sums)
    rows = sums.limit(MAX_CELLS + 1).collect()
    small = len(rows) <= MAX_CELLS
    if small:
        found = _chances({(r.source, r.lang, r.topic): r.tokens for r in rows}, targets or {}, keep)
        found = docs.sparkSession.createDataFrame(found, "source string, lang string, topic string, __f double, __p double, __w double")
    else:
        found = rake_by_spark(sums, targets or {}, keep)
    found = found.select(F.struct("source", "lang", "topic").alias("__cell"), "__f", "__p", "__w")
    out = tagged.join(F.broadcast(found) if small else found, "__cell", "left")  # sent whole only up to MAX_CELLS rows
    f, p, w = (F.coalesce(c, F.lit(0.0)) for c in ("__f", "__p", "__w"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text").cast("string"), F.lit(seed)), F.lit(2**53)) / float(2**53)
    fields = F.struct("__cell.*", F.col("__vector.n_tokens").alias("n_tokens"), f.alias("factor"), p.alias("probability"), w.alias("sample_weight"), (draw < p).alias("sampled"))
    return out.withColumn("__mix", fields).select(*docs.columns, "__mix")
