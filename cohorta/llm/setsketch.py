"""Near-duplicates by SetSketch registers.

A text's set is its distinct word shingles. A register holds, on an exponential scale of
base BASE, the smallest of the exponentially distributed values that a hash function
gives to the set's elements, cut off at both ends. Registers of two sets merge by maximum
and are equal about as often as the sets are alike, so runs of registers (bands) serve as
locality-sensitive keys. Pairs that share a band are estimated jointly by maximum
likelihood from how many registers are larger, smaller and equal, and what is left is
verified on the full sets. Groups come from links as connected components.

No step makes all pairs of a group. Texts with equal sets are one class from the start.
In each bucket the class that shares most buckets with others, likely the text the others
were made from, is compared with them, which joins most of what belongs together. Classes
of a bucket that are still apart then meet over rare shingles only: two sets that are alike
share one of their first few shingles in order of frequency, and the ranks of the first
shared one bound how much they can share at all. This prefix filter loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohorta.llm.components import components
from cohorta.llm.registry import cut, texts
from cohorta.llm.udf import on_texts
from cohorta.llm.words import WordHashes, mixed, spaced_words, word_windows

#: 32 bands of 4 registers: a pair of similarity 0.8 shares no band once in 20 million.
BANDS, ROWS = 32, 4
BASE, RATE, TOP = 1.001, 20.0, 65_534
SHINGLE = 2
PERCENT = 80
#: Standard deviations of the estimate below the threshold at which a pair is let go.
SLACK = 6.0
#: Classes whose keys (three numbers each) are broadcast to fetch their texts; more are joined by shuffling.
BROADCAST_CLASSES = 300_000
SKETCH = "n_shingles long, print string, sketch binary"


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all k-word shingles; of the whole sequence if it is shorter."""
    if not hashes.size:
        return np.zeros(0, np.uint64)
    return np.unique(word_windows(hashes, min(k, hashes.size)) ^ mixed(np.array([min(k, hashes.size)], np.uint64)))


class Sketcher:
    """Registers of sets of hashes: truncated minima of exponential draws, the same draws for every set."""

    def __init__(self, registers: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, registers, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, registers, np.uint64)

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        low = np.full(self.a.size, np.iinfo(np.uint64).max)
        for at in range(0, elements.size, 2048):
            block = elements[at : at + 2048, None] * self.a + self.b
            low = np.minimum(low, block.min(0))
        u = (low.astype(np.float64) + 1.0) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merged_sketch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs (rows of registers) by maximum likelihood, sizes being known."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)

    def likelihood(j):
        up, down = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        tiny = 1e-300
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    for _ in range(40):  # the likelihood is concave: golden section
        third = (high - low) * 0.381966
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def sketch_texts(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, tie (hash of the text), set size, print (hash of the set), sketch."""

    def make():
        hashes, sketcher = WordHashes(), Sketcher()

        def work(values: list[str]) -> dict:
            words = [spaced_words(t, lower=True) for t in values]
            flat = hashes([w for own in words for w in own])
            parts = np.split(flat, np.cumsum([len(w) for w in words])[:-1]) if words else []
            sets = [shingles(p, shingle) for p in parts]
            return {
                "n_shingles": [s.size for s in sets], "print": [xxhash.xxh3_128_hexdigest(s.tobytes()) if s.size else None for s in sets],
                "sketch": [sketcher(s).tobytes() if s.size else None for s in sets],
            }

        return work

    d = texts(docs).withColumn("tie", F.xxhash64("text"))
    return d.withColumn("s", on_texts(make, SKETCH, "text")).select("doc_id", "tie", "s.*")


def _likely(percent: int):
    def check(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b, n_a, n_b in batches:
            if not len(a):
                yield pd.Series([], dtype=bool)
                continue
            x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (a, b))
            j = percent / 100
            floor = j - SLACK * np.sqrt(j * (1 - j) / x.shape[1])
            yield pd.Series(joint_estimate(x, y, n_a.to_numpy(float), n_b.to_numpy(float)) >= floor)

    return pandas_udf(check, "boolean").asNondeterministic()


def _linked(percent: int, shingle: int):
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes, kept = WordHashes(), {}

        def own(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[text] = shingles(hashes(spaced_words(text, lower=True)), shingle)
            return kept[text]

        for left, right in batches:
            out = []
            for a, b in zip(left, right):
                x, y = own(a), shingles(hashes(spaced_words(b, lower=True)), shingle)
                both = np.intersect1d(x, y, assume_unique=True).size
                out.append(100 * both >= percent * (x.size + y.size - both))
            yield pd.Series(out, dtype=bool)

    return pandas_udf(check, "boolean").asNondeterministic()


def _shingle_array(shingle: int):
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.Series([shingles(hashes(spaced_words(t, lower=True)), shingle).view(np.int64) for t in batch], dtype=object)

    return pandas_udf(make, "array<long>").asNondeterministic()


class NearDuplicates:
    """One search: classes of equal sets, and components of linked classes."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT):
        self.shingle, self.percent = shingle, percent
        self.docs = texts(docs)
        self.rows = cut(sketch_texts(docs, shingle))
        # A class is named by a number given as it is written; its smallest row stands for it.
        best = self.rows.where("n_shingles > 0 and doc_id is not null").groupBy("print", "n_shingles").agg(F.min(F.struct("doc_id", "tie")).alias("m"))
        named = cut(best.select("print", "n_shingles", "m.doc_id", "m.tie").withColumn("node", F.monotonically_increasing_id()))
        self.classes = named
        once = self.rows.where("n_shingles > 0").dropDuplicates(["doc_id", "tie"]).select("doc_id", "tie", "sketch")
        self.sketches = cut(named.join(once, ["doc_id", "tie"]).select("node", F.col("n_shingles").alias("n"), "sketch"))
        self.labels = None  # node -> component, for nodes that are not alone

    def _buckets(self) -> DataFrame:
        band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
        b = self.sketches.select("node", "n", "sketch", band)
        key = F.xxhash64("band", F.expr(f"substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS})"))
        return b.select(key.alias("bucket"), "node", "n")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def _alike_in_size(self) -> F.Column:
        low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        return 100 * low >= self.percent * high

    def _texts_of(self, nodes: DataFrame) -> DataFrame:
        """node, text of some classes."""
        who = cut(nodes.distinct().join(self.classes, "node").select("node", "doc_id", "tie"))
        who = F.broadcast(who) if who.count() <= BROADCAST_CLASSES else who
        found = self.docs.withColumn("tie", F.xxhash64("text")).join(who, ["doc_id", "tie"]).select("node", "text")
        return found.dropDuplicates(["node"])

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are alike."""
        with_text = cut(self._texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))))
        p = pairs.join(with_text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        p = p.join(with_text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").sortWithinPartitions("a")
        return p.where(_linked(self.percent, self.shingle)("text_a", "text_b")).select("a", "b")

    def _likely_pairs(self, pairs: DataFrame) -> DataFrame:
        s = self.sketches
        p = pairs.join(s.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        p = p.join(s.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        p = p.where(self._alike_in_size())
        return p.where(_likely(self.percent)("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")

    def _link(self, pairs: DataFrame) -> None:
        """Verify candidate pairs and join the components of those that are linked."""
        likely = cut(self._likely_pairs(pairs))
        if likely.isEmpty():
            return
        edges = self._labelled(self._verify(likely).withColumnRenamed("a", "node")).select(F.col("component").alias("x"), "b")
        edges = self._labelled(edges.withColumnRenamed("b", "node")).select("x", F.col("component").alias("y"))
        self._contract(components(edges))

    def _contract(self, found: DataFrame) -> None:
        """found: component -> label, for components that joined."""
        found = found.select(F.col("node").alias("component"), F.col("label"))
        if self.labels is None:
            self.labels = cut(found.select(F.col("component").alias("node"), F.col("label").alias("component")))
            return
        old = self.labels.join(found, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
        new = found.join(self.labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("label").alias("component"))
        self.labels = cut(old.union(new))

    def solve(self) -> NearDuplicates:
        buckets = self._buckets()
        shared = buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
        rows = cut(buckets.join(shared, "bucket"))
        degree = rows.groupBy("node").agg(F.sum("k").alias("degree"))
        centres = rows.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", -F.col("node"))).alias("c"))
        rows = cut(rows.join(centres.select("bucket", (-F.col("c.col2")).alias("pivot")), "bucket").where("node <> pivot").select("bucket", "node", "n", "pivot"))
        self._link(rows.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
        # What buckets still hold apart, without the class that was compared with all others.
        rows = self._labelled(rows)
        live = rows.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
        open_ = cut(rows.join(live, "bucket", "left_semi").select("node", "n", "component").distinct())
        if not open_.isEmpty():
            self._link(self._by_rare_shingles(open_))
        return self

    def _by_rare_shingles(self, open_: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes in different components that can be alike.

        With need = percent / (100 + percent) * (n_a + n_b) shared shingles, two sets whose
        first shared shingle, in order of frequency, has ranks i and j (from 0) share at
        most 1 + min(n_a - i - 1, n_b - j - 1).
        """
        sets = self._texts_of(open_.select("node")).select("node", F.explode(_shingle_array(self.shingle)("text")).alias("h"))
        sets = cut(sets)
        often = sets.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
        of_node = sets.join(often, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("s"))  # one text's shingles
        of_node = of_node.join(open_, "node")
        # Shingles that no other open set has come first; they are shared with none.
        alone = F.col("n") - F.size("s")
        reach = F.floor(F.col("n") * (100 - self.percent) / 100).cast("int") + 1 - alone
        first = of_node.where(reach > 0).select("node", "n", "component", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.greatest(reach, F.lit(1)))).alias("i", "x"))
        first = cut(first.select("node", "n", "component", (F.col("alone") + F.col("i")).alias("rank"), F.col("x.h").alias("h")))
        # The component that most sets of a shingle are in is met by the others only.
        most = first.groupBy("h", "component").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("parts"))
        most = most.where("parts > 1").select("h", F.col("m.component").alias("top"))
        met = cut(first.join(most, "h"))
        a, b = (met.select("h", "top", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component", "rank"))) for s in "ab")
        bound = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))
        can = (100 + self.percent) * bound >= self.percent * (F.col("n_a") + F.col("n_b"))
        once = (F.col("component_b") == F.col("top_b")) | (F.col("component_a") < F.col("component_b"))
        pairs = a.where("component_a <> top").drop("top").join(b.withColumnRenamed("top", "top_b"), "h").where((F.col("component_a") != F.col("component_b")) & once & can & self._alike_in_size())
        return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()

    def result(self) -> DataFrame:
        """Per row: doc_id, tie, n_shingles, component_id, kept."""
        members = self._labelled(self.classes.select("node", "print", "n_shingles", "doc_id"))
        smallest = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of_print = members.join(smallest, "component").select("print", "n_shingles", "component_id")
        out = self.rows.select("doc_id", "tie", "n_shingles", "print").join(of_print, ["print", "n_shingles"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", "tie", "n_shingles", component.alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, tie (xxhash64 of the text), n_shingles, component_id (smallest
    doc_id reachable over links) and kept (doc_id = component_id).

    Texts without words (null, empty) are linked with nothing and kept. Rows with a null
    id are no part of any group: component_id is null and kept is true. Rows that share
    an id are judged each by its own text. Other columns are not read.
    """
    return NearDuplicates(docs, shingle, percent).solve().result()


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns; repeated rows (same id and text) count as one."""
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).distinct()
    d = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__tie"))
    return d.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__hash"]).drop("__hash")
