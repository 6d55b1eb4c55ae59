"""Benchmark decontamination: an FM-index per shard of training texts.

A shard is a run of whole texts within a task. Its words become symbols: each word that
occurs in a test phrase has its own, every run of other words and every end of a text is
one separator. Separators count as all different, in text order, so a suffix ends at the
first one. The suffixes are sorted by prefix doubling, the last column of the sorted
rotations is kept as a wavelet matrix, and every test phrase is searched backwards through
its ranks, all phrases at once. Occurrences are located by walking to a sampled suffix
position; separators are never walked over, as the first word of each run is sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohorta.llm.registry import cut, texts
from cohorta.llm.udf import chunks
from cohorta.llm.words import PLAIN_PATTERN, look_up, plain_words

WINDOW = 10
#: Characters of text in one index, about 350,000 words.
SHARD_CHARS = 2_000_000
SAMPLE_STEP = 16
#: Phrases sent to the executors at once; more are searched in further passes over the texts.
PHRASES_PER_PASS = 1_000_000
LEAKS = "n_words long, items array<string>, starts array<long>, ends array<long>"


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. ``s`` ends with a separator (0)."""
    n = s.size
    bits = max(1, int(s.max()).bit_length())
    depth = min(n, max(1, 62 // bits))
    separator = np.where(s == 0, np.arange(n), n)
    left = np.minimum.accumulate(separator[::-1])[::-1] - np.arange(n)  # words before the suffix ends
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] |= np.where(left[: n - k] > k, s[k:], 0)
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    open_ = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
    while open_.size:
        at = order[open_]
        second = np.where(left[at] < depth, at, rank[np.minimum(at + depth, n - 1)])
        both = start[open_] * (n + 1) + second
        by = np.argsort(both)
        both = both[by]
        order[open_] = at[by]
        first = np.concatenate(([True], both[1:] != both[:-1]))
        begin = np.maximum.accumulate(np.where(first, open_, 0))
        start[open_] = begin
        rank[order[open_]] = begin
        open_ = open_[~(first & np.concatenate((first[1:], [True])))]
        depth *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol."""

    def __init__(self, a: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (a >> b & 1).astype(bool)
            packed = np.zeros(a.size // 64 * 8 + 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: raw.size] = raw
            blocks = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)))
            self.levels.append((b, blocks, before, a.size - int(before[-1])))
            a = np.concatenate((a[~bit], a[bit]))

    @staticmethod
    def _ones(blocks: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return before[w] + np.bitwise_count(blocks[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def sink(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the place before ``i`` ends up at the bottom, among the symbol's own."""
        for b, blocks, before, zeros in self.levels:
            ones = self._ones(blocks, before, i)
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i``, and their places at the bottom."""
        symbol = np.zeros(i.size, np.int64)
        for _, blocks, before, zeros in self.levels:
            bit = (blocks[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(blocks, before, i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol, i


class FMIndex:
    """Suffix index of one shard: ranks in its last column, counts of smaller symbols, and every
    few suffix positions, from which all others are found by walking back."""

    def __init__(self, s: np.ndarray, symbols: int, step: int = SAMPLE_STEP):
        order = suffix_order(s)
        last = s[order - 1].astype(np.int64)
        self.n = s.size
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols + 1))))
        self.ranks = WaveletMatrix(last, max(1, int(symbols).bit_length()))
        every = np.arange(symbols + 1)
        self.shift = self.first[:-1] - self.ranks.sink(every, np.zeros(symbols + 1, np.int64))
        self.sampled = (order % step == 0) | (last == 0)
        self.sample_no = np.cumsum(self.sampled, dtype=np.int32)
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (one per row) that occur, and their ranges of suffixes."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[which, column].astype(np.int64)
            low = self.ranks.sink(symbol, low) + self.shift[symbol]
            high = self.ranks.sink(symbol, high) + self.shift[symbol]
            there = low < high
            which, low, high = which[there], low[there], high[there]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes."""
        position = np.empty(rows.size, np.int64)
        todo, steps = np.arange(rows.size), 0
        while todo.size:
            done = self.sampled[rows]
            position[todo[done]] = self.samples[self.sample_no[rows[done]] - 1] + steps
            todo, rows = todo[~done], rows[~done]
            symbol, place = self.ranks.read(rows)
            rows = place + self.shift[symbol]
            steps += 1
        return position


def phrase_tables(rows: list[tuple[str, str]]) -> tuple[dict[bytes, int], dict[int, tuple[np.ndarray, list[list[str]]]]]:
    """Test phrases (phrase, item) as symbols: their words' ids, and per length one table
    of phrases with the items of each."""
    ids: dict[bytes, int] = {}
    items: dict[str, set[str]] = {}
    for phrase, item in rows:
        found = items.setdefault(phrase, set())
        if item is not None:
            found.add(item)
    by_length: dict[int, list] = {}
    for phrase, found in items.items():
        words = phrase.encode("utf-8", "surrogatepass").split(b" ")
        for w in words:
            ids.setdefault(w, len(ids) + 1)
        by_length.setdefault(len(words), []).append(([ids[w] for w in words], sorted(found)))
    return ids, {k: (np.array([x for x, _ in v], np.int32), [x for _, x in v]) for k, v in by_length.items()}


def occurrences(docs: list[list[bytes]], phrases: tuple) -> Iterator[tuple[int, int, int, list[str]]]:
    """(document, first word, words, items) of each phrase found in a shard."""
    known, tables = phrases
    sizes = np.array([len(w) for w in docs], np.int64)
    ends = np.cumsum(sizes)
    ids = look_up(known, [w for d in docs for w in d])
    ids = np.insert(ids, ends, 0)  # a separator after each text
    keep = (ids != 0) | np.concatenate(([True], ids[:-1] != 0))
    where = np.flatnonzero(keep)
    s = ids[where]
    if not known or not s.any():
        return
    index = FMIndex(s, len(known))
    begins = np.concatenate(([0], ends[:-1])) + np.arange(sizes.size)
    for length, (table, items) in tables.items():
        which, low, high = index.search(table)
        counts = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        at = where[index.locate(rows)]
        doc = np.searchsorted(begins, at, "right") - 1
        for d, first, p in zip(doc.tolist(), (at - begins[doc]).tolist(), np.repeat(which, counts).tolist()):
            yield d, first, length, items[p]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def phrase_rows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (phrase, item): every ``window`` consecutive words of a test item, or all of
    a shorter one. An item without words has none; an item without id has phrases only."""
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(PLAIN_PATTERN), 0)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(1), F.size("w") - window + 1)
    rows = rows.select("item", "w", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    return rows.select(F.array_join(F.slice("w", F.col("i"), window), " ").alias("phrase"), "item").distinct()


def with_leaks(docs: DataFrame, phrase_table: DataFrame, text: str | Column, name: str, with_rest: bool = False) -> DataFrame:
    """``docs`` with a struct column LEAKS of a text column: words, items found, and merged spans of words;
    ``with_rest``: also the text without the spans, null where there are none or nothing is left.

    Phrases beyond PHRASES_PER_PASS take several passes. Each one's result is written down before the
    next, so no more than one table of phrases is held at a time, however long the benchmark.
    """
    spark = docs.sparkSession
    text = F.col(text) if isinstance(text, str) else text
    passes = max(1, -(-phrase_table.count() // PHRASES_PER_PASS))
    out = docs
    for k in range(passes):
        part = phrase_table.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k) if passes > 1 else phrase_table
        phrases = spark.sparkContext.broadcast(phrase_tables([tuple(x) for x in part.collect()]))  # at most about PHRASES_PER_PASS rows
        last = k == passes - 1
        out = out.withColumn(name, _pass(phrases, with_rest and last)(text, *([F.col(name)] if k else [])))
        if not last:
            out = cut(out)
            phrases.unpersist()
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def without_spans(text: str, spans: list[tuple[int, int]]) -> str | None:
    """The text without spans of words; None if there are no spans or no word is left."""
    if not spans:
        return None
    words = [m.span() for m in re.finditer(PLAIN_PATTERN, text.translate(LOWER))]
    if sum(b - a for a, b in spans) == len(words):
        return None
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*kept, text[at:]])


def _pass(phrases, with_rest: bool):
    def search(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, *before = batch if isinstance(batch, tuple) else (batch,)
            values, out = ["" if t is None else t for t in text], []
            for part in chunks(values, SHARD_CHARS):
                docs = [plain_words(t) for t in part]
                spans, items = [[] for _ in docs], [set() for _ in docs]
                for d, first, length, names in occurrences(docs, phrases.value):
                    spans[d].append((first, first + length))
                    items[d].update(names)
                out += zip(map(len, docs), items, spans)
            if before:
                b = before[0]
                out = [(n, i | set(bi), s + list(zip(bs, be))) for (n, i, s), bi, bs, be in zip(out, b["items"], b["starts"], b["ends"])]
            out = [(n, sorted(i), merged(s)) for n, i, s in out]
            frame = {"n_words": [x[0] for x in out], "items": [x[1] for x in out], "starts": [[a for a, _ in x[2]] for x in out], "ends": [[b for _, b in x[2]] for x in out]}
            if with_rest:
                frame["rest"] = [without_spans(t, x[2]) for t, x in zip(values, out)]
            yield pd.DataFrame(frame)

    return pandas_udf(search, LEAKS + ", rest string" * with_rest).asNondeterministic()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a phrase), items
    (sorted as strings), starts and ends (merged spans of words, end exclusive).

    Null and empty texts have no words and no hits. Every row is judged by itself, so
    repeated rows and null ids come out as they went in; other columns are not read.
    An empty benchmark finds nothing.
    """
    d = texts(docs)
    found = with_leaks(d, phrase_rows(benchmark, window), "text", "f")
    hit = F.aggregate(F.zip_with("f.starts", "f.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "f.n_words", hit.alias("n_hit"), "f.items", "f.starts", "f.ends")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the spans that test phrases cover. A text that had words and
    loses them all goes; texts without a hit stay as they are. ``n_chars`` follows the text."""
    found = with_leaks(docs, phrase_rows(benchmark, window), F.col("text").cast("string"), "__leaks", with_rest=True)
    out = found.withColumn("__rest", F.col("__leaks.rest")).where("__rest is not null or size(__leaks.starts) = 0")
    changed = F.size("__leaks.starts") > 0
    new = {"text": F.when(changed, F.col("__rest")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__rest").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)
