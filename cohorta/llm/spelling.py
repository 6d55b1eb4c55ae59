"""Spelling variants: words one edit apart, found by walking all words through a trie.

The trie is relational. A node is a prefix; the edges of one depth are a table of nodes
with the characters that go on from them and whether the node is a word itself, built by
one aggregation of the words. The frontier holds states (word, position in it, node, one
edit made). Depth by depth it is joined with that depth's nodes:

* a word whose prefix of this depth is its own node starts states: its next character
  replaced by a later one that the node knows, or left out;
* a state whose next character the node knows goes on to the child;
* a state at the end of its word, on a node that is a word, has found a neighbour.

Near the root every node knows every character, so edits there would start states that
soon die in great number. All words are therefore walked twice, forwards and backwards,
and an edit is made in the second half only: one of the two walks has it there. An
insertion is the other word's deletion, and a replacement is found from the word with the
smaller character, so every pair is found from one side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.registry import cut, texts

MIN_CHARS, MIN_COUNT = 5, 3
#: One deletion in so many runs.
DAMAGE = 97
#: Longer words do not go through the trie, as each character is a join.
DEPTHS = 40
#: Words a task counts before it hands them on.
WORDS_HELD = 400_000
#: A-Z are lower-cased before; a word's characters are one byte each in Latin-1.
_RUNS = bytes(x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))


def _count_runs(damage: int):
    def frame(counts: Counter) -> pd.DataFrame:
        kept = [(w.decode("latin-1"), n) for w, n in counts.items() if n and len(w) >= MIN_CHARS]
        return pd.DataFrame(kept, columns=["word", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, crc = Counter(), zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                runs = text.encode("latin-1", "replace").lower().translate(_RUNS).split()
                counts.update(runs)
                start = crc(b"%s:" % doc_id.encode())
                for w in set(runs):
                    h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % damage == 0:
                        n, at = runs.count(w), h % len(w)
                        counts[w] -= n
                        counts[w[:at] + w[at + 1 :]] += n
                if len(counts) > WORDS_HELD:
                    yield frame(counts)
                    counts.clear()
        yield frame(counts)

    return run


def count_words(docs: DataFrame, damage: int = DAMAGE, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the damaged runs of all texts, with at least MIN_CHARS code points and
    ``min_count`` occurrences. A null doc_id reads as no characters before the colon."""
    rows = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = rows.where(F.col("text").isNotNull()).mapInPandas(_count_runs(damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _nodes(walks: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth: the characters that follow (no more than the alphabet has), and whether a word ends here."""
    there = walks.where(F.length("word") >= depth)
    step = F.when(F.length("word") > depth, F.substring("word", depth + 1, 1))
    return there.groupBy("back", F.substring("word", 1, depth).alias("node")).agg(F.collect_set(step).alias("next"), F.max(F.length("word") == depth).alias("ends"))


def _step(frontier: DataFrame, walks: DataFrame, depth: int) -> DataFrame:
    """States of the next depth, and pairs found (``node`` is the neighbour then)."""
    fresh = walks.where((F.floor(F.length("word") / 2) <= depth) & (F.length("word") > depth)).select(
        "back", "word", F.lit(depth).alias("at"), F.substring("word", 1, depth).alias("node"), F.lit(True).alias("fresh")
    )
    states = frontier.where(~F.col("found")).select("back", "word", "at", "node", F.lit(False).alias("fresh")).union(fresh)
    s = states.join(_nodes(walks, depth), ["back", "node"])
    char = lambda at: F.col("word").substr(at + 1, F.lit(1))
    state = lambda at, node, found: F.struct(at.cast("int").alias("at"), node.alias("node"), found.alias("found"))

    def onward(at):
        """Where a state with one edit goes from its node: a neighbour, the child, or nowhere."""
        goes = F.when((at < F.length("word")) & F.array_contains("next", char(at)), F.array(state(at + 1, F.concat("node", char(at)), F.lit(False))))
        return F.when((at == F.length("word")) & F.col("ends"), F.array(state(at, F.col("node"), F.lit(True)))).otherwise(goes)

    none = F.array().cast("array<struct<at:int,node:string,found:boolean>>")
    swapped = F.transform(F.filter("next", lambda c: c > char(F.col("at"))), lambda c: state(F.col("at") + 1, F.concat("node", c), F.lit(False)))
    made = F.when(~F.col("fresh"), F.coalesce(onward(F.col("at")), none)).otherwise(F.concat(swapped, F.coalesce(onward(F.col("at") + 1), none)))
    return s.select("back", "word", F.inline(made))


def _long_keys():
    """Hashes of a long word: of all of it, of it without each character, of it with each character open."""

    def keys(word: str) -> pd.DataFrame:
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        n, base = len(codes), np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)
        before = np.concatenate(([np.uint64(0)], np.cumsum(codes * power[:n], dtype=np.uint64)))
        after = before[n] - before[1:]  # of the characters behind each place, at their own powers
        place = np.arange(n)
        # Without a character the ones behind it move down a place; times the base they are as before.
        cut_out = np.unique(before[:n] * base + after)
        whole = before[n] * base
        return pd.DataFrame({
            "word": word,
            "kind": np.repeat([0, 1, 2], [1, len(cut_out), n]),
            "size": np.repeat([n, n - 1, n], [1, len(cut_out), n]),
            "place": np.concatenate(([-1], np.full(len(cut_out), -1), place)),
            "h": np.concatenate(([whole], cut_out, before[:n] + after)).view(np.int64),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for word in batch["word"]:
                yield keys(word)

    return run


def _long_pairs(words: DataFrame, depths: int) -> DataFrame:
    """Pairs whose longer word is past the trie's depths. Words that agree in all but one place
    differ there, so no key has more words than the alphabet has characters; pairs are then
    compared in full."""
    schema = "word string, kind int, size int, place int, h long"
    keys = words.where(F.length("word") >= depths).select("word").mapInPandas(_long_keys(), schema)
    whole = keys.where("kind = 0").select("size", "h", F.col("word").alias("a"))
    without = keys.where("kind = 1").select("size", "h", F.col("word").alias("b"))
    open_place = keys.where(f"kind = 2 and size > {depths}")
    same = open_place.select("size", "place", "h", F.col("word").alias("a")).join(open_place.select("size", "place", "h", F.col("word").alias("b")), ["size", "place", "h"])
    pairs = whole.join(without, ["size", "h"]).select("a", "b").union(same.where("a < b").select("a", "b"))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).distinct()


def near_pairs(words: DataFrame, depths: int = DEPTHS) -> DataFrame:
    """a, b: every two distinct words one edit apart, both ways round. Words longer than
    ``depths`` are matched by hashes of what is left without one character instead."""
    walks = cut(
        words.where(F.length("word") <= depths).select(F.lit(False).alias("back"), "word").union(
            words.where(F.length("word") <= depths).select(F.lit(True).alias("back"), F.reverse("word")))
    )
    shortest, longest, beyond = words.agg(F.min(F.length("word")), F.max(F.least(F.length("word"), F.lit(depths))), F.count_if(F.length("word") > depths)).first()
    found = [words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)]
    frontier = words.sparkSession.createDataFrame([], "back boolean, word string, at int, node string, found boolean")
    for depth in range((shortest or 0) // 2, (longest or -1) + 1):
        frontier = cut(_step(frontier, walks, depth))
        turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
        found.append(frontier.where("found").select(turned("word").alias("a"), turned("node").alias("b")))
    if beyond:
        found.append(_long_pairs(words, depths))
    pairs = reduce(DataFrame.union, found)
    return pairs.union(pairs.select("b", "a")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: the last form reached. A form has at least twice its
    word's count, so chains are no longer than the logarithm of the largest count, and
    doubling the step needs the logarithm of that many rounds."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = F.col("next").isNotNull().alias("moved")
        now = cut(now.select("word", "root").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), moved))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, damage: int = DAMAGE, min_count: int = MIN_COUNT, depths: int = DEPTHS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``count_words``.

    A word's form is its near word (one inserted, deleted or replaced code point) with the largest n, the
    smallest in code-point order among equals, where that n is at least twice the word's; else
    null. The root is the last of the forms followed from the word, itself without one.
    Null and empty texts hold no words; repeated rows count each; no words, no rows. Other columns of
    ``docs`` than doc_id and text are not read.
    """
    words = cut(count_words(docs, damage, min_count))
    pairs = cut(near_pairs(words, depths))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    best = F.min_by(F.struct(F.col("b").alias("form"), F.col("other_n").alias("form_n")), F.struct(-F.col("other_n"), "b"))
    near = pairs.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.form_n") >= 2 * F.col("n"), F.col("best")).alias("best"))
    judged = cut(judged.select("word", "best.form", "n", "n_near", "best.form_n"))
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
