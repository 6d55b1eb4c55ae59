"""Quality rules by line sequence labelling.

A conditional random field reads the lines of a text in order and marks each as content
or boilerplate (Viterbi). A text stays if content lines hold at least CONTENT_SHARE of
its words and the plain rules (length, repeated word windows) hold.

There are no labels of lines, so the field learns them from labelled documents by
expectation-maximisation. A first model without steps between lines takes every line for what
its document is; the ordinary lines of bad documents are outvoted by the many of good
ones. Then lines are labelled by the model, the document's label is put in as a constraint (at
least half the words of a good document are content, at least half of a bad one's are not), and
the field is fitted on those labels, a few rounds over. Steps between lines are
thereby learned from documents that hold both kinds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.crf import ChainModel, train, viterbi
from cohorta.llm.registry import texts
from cohorta.llm.udf import on_texts
from cohorta.llm.words import WordHashes, mixed, utf8, word_windows

#: Labelled documents the field is fitted on at most; those with the smallest hashes of their ids.
TRAIN_DOCS = 1500
CONTENT_SHARE = 0.5
#: Rounds of labelling and fitting.
EM_ROUNDS = 3
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
FEATURES = 16
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double"
#: Used when no labelled document is at hand: marked lines need symbols, repeats or shouting.
PLAIN_WEIGHTS = {1: 8.0, 2: 2.0, 3: 2.0, 4: 3.0, 6: 1.5, 7: 4.0, 13: 4.0}


def without(raw: bytes, drop: bytes) -> int:
    """Bytes of ``raw`` that are in ``drop``."""
    return len(raw) - len(raw.translate(None, drop))


def repeated_words(hashes: np.ndarray, sizes: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """For the words of texts laid end to end: whether a word stands in a window of words
    that the same text has twice or more."""
    n = hashes.size
    keys = word_windows(hashes, window)
    doc = np.repeat(np.arange(sizes.size, dtype=np.uint64), sizes)
    start = np.flatnonzero(doc[: keys.size] == doc[window - 1 :][: keys.size]) if keys.size else np.zeros(0, np.int64)
    keys = mixed(keys[start] + (doc[start] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(start.size, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start[twice], 1)
    np.add.at(change, start[twice] + window, -1)
    return np.cumsum(change[:-1]) > 0


class LineReader:
    """Counts of texts and features of their lines."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, values: list[str]) -> dict:
        raws = [utf8(t) for t in values]
        lines = [r.split(b"\n") for r in raws]
        words = [[line.split() for line in own] for own in lines]
        flat = [w for own in words for line in own for w in line]
        per_line = np.array([len(line) for own in words for line in own], np.int64)
        per_doc = np.array([sum(map(len, own)) for own in words], np.int64)
        repeat = repeated_words(self.hashes(flat), per_doc)
        total = np.concatenate(([0], np.cumsum(repeat)))
        ends = np.cumsum(per_line)
        in_line = total[ends] - total[ends - per_line]
        ends = np.cumsum(per_doc)
        dups, rows = [], []
        for own, own_words in zip(lines, words):
            seen: set[bytes] = set()
            n_dup = 0
            for line, w in zip(own, own_words):
                again = line in seen and bool(w)
                n_dup += again
                seen.add(line)
                rows.append(self.features(line, w, again))
            dups.append(n_dup)
        x = np.array(rows, np.float64).reshape(-1, FEATURES)
        if len(x):
            x[:, 13] = in_line / np.maximum(per_line, 1)
        return {
            "n_words": per_doc, "word_chars": [len(t) - without(r, SPACE) for t, r in zip(values, raws)],
            "n_symbols": [without(r, SYMBOLS) for r in raws], "n_dup_lines": dups, "n_repeat_words": total[ends] - total[ends - per_doc],
            "n_lines": np.array([len(own) for own in lines], np.int64), "line_words": per_line, "x": x,
        }

    @staticmethod
    def features(line: bytes, w: list[bytes], again: bool) -> list[float]:
        n, size = len(w), max(1, len(line))
        if not n:
            return [1.0] + [0.0] * (FEATURES - 2) + [1.0]
        symbols = without(line, SYMBOLS)
        upper = without(line, UPPER) / size
        last = line.rstrip()[-1:]
        shout = line.count(b"!!") / n
        distinct = len(set(w)) / n
        twins = sum(map(bytes.__eq__, w, w[1:])) / n
        return [
            1.0, min(1.0, 4 * symbols / size), float(symbols >= 5), float(upper > 0.5), min(1.0, shout), float(last in b".!?"),
            float(again), float(n > 6) * (1 - distinct), min(1.0, twins), min(1.0, n / 50), min(2.0, size / n / 8),
            float(n < 4), min(1.0, without(line, DIGITS) / size * 4), 0.0, float(line.count(b" | ") >= 3), 0.0,
        ]


def plain_model() -> ChainModel:
    weights = np.zeros((FEATURES, 2))
    for k, v in PLAIN_WEIGHTS.items():
        weights[k] = (v, -v)
    weights[0] = (-1.0, 1.0)
    return ChainModel(weights, np.eye(2) * 0.5, np.zeros(2))


def fit_lines(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> ChainModel:
    """The field fitted on at most ``limit`` labelled documents; stated weights if both
    kinds of label are not there."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("doc_id is not null and quality in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    named = texts(docs).where("text is not null").join(F.broadcast(marks), "doc_id")  # at most `limit` labels
    one = named.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = sorted(one.collect(), key=lambda r: (r.doc_id, r.quality))  # a text per label, however many rows share an id
    if len({r.quality for r in rows}) < 2:
        return plain_model()
    read = LineReader()([r.text for r in rows])
    return learn_lines(read["x"], read["line_words"], read["n_lines"], np.array([r.quality for r in rows]))


def constrained(label: np.ndarray, margin: np.ndarray, words: np.ndarray, lengths: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Labels of lines, changed where a document's label asks for it: the lines nearest to the other
    kind (by margin towards content) change until half of its words are of its own kind."""
    out, start = label.copy(), 0
    for n, q in zip(lengths.tolist(), quality.tolist()):
        own = slice(start, start + n)
        start += n
        lacking = words[own].sum() / 2 - words[own][out[own] == q].sum()
        if lacking > 0:
            for k in np.argsort(-margin[own] if q == 1 else margin[own], kind="stable"):
                if out[own][k] != q and words[own][k]:
                    out[own.start + k] = q
                    lacking -= words[own][k]
                    if lacking <= 0:
                        break
    return out


def learn_lines(x: np.ndarray, words: np.ndarray, lengths: np.ndarray, quality: np.ndarray, rounds: int = EM_ROUNDS) -> ChainModel:
    """The field from documents' labels; x and words are of lines laid end to end."""
    lengths = np.asarray(lengths, np.int64)
    first = train(x, np.repeat(quality, lengths), np.ones(len(x), np.int64), 2)
    alone = ChainModel(first.weights, np.zeros((2, 2)), np.zeros(2))
    emit = alone.emissions(x) + first.begin
    label, model = emit.argmax(1), alone
    for _ in range(rounds):
        label = constrained(label, emit[:, 1] - emit[:, 0], words, lengths, quality)
        model = train(x, label, lengths, 2)
        emit = model.emissions(x)
        label = viterbi(emit, lengths, model)
    return model


def judge_lines(model: ChainModel):
    """Function for ``on_texts``: the counts, and what Viterbi decoding says of the lines."""

    def make():
        reader = LineReader()

        def work(values: list[str]) -> dict:
            got = reader(values)
            label = viterbi(model.emissions(got.pop("x")), got["n_lines"], model) if values else np.zeros(0)
            words = got.pop("line_words")
            ends = np.cumsum(got["n_lines"])
            of_lines = lambda a: (c := np.concatenate(([0], np.cumsum(a))))[ends] - c[ends - got["n_lines"]]
            got["n_content_lines"] = of_lines((label == 1) & (words > 0))
            got["content_share"] = of_lines(words * (label == 1)) / np.maximum(got["n_words"], 1)
            return got

        return work

    return make


def line_quality(docs: DataFrame, labels: DataFrame, column: str = "__lines") -> DataFrame:
    """``docs`` with one struct column: the counts of FIELDS, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Rows are judged one by
    one, so repeated rows and null ids stay as they are, and other columns pass through.
    """
    model = fit_lines(docs, labels)
    out = docs.withColumn("__read", on_texts(judge_lines(model), FIELDS, F.col("text").cast("string")))
    failed = (F.col("__read.n_words") < MIN_WORDS) | (100 * F.col("__read.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__read.n_words"))
    kept = ~failed & (F.col("__read.content_share") >= CONTENT_SHARE)
    return out.withColumn(column, F.struct("__read.*", failed.alias("base_failed"), kept.alias("kept"))).drop("__read")
