"""Quality classifier by positive-unlabelled learning.

Trusted good documents are the positives, web text of unknown quality is the rest. A small
network over style features minimises the non-negative unbiased risk

    prior * R_pos(good) + max(0, R_unl(bad) - prior * R_pos(bad))

so that the positives inside the unlabelled texts are not learned as bad. The class prior
is the lowest ratio of unlabelled to positive mass above a score of a
positive-against-unlabelled model, read off texts that the model has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.llm.line_quality import DIGITS, SYMBOLS, UPPER, repeated_words, without
from cohorta.llm.registry import sample_texts, texts
from cohorta.llm.udf import on_texts
from cohorta.llm.words import WordHashes, utf8

#: Positives and unlabelled texts the model is fitted on at most, each.
FIT_DOCS = 2500
HIDDEN = 12
#: Networks whose margins are averaged; splits for the prior, chance that its bound does not hold, positives above its threshold.
STARTS, FOLDS, CHANCE, SURE = 5, 5, 0.1, 0.9
FEATURES = 15
#: A text counts as good from this score on: all but MISSED of the trusted positives do at least.
CUT = 0.3
MISSED = 0.003
#: The cut is looked for so far around the estimated share of bad texts.
SLACK = 0.04
#: Used when there are no positives or no unlabelled texts to learn from.
NEUTRAL = 0.5


@dataclass
class StyleModel:
    """Network over style features, and the margin and unit that turn its margins into scores."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    low: float = 0.0
    unit: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """CUT at the margin ``low``; one ``unit`` of margin more is two log-odds more."""
        z = 2 * (self.margin(x) - self.low) / self.unit + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class StyleReader:
    """Style features of whole texts."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, values: list[str]) -> np.ndarray:
        raws = [utf8(t) for t in values]
        words = [r.split() for r in raws]
        flat = self.hashes([w for own in words for w in own])
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        total = np.concatenate(([0], np.cumsum(repeated_words(flat, sizes))))
        repeat = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1) if values else sizes
        twin = np.concatenate((flat[1:] == flat[:-1], [False])) if flat.size else np.zeros(0, bool)
        total = np.concatenate(([0], np.cumsum(twin)))
        twins = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1) if values else sizes
        return np.array([self.features(r, w, a, b) for r, w, a, b in zip(raws, words, repeat, twins)]).reshape(-1, FEATURES)

    @staticmethod
    def features(raw: bytes, w: list[bytes], repeat: float, twins: float) -> list[float]:
        n, size = max(1, len(w)), max(1, len(raw))
        symbols = without(raw, SYMBOLS)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        return [
            np.log1p(len(w)), symbols / size, symbols / n, without(raw, UPPER) / size, raw.count(b"!!") / n, raw.count(b" | ") / n,
            repeat, twins, len(set(w)) / n, size / n, 1 - len(set(lines)) / max(1, len(lines)),
            without(raw, b".,;:?") / n, without(raw, DIGITS) / size, len(lines) / n, float(not w),
        ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class _Network:
    """One hidden layer, trained by Adam on given slopes of the loss by margin."""

    def __init__(self, inputs: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def forward(self, x):
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def step(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = 0.02, decay: float = 1e-4) -> None:
        """parts: inputs, hidden values and slopes."""
        slopes = [np.zeros_like(a) for a in self.p]
        for x, h, g in parts:
            back = np.outer(g, self.p[2]) * (1 - h * h)
            for k, d in enumerate((x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]))):
                slopes[k] += d
        self.t += 1
        for k, d in enumerate(slopes):
            d = d + decay * self.p[k]
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def estimate_prior(x_pos: np.ndarray, x_unl: np.ndarray, folds: int = FOLDS, rounds: int = 120) -> float:
    """Share of positives among the unlabelled.

    Above any score the unlabelled hold at least their positives, so the ratio of unlabelled to
    positive mass there is no less than the share; it comes down to it where only
    positives are left. Every text is scored by a model that has not seen it (``folds`` splits, each
    kind on its own, strongly held back so that their scores compare). The threshold has nearly all
    positives above it (SURE) and the lowest ratio plus a bound of its chance error.
    """
    folds = max(1, min(folds, len(x_pos), len(x_unl)))
    score_p, score_u = np.zeros(len(x_pos)), np.zeros(len(x_unl))
    for k in range(folds):
        own_p, own_u = np.arange(len(x_pos)) % folds == k, np.arange(len(x_unl)) % folds == k
        p, u = (x_pos[~own_p], x_unl[~own_u]) if folds > 1 else (x_pos, x_unl)
        net = _Network(p.shape[1], seed=5 + k)
        for _ in range(rounds):
            (hp, zp), (hu, zu) = net.forward(p), net.forward(u)
            net.step([(p, hp, -(1 - _sigmoid(zp)) / len(p)), (u, hu, _sigmoid(zu) / len(u))], decay=1e-2)
        score_p[own_p], score_u[own_u] = net.forward(x_pos[own_p])[1], net.forward(x_unl[own_u])[1]
    sp, su = np.sort(score_p), np.sort(score_u)
    mass_p = 1 - np.arange(len(sp)) / len(sp)
    mass_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    error = np.sqrt(np.log(4 / CHANCE) / 2 * (1 / len(su) + 1 / len(sp)))
    enough = mass_p >= SURE
    return float(np.clip((mass_u / mass_p)[enough][np.argmin(((mass_u + error) / mass_p)[enough])], 0.05, 0.95))


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Margin that a text needs to count as good: the middle of the widest gap between the unlabelled
    texts around the estimated share of bad ones. The positives were fitted on, so texts that
    were not lie lower; the cut is no higher than nearly all of them, whatever the gap."""
    low, high = np.quantile(unlabelled, np.clip([1 - prior - SLACK, 1 - prior + SLACK], 0, 1))
    inside = np.sort(unlabelled[(unlabelled >= low) & (unlabelled <= high)])
    if len(inside) > 1:
        k = int(np.argmax(np.diff(inside)))
        low = (inside[k] + inside[k + 1]) / 2
    return float(min(low, np.quantile(positive, MISSED)))


def fit(x_pos: np.ndarray, x_unl: np.ndarray, prior: float | None = None, rounds: int = 400, starts: int = STARTS, seed: int = 11) -> StyleModel:
    """Network of least non-negative unbiased risk, with logistic loss: the mean margin of
    several starts, as one start may take a small kind of bad text for good."""
    both = np.concatenate((x_pos, x_unl))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (x_pos - mean) / scale, (x_unl - mean) / scale
    prior = estimate_prior(p, u) if prior is None else prior
    nets = [_Network(p.shape[1], seed + k) for k in range(starts)]
    for net in nets:
        for _ in range(rounds):
            (hp, zp), (hu, zu) = net.forward(p), net.forward(u)
            good, bad = -(1 - _sigmoid(zp)) / len(p), _sigmoid(zp) / len(p)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                net.step([(p, hp, prior * (good - bad)), (u, hu, _sigmoid(zu) / len(u))])
            else:  # the negative part has been overfitted: climb back
                net.step([(p, hp, prior * bad), (u, hu, -_sigmoid(zu) / len(u))])
    # Networks side by side are one wide network.
    w1, b1, w2, b2 = (np.concatenate([n.p[k] for n in nets], axis=-1) for k in range(4))
    model = StyleModel(mean, scale, w1, b1, w2 / starts, np.array([b2.mean()]))
    margins = model.margin(x_pos)
    model.low = _cut(margins, model.margin(x_unl), prior)
    model.unit = max(float(np.median(margins)) - model.low, 1e-3)
    return model


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from; rows with a null id are not among them."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> StyleModel | None:
    """Model from at most ``limit`` trusted positives (label 1) and as many texts of unknown
    quality, none of them held out; None if either is missing."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(limit)
    d = texts(docs)
    positive = [r.text for r in d.join(F.broadcast(marks), "doc_id").where("text is not null").select("text").limit(limit).collect()]
    unknown = sample_texts(d.where(~held_out()), limit)
    if not positive or not unknown:
        return None
    read = StyleReader()
    return fit(read(positive), read(unknown))


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from CUT on).

    Only the text goes into a score. Null texts are scored as empty ones. Without labels
    every score is NEUTRAL. Rows are scored one by one, so repeated rows and null ids stay.
    """
    d = texts(docs)
    model = fit_quality(docs, labels, limit)

    def make():
        reader = StyleReader()

        def work(values: list[str]) -> dict:
            x = reader(values)
            return {"score": model.score(x) if model is not None else np.full(len(x), NEUTRAL)}

        return work

    out = d.select("doc_id", held_out().alias("held_out"), on_texts(make, "score double", "text").alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= CUT).cast("int").alias("predicted"))
