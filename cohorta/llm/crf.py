"""Linear-chain conditional random field in numpy: training by gradient ascent on the
log-likelihood, decoding by Viterbi, both over many sequences at once.

Sequences are rows laid end to end with a list of lengths. Work goes in blocks of
sequences of like length, longest first, so at step t the sequences still running are the
first ones of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_CELLS = 400_000


@dataclass
class ChainModel:
    """Weights of a linear-chain field: of features, of steps between labels, of first labels."""

    weights: np.ndarray  # features x labels
    steps: np.ndarray  # labels x labels, from row to column
    begin: np.ndarray  # labels

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def _blocks(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Starts, lengths and the number still running at each step, block by block."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < order.size:
        size = max(1, BLOCK_CELLS // int(lengths[order[at]]))
        own = order[at : at + size]
        at += size
        n = lengths[own]
        running = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()
        yield starts[own], n, running


def viterbi(emit: np.ndarray, lengths: np.ndarray, model: ChainModel) -> np.ndarray:
    """Best label of each row. Ties go to the lower label."""
    out = np.zeros(len(emit), np.int8)
    for starts, n, running in _blocks(np.asarray(lengths, np.int64)):
        score = emit[starts] + model.begin
        back = []
        for t in range(1, len(running)):
            k = running[t]
            options = score[:k, :, None] + model.steps
            best = options.argmax(1)
            back.append(best.astype(np.int8))
            new = np.take_along_axis(options, best[:, None, :], 1)[:, 0] + emit[starts[:k] + t]
            score = np.concatenate((new, score[k:]))
        label = score.argmax(1)
        out[starts + n - 1] = label
        for t in range(len(running) - 1, 0, -1):
            k = running[t]
            label[:k] = back[t - 1][np.arange(k), label[:k]]
            out[starts[:k] + t - 1] = label[:k]
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def _expected(emit: np.ndarray, lengths: np.ndarray, model: ChainModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each label per row, expected steps, expected first labels."""
    labels = emit.shape[1]
    p, steps, first = np.zeros_like(emit), np.zeros((labels, labels)), np.zeros(labels)
    for starts, n, running in _blocks(lengths):
        ahead = [emit[starts] + model.begin]
        for t in range(1, len(running)):
            k = running[t]
            ahead.append(_log_sum(ahead[-1][:k, :, None] + model.steps, 1) + emit[starts[:k] + t])
        total = np.empty(n.size)
        for t, a in enumerate(ahead):
            ends = slice(running[t + 1] if t + 1 < len(running) else 0, running[t])
            total[ends] = _log_sum(a[ends], 1)
        behind = np.zeros((n.size, labels))
        for t in range(len(running) - 1, -1, -1):
            k = running[t]
            p[starts[:k] + t] = np.exp(ahead[t][:k] + behind[:k] - total[:k, None])
            if t:
                right = emit[starts[:k] + t] + behind[:k]
                steps += np.exp(ahead[t - 1][:k, :, None] + model.steps + right[:, None, :] - total[:k, None, None]).sum(0)
                behind[:k] = _log_sum(model.steps + right[:, None, :], 2)
        first += p[starts].sum(0)
    return p, steps, first


def train(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, labels: int, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> ChainModel:
    """Maximum likelihood with a small penalty, by Adam over all sequences."""
    lengths = np.asarray(lengths, np.int64)
    model = ChainModel(np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.zeros(labels))
    if not len(x):
        return model
    seen = np.eye(labels)[y]
    last = np.zeros(len(y), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    inner = np.flatnonzero(~last)
    step_counts = np.zeros((labels, labels))
    np.add.at(step_counts, (y[inner], y[inner + 1]), 1)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]
    first_counts = np.bincount(y[begins], minlength=labels)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in (model.weights, model.steps, model.begin)]
    for k in range(1, rounds + 1):
        p, steps, first = _expected(model.emissions(x), lengths, model)
        slopes = (x.T @ (seen - p) / len(x), (step_counts - steps) / len(x), (first_counts - first) / len(x))
        for value, slope, (m, v) in zip((model.weights, model.steps, model.begin), slopes, moments):
            slope = slope - decay * value
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model
