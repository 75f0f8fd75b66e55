"""A linear-chain conditional random field over word-shape features, in numpy.

Sequences are padded and worked in batches: training is full-batch AdaGrad on
the exact gradient (forward-backward), decoding is Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Number of places, and the features of each in turn.
Sequence = tuple[int, Iterable[list[str]]]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass(frozen=True)
class Crf:
    """Weights of (feature, tag), of tag changes, and of the first tag; features are numbered by ``known``."""

    known: dict[str, int]
    emit: np.ndarray
    change: np.ndarray
    start: np.ndarray

    def numbers(self, sequences: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers padded to (sequence, place, feature), unknown ones 0, and lengths."""
        lengths = np.array([n for n, _ in sequences])
        out = np.zeros((len(sequences), max(1, lengths.max(initial=1)), 1), np.int32)
        for i, (_, features) in enumerate(sequences):
            for j, fs in enumerate(features):
                if len(fs) > out.shape[2]:
                    out = np.pad(out, ((0, 0), (0, 0), (0, len(fs) - out.shape[2])))
                out[i, j, : len(fs)] = [self.known.get(f, 0) for f in fs]
        return out, lengths

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Sums of the features' weights, feature by feature, so that nothing wider than the scores is made."""
        scores = self.emit[ids[:, :, 0]]
        for f in range(1, ids.shape[2]):
            scores += self.emit[ids[:, :, f]]
        return scores

    def viterbi(self, sequences: list[Sequence], most: int = 1 << 14) -> list[np.ndarray]:
        """The best tags of every sequence.

        Sequences of like length are worked together, ``most`` places of them
        at a time with the padding; a longer one comes alone.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: sequences[i][0])
        while order:
            n = 1
            while n < len(order) and (n + 1) * sequences[order[n]][0] <= most:
                n += 1
            own, order = order[:n], order[n:]
            for i, tags in zip(own, self._best([sequences[i] for i in own])):
                out[i] = tags
        return out

    def _best(self, sequences: list[Sequence]) -> list[np.ndarray]:
        ids, lengths = self.numbers(sequences)
        scores = self.emissions(ids)
        best = scores[:, 0] + self.start
        back = np.zeros(scores.shape, np.int8)
        for t in range(1, scores.shape[1]):
            paths = best[:, :, None] + self.change
            back[:, t] = paths.argmax(1)
            on = (t < lengths)[:, None]
            best = np.where(on, paths.max(1) + scores[:, t], best)
        tags = np.zeros(scores.shape[:2], np.int8)
        tag = best.argmax(1)
        rows = np.arange(len(ids))
        for t in range(scores.shape[1] - 1, -1, -1):
            tags[:, t] = tag
            tag = np.where(t < lengths, back[rows, t, tag], tag)
        return [tags[i, :n] for i, n in enumerate(lengths)]


def train(sequences: list[list[list[str]]], tags: list[list[int]], n_tags: int, *, steps: int = 120, rate: float = 0.5, l2: float = 1e-3) -> Crf:
    known = {f: i + 1 for i, f in enumerate(sorted({f for s in sequences for fs in s for f in fs}))}
    crf = Crf(known, np.zeros((len(known) + 1, n_tags)), np.zeros((n_tags, n_tags)), np.zeros(n_tags))
    ids, lengths = crf.numbers([(len(s), s) for s in sequences])
    n, most = ids.shape[:2]
    gold = np.zeros((n, most), np.int64)
    for i, t in enumerate(tags):
        gold[i, : len(t)] = t
    on = np.arange(most) < lengths[:, None]
    rows = np.arange(n)
    truth = np.zeros((n, most, n_tags))
    truth[rows[:, None], np.arange(most), gold] = on
    pairs = np.zeros((n_tags, n_tags))
    np.add.at(pairs, (gold[:, :-1][on[:, 1:]], gold[:, 1:][on[:, 1:]]), 1)
    flat = ids.reshape(n * most, -1)
    params = [crf.emit, crf.change, crf.start]
    seen = [np.full_like(p, 1e-6) for p in params]
    for _ in range(steps):
        scores = crf.emissions(ids)
        fore = np.zeros(scores.shape)
        fore[:, 0] = scores[:, 0] + crf.start
        for t in range(1, most):
            fore[:, t] = np.where(on[:, t, None], _logsum(fore[:, t - 1, :, None] + crf.change, 1) + scores[:, t], fore[:, t - 1])
        total = _logsum(fore[:, -1], 1)
        rear = np.zeros(scores.shape)
        expected = np.zeros((n_tags, n_tags))
        for t in range(most - 2, -1, -1):
            ahead = crf.change + (scores[:, t + 1] + rear[:, t + 1])[:, None, :]
            rear[:, t] = np.where(on[:, t + 1, None], _logsum(ahead, 2), 0)
            both = np.exp(fore[:, t, :, None] + ahead - total[:, None, None])
            expected += both[on[:, t + 1]].sum(0)
        wrong = truth - np.exp(fore + rear - total[:, None, None]) * on[:, :, None]
        by_place = wrong.reshape(n * most, n_tags)
        emit = np.stack([np.bincount(flat.ravel(), np.repeat(by_place[:, k], flat.shape[1]), len(known) + 1) for k in range(n_tags)], 1)
        emit[0] = 0
        for p, g, s in zip(params, (emit / n, (pairs - expected) / n, wrong[:, 0].sum(0) / n), seen):
            g = g - l2 * p
            s += g * g
            p += rate * g / np.sqrt(s)
    return crf
