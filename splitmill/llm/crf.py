"""A linear-chain conditional random field over sets of features, in numpy.

A sequence of words is scored by the weights of each word's features for its label, of its
neighbours' features, and of each pair of labels that follow one another.  Training climbs
the log-likelihood of a labelled table (forward-backward sums, with a penalty on large
weights); decoding takes the best labels by Viterbi.  Both work on many sequences at once,
word by word; longer sequences come first, so that those still going on are a prefix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

NEVER = -1e9


def allowed(labels: Sequence[str]) -> np.ndarray:
    """Pairs of labels that may follow one another: I-k only after B-k or I-k."""
    return np.array([[not y.startswith("I-") or x[2:] == y[2:] for y in labels] for x in labels])


def starts_allowed(labels: Sequence[str]) -> np.ndarray:
    return np.array([not y.startswith("I-") for y in labels])


class Steps:
    """Sequences (lengths, one after the other) laid out word by word."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.first, self.lengths = first[self.order], lengths[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        # how many sequences have a word number t
        self.live = np.searchsorted(-self.lengths, -np.arange(longest), side="left")

    def __iter__(self):
        """(t, places of word t of the sequences that have one)."""
        for t, n in enumerate(self.live.tolist()):
            yield t, self.first[:n] + t


def viterbi(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best label of each word; ``emit`` has a row for each word."""
    steps, labels = Steps(lengths), np.zeros(len(emit), np.int64)
    back = np.zeros(emit.shape, np.int8)
    score = np.zeros((0, emit.shape[1]))
    ends = np.zeros((len(lengths), emit.shape[1]))
    for t, at in steps:
        if t == 0:
            score = start + emit[at]
        else:
            ends[len(at) : len(score)] = score[len(at) :]
            ways = score[: len(at), :, None] + moves
            best = ways.argmax(axis=1)
            back[at] = best
            score = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0] + emit[at]
    ends[: len(score)] = score
    label = ends.argmax(axis=1)
    for t in range(len(steps.live) - 1, -1, -1):
        n = steps.live[t]
        at = steps.first[:n] + t
        labels[at] = label[:n]
        if t:
            label[:n] = back[at, label[:n]]
    return labels


def likelihood(emit: np.ndarray, lengths: np.ndarray, gold: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels ``gold``, and its slopes: for ``emit``, ``moves``, ``start``.
    Sums over labellings are kept as shares, and what they are shares of apart."""
    steps = Steps(lengths)
    every = np.arange(len(emit))
    top = emit.max(axis=1)
    own, step, begin = np.exp(emit - top[:, None]), np.exp(moves), np.exp(start)
    ahead, after, size = np.zeros(emit.shape), np.ones(emit.shape), np.ones(len(emit))
    for t, at in steps:
        x = own[at] * (begin if t == 0 else ahead[at - 1] @ step)
        size[at] = x.sum(axis=1)
        ahead[at] = x / size[at][:, None]
    for t in range(len(steps.live) - 2, -1, -1):
        at = steps.first[: steps.live[t + 1]] + t
        after[at] = (own[at + 1] * after[at + 1] / size[at + 1][:, None]) @ step.T
    chance = ahead * after
    d_emit = -chance
    d_emit[every, gold] += 1
    follows = np.ones(len(emit), bool)
    follows[steps.first] = False
    at = np.flatnonzero(follows)
    d_moves = -(ahead[at - 1].T @ (own[at] * after[at] / size[at][:, None])) * step
    np.add.at(d_moves, (gold[at - 1], gold[at]), 1)
    d_start = np.bincount(gold[steps.first], minlength=emit.shape[1]) - chance[steps.first].sum(axis=0)
    value = emit[every, gold].sum() + moves[gold[at - 1], gold[at]].sum() + start[gold[steps.first]].sum() - np.log(size).sum() - top.sum()
    return value, d_emit, d_moves, d_start


@dataclass(frozen=True)
class Model:
    """Weights: ``own``, ``left`` and ``right`` have a row for each feature (of the word itself,
    of the word before, of the word after) and a column for each label."""

    labels: tuple[str, ...]
    features: dict[str, int]
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def rows(self, features: Sequence[str]) -> np.ndarray:
        """What a word with these features adds to its own scores, to those of the word after
        it and to those of the word before it; unknown features add nothing."""
        at = [self.features[f] for f in features if f in self.features]
        return np.stack([m[at].sum(axis=0) for m in (self.own, self.left, self.right)])


def joined(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores of each word, from what the words add (words x 3 x labels)."""
    emit = rows[:, 0].copy()
    first = np.zeros(len(rows), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    inner = np.flatnonzero(~first)
    emit[inner] += rows[inner - 1, 1]
    emit[inner - 1] += rows[inner, 2]
    return emit


def train(sentences: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[str]], labels: Sequence[str], rounds: int = 80, penalty: float = 0.02, rate: float = 0.4) -> Model:
    """A model of labelled sentences; each word is given by its features
    (one at least).  Full-batch steps,
    scaled by running moments of the slopes; the same table gives the same model."""
    known: dict[str, int] = {}
    for s in sentences:
        for word in s:
            for f in word:
                known.setdefault(f, len(known))
    k, n = len(labels), len(known)
    lengths = np.array([len(s) for s in sentences], np.int64)
    words = [w for s in sentences for w in s]
    at = np.array([known[f] for w in words for f in w], np.int64)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    number = {y: j for j, y in enumerate(labels)}
    gold = np.array([number[y] for ys in tags for y in ys], np.int64)
    barred, barred_start = np.where(allowed(labels), 0, NEVER), np.where(starts_allowed(labels), 0, NEVER)
    first = np.zeros(len(words), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    inner = np.flatnonzero(~first)
    weights = [np.zeros((n, k)) for _ in range(3)] + [np.zeros((k, k)), np.zeros(k)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    starts = np.flatnonzero(np.diff(of, prepend=-1))  # every word has features, and every feature words
    by_feature = np.argsort(at, kind="stable")
    feature_starts = np.flatnonzero(np.diff(at[by_feature], prepend=-1))
    of_feature = of[by_feature]

    for step in range(1, rounds + 1):
        rows = np.stack([np.add.reduceat(w[at], starts) for w in weights[:3]], axis=1)
        _, d_emit, d_moves, d_start = likelihood(joined(rows, lengths), lengths, gold, weights[3] + barred, weights[4] + barred_start)
        beside = [d_emit, np.zeros_like(d_emit), np.zeros_like(d_emit)]
        beside[1][inner - 1] = d_emit[inner]
        beside[2][inner] = d_emit[inner - 1]
        slopes = [np.add.reduceat(d[of_feature], feature_starts) for d in beside]
        for w, g, m, v in zip(weights, [*slopes, d_moves, d_start], mean, square):
            g = g - penalty * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(tuple(labels), known, *weights[:3], weights[3] + barred, weights[4] + barred_start)
