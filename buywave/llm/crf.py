"""Linear-chain conditional random field with two labels, over many sequences at once.

Sequences lie one after the other in flat arrays. All sequences advance together, longest first,
so a step costs one vector operation however many sequences there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of a fitted field. ``emission`` has one row per feature and one column per label."""

    mean: np.ndarray
    scale: np.ndarray
    emission: np.ndarray
    transition: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return with_bias(x) @ self.emission

    def to_dict(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("mean", "scale", "emission", "transition")}

    @classmethod
    def from_dict(cls, stored: dict) -> Chain:
        return cls(**{k: np.asarray(v, dtype=np.float64) for k, v in stored.items()})


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def steps(lengths: np.ndarray) -> list[np.ndarray]:
    """For each position, the flat rows of the sequences that reach it, longest sequence first."""
    lengths = np.asarray(lengths, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    reach = np.searchsorted(-lengths, -np.arange(lengths[0]) if len(lengths) else [], side="left")
    return [starts[:n] + t for t, n in enumerate(reach)]


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(scores: np.ndarray, transition: np.ndarray, rows: list[np.ndarray]):
    """Log forward and backward messages and the log normaliser of each row's sequence."""
    ahead = scores.copy()
    for before, now in zip(rows, rows[1:]):
        last = ahead[before[: len(now)]]
        ahead[now] += _log_add(last[:, :1] + transition[0], last[:, 1:] + transition[1])
    back = np.zeros_like(scores)
    for now, after in zip(rows[-2::-1], rows[:0:-1]):
        nxt = scores[after] + back[after]
        back[now[: len(after)]] = _log_add(nxt[:, :1] + transition[:, 0], nxt[:, 1:] + transition[:, 1])
    both = ahead + back
    return ahead, back, _log_add(both[:, 0], both[:, 1])


def marginals(scores: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of label 1 at each row."""
    if not len(scores):
        return np.zeros(0)
    ahead, back, total = forward_backward(scores, transition, steps(lengths))
    return np.exp(ahead[:, 1] + back[:, 1] - total)


def viterbi(scores: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Most likely labels, sequence by sequence; ties go to label 0."""
    if not len(scores):
        return np.zeros(0, dtype=np.int64)
    rows = steps(lengths)
    best = scores.copy()
    come_from = np.zeros(scores.shape, dtype=np.int64)
    for before, now in zip(rows, rows[1:]):
        ways = best[before[: len(now)]][:, :, None] + transition
        come_from[now] = ways.argmax(axis=1)
        best[now] += ways.max(axis=1)
    labels = best.argmax(axis=1)
    for now, after in zip(rows[-2::-1], rows[:0:-1]):
        labels[now[: len(after)]] = come_from[after, labels[after]]
    return labels


def fit(
    features: np.ndarray,
    labels: np.ndarray,
    lengths: np.ndarray,
    l2: float = 1e-3,
    rounds: int = 100,
    rate: float = 0.2,
) -> Chain:
    """Maximum likelihood with an L2 penalty, by full-batch Adam steps. Deterministic.

    Without any row the field is undecided: every marginal is one half.
    """
    width = features.shape[1]
    if not len(features):
        return Chain(np.zeros(width), np.ones(width), np.zeros((width + 1, 2)), np.zeros((2, 2)))
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = with_bias((features - mean) / scale)
    rows = steps(lengths)
    truth = np.eye(2)[labels]
    seen_pairs = np.zeros((2, 2))
    for before, now in zip(rows, rows[1:]):
        np.add.at(seen_pairs, (labels[before[: len(now)]], labels[now]), 1)
    weights = np.zeros((width + 1) * 2 + 4)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = len(x)
    for k in range(1, rounds + 1):
        emission, transition = weights[:-4].reshape(-1, 2), weights[-4:].reshape(2, 2)
        scores = x @ emission
        ahead, back, total = forward_backward(scores, transition, rows)
        believed = np.exp(ahead + back - total[:, None])
        pairs = np.zeros((2, 2))
        for before, now in zip(rows, rows[1:]):
            before = before[: len(now)]
            joint = ahead[before][:, :, None] + transition + (scores[now] + back[now])[:, None, :]
            pairs += np.exp(joint - total[now][:, None, None]).sum(axis=0)
        slope = np.concatenate([(x.T @ (believed - truth)).ravel(), (pairs - seen_pairs).ravel()]) / n + l2 * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        weights = weights - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Chain(mean, scale, weights[:-4].reshape(-1, 2), weights[-4:].reshape(2, 2))
