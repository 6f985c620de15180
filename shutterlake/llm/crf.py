"""A linear-chain conditional random field on hashed features, in numpy batches.

Sequences of a batch are stepped through together, longest first, so that step
t works on all sequences of more than t words at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """emit: [features, states]; move: [states, states], from row to column."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """[words, states] from [words, k] feature numbers."""
        out = self.emit[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += self.emit[features[:, k]]
        return out


def _plan(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
    return first, size, alive


def overlapped(first: np.ndarray, size: np.ndarray, core: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Long sequences as pieces of ``core`` entries with ``side`` more around them.

    (entry of each place in the pieces, first place and size of each piece,
    whether a place is in its piece's core). An entry is in one core, and what
    a chain says of it depends on entries over ``side`` away by a factor that
    falls exponentially, so the pieces answer as the whole would.
    """
    n = -(-size // core)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.repeat(first, n), np.repeat(first + size, n)
    start = low + nth * core
    stop = np.minimum(start + core, high)
    a, b = np.maximum(start - side, low), np.minimum(stop + side, high)
    held = b - a
    place = np.cumsum(held) - held
    entry = np.arange(held.sum()) + np.repeat(a - place, held)
    return entry, place, held, (entry >= np.repeat(start, held)) & (entry < np.repeat(stop, held))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def forward_backward(chain: Chain, score: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, backward, log partition function by word)."""
    first, size, alive = _plan(first, size)
    fore, back, total = score.copy(), np.zeros_like(score), np.zeros(len(score), score.dtype)
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        fore[at] += _log_sum(fore[at - 1][:, :, None] + chain.move[None], 1)
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        back[at] = _log_sum(chain.move[None] + (score[at + 1] + back[at + 1])[:, None, :], 2)
    z = _log_sum(fore[first + size - 1], 1) if len(first) else np.zeros(0)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    total[np.repeat(first, size) + nth] = np.repeat(z, size)
    return np.exp(fore + back - total[:, None]), fore, back, total


def viterbi(chain: Chain, score: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best state of each word."""
    first, size, alive = _plan(first, size)
    best, came = score.copy(), np.zeros(score.shape, np.int8)
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        ways = best[at - 1][:, :, None] + chain.move[None]
        came[at] = ways.argmax(axis=1)
        best[at] += ways.max(axis=1)
    out = np.zeros(len(score), np.int8)
    last = first + size - 1
    out[last] = best[last].argmax(axis=1)
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        out[at - 1] = came[at, out[at]]
    return out


def train(features: np.ndarray, tags: np.ndarray, first: np.ndarray, size: np.ndarray, n_features: int, n_states: int, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3, start: Chain | None = None) -> Chain:
    """Maximum likelihood by full-batch Adam with weight decay, from ``start`` on; deterministic."""
    chain = Chain(np.zeros((n_features, n_states)), np.zeros((n_states, n_states)))
    if start is not None:
        chain = Chain(start.emit.astype(np.float64), start.move.astype(np.float64))
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (chain.emit, chain.move)]
    inner = np.ones(len(tags), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    one = np.zeros((len(tags), n_states))
    one[np.arange(len(tags)), tags] = 1
    seen_move = np.zeros_like(chain.move)
    np.add.at(seen_move, (tags[inner - 1], tags[inner]), 1)
    for n in range(1, rounds + 1):
        score = chain.scores(features)
        marginal, fore, back, total = forward_backward(chain, score, first, size)
        gap = one - marginal
        slope = np.zeros_like(chain.emit)
        for k in range(features.shape[1]):
            for s in range(n_states):
                slope[:, s] += np.bincount(features[:, k], gap[:, s], n_features)
        pair = np.exp(fore[inner - 1][:, :, None] + chain.move[None] + (score[inner] + back[inner])[:, None, :] - total[inner][:, None, None])
        slopes = (slope / max(1, len(tags)) - decay * chain.emit / max(1, len(tags)), (seen_move - pair.sum(axis=0)) / max(1, len(tags)))
        for w, g, (m, v) in zip((chain.emit, chain.move), slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-9)
    return Chain(chain.emit.astype(np.float32), chain.move.astype(np.float32))
