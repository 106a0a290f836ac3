"""A discrete hidden Markov model over many sequences at once.

Sequences are sorted by length and walked in lockstep, one symbol of each a step, so every step is a
few matrix operations however many sequences there are.  The recursions are scaled and exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 16


@dataclass
class Hmm:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state, next state]
    emit: np.ndarray  # [symbol, state]

    @staticmethod
    def random(states: int, frequency: np.ndarray, seed: int = 5) -> Hmm:
        """Near the symbols' overall frequency, with states drawn apart."""
        rng = np.random.default_rng(seed)
        move = rng.random((states, states)) + 4 * np.eye(states)
        emit = (frequency + 1e-9)[:, None] * np.exp(rng.normal(0, 1, (len(frequency), states)))
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Counts:
    """Expected starts, moves and emissions, and the log likelihood they were taken at."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @staticmethod
    def zero(states: int, symbols: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def model(self, frequency: np.ndarray, prior: float = 1.0) -> Hmm:
        """The maximising model; a little of the overall frequency keeps every symbol possible."""
        emit = self.emit + prior * (frequency + 1e-7)[:, None]
        move, start = self.move + 0.01, self.start + 0.01
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _lockstep(symbols: np.ndarray, starts: np.ndarray):
    """Sequences by falling length, how many are live at each step, and where each step's entries lie."""
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    longest = int(size[order[0]]) if len(order) else 0
    live = np.searchsorted(-size[order], -np.arange(longest), "left")
    return order, live, starts[:-1][order]


def _places(live: np.ndarray, base: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry of these steps: its sequence's rank by length and its place among the symbols."""
    n = live[begin:end]
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return rank, base[rank] + np.repeat(np.arange(begin, end), n)


def _ahead(model: Hmm, a: np.ndarray, live: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Makes emissions of steps their scaled forward probabilities, in place, from those of the step before; the scales and the last step's."""
    scale, ones, at = np.empty(len(a)), np.ones(len(model.start)), 0
    for n in live.tolist():
        x, c = a[at : at + n], scale[at : at + n]
        x *= model.start if last is None else last[:n] @ model.move
        np.matmul(x, ones, out=c)
        x /= c[:, None]
        last, at = x, at + n
    return scale, last


def forward(model: Hmm, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The natural log likelihood of each sequence ``symbols[starts[i]:starts[i + 1]]``."""
    out = np.zeros(len(starts) - 1)
    order, live, base = _lockstep(symbols, starts)
    total = np.zeros(len(order))
    ends, last, begin = np.cumsum(live), None, 0
    while begin < len(live):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        rank, place = _places(live, base, begin, end)
        scale, last = _ahead(model, model.emit[symbols[place]], live[begin:end], last)
        total += np.bincount(rank, np.log(scale), len(total))
        begin = end
    out[order] = total
    return out


def baum_welch(model: Hmm, symbols: np.ndarray, starts: np.ndarray, into: Counts) -> None:
    """Adds the sequences' expected counts."""
    order, live, base = _lockstep(symbols, starts)
    if not len(live):
        return
    symbol = symbols[_places(live, base, 0, len(live))[1]]
    e = model.emit[symbol]
    a = e.copy()
    scale, _ = _ahead(model, a, live)
    into.log_likelihood += float(np.log(scale).sum())
    e /= scale[:, None]
    b, back = np.ones_like(e), model.move.T.copy()
    at = len(e)
    sizes = live.tolist()
    for t in range(len(sizes) - 1, 0, -1):
        n = sizes[t]
        at -= n
        to = at - sizes[t - 1]
        np.matmul(e[at : at + n] * b[at : at + n], back, out=b[to : to + n])
    e *= b
    before = np.arange(live[0], len(e)) - np.repeat(live[:-1], live[1:])
    for k in range(0, len(before), BLOCK):
        some = before[k : k + BLOCK]
        into.move += a[some].T @ e[live[0] + k : live[0] + k + len(some)] * model.move
    a *= b
    into.start += a[: live[0]].sum(0)
    for k in range(len(model.start)):
        into.emit[:, k] += np.bincount(symbol, a[:, k], len(into.emit))


def pair_counts(model: Hmm, joint: np.ndarray, before: np.ndarray, after: np.ndarray, times: np.ndarray, into: Counts) -> None:
    """Adds the expected counts of neighbouring symbols, ``times`` each, whose states have probability ``joint[state, next state]``.

    ``before`` is -1 where ``after`` is a sequence's first symbol.
    """
    first = before < 0
    a, b, n = before[~first], after[~first], times[~first]
    left, right = model.emit[a], model.emit[b]
    ahead = left @ joint
    p = (ahead * right).sum(1)
    w = right * (n / p)[:, None]
    into.move += joint * (left.T @ w)
    begin = model.emit[after[first]] * model.start
    q = begin.sum(1)
    begin *= (times[first] / q)[:, None]
    into.start += begin.sum(0)
    into.log_likelihood += float(n @ np.log(p) + times[first] @ np.log(q))
    symbol, gamma = np.concatenate([a, b, after[first]]), np.concatenate([left * (w @ joint.T), ahead * w, begin])
    for k in range(len(model.start)):
        into.emit[:, k] += np.bincount(symbol, gamma[:, k], len(into.emit))
