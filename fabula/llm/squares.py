"""Online detection of repetitions in a sequence of words by catchers over completed power-of-two blocks.

A square is a stretch of words written twice in a row; its period q is the length of the first half. Words are appended
in batches of any size. As soon as a block [s, s + b) is complete, b a power of two at a multiple of b, a catcher waits for
the same b words at distances from 2b to 4b: wherever a square of such a period lies, its first half of at least 2b words
holds a whole block, and the block comes back one period later. The window of the last b appended words is
compared with the blocks whose catchers are open, by hashes that prefix sums give in constant time. A caught pair
is compared word by word to both sides: to the left once, to the right as far as words have been appended; from then on each append
advances the comparison of that suffix, until a word differs. A stretch of matches at distance q with at least q of
them is a square, and all squares of one period that touch merge into the one run that the stretch spans.

Blocks of BASE words stand for all periods below 4 * BASE: what is reported has at least least_length words, so that also a
run of a short period has 2 * BASE - 1 matches and holds a block. The result doesn't depend on how the words were dealt into appends.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np

BASE = 8
#: An odd multiplier of the window hashes; caught pairs are compared word by word, so a collision costs time only.
FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(FACTOR, -1, 1 << 64)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Distinct ids as distinct scattered 64-bit values: each step is a bijection."""
    z = ids.astype(np.uint64) + np.uint64(FACTOR)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Powers:
    """FACTOR ** i and its inverse modulo 2 ** 64, as far as any text of this process needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        have = len(cls.up)
        if have < n:
            steps = max(n, 2 * have, 1 << 14) - have
            for name, f in (("up", FACTOR), ("down", _INVERSE)):
                old = getattr(cls, name)
                setattr(cls, name, np.concatenate([old, old[-1] * np.cumprod(np.full(steps, f, np.uint64))]))


def _same_for(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal elements before the first difference; looks at ever longer pieces, so it costs what it returns."""
    n, at, step = len(a), 0, 64
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, 2 * step
    return n


class Catchers:
    """append() words, then finish(): the runs of at least least_length words and least_exponent periods."""

    def __init__(self, least_length: int = 24, least_exponent: int = 3):
        if least_exponent < 2 or least_length < least_exponent or any(max(least_length - q, (least_exponent - 1) * q) < 2 * BASE - 1 for q in range(1, 2 * BASE)):
            raise ValueError(f"runs of {least_length} words and {least_exponent} periods need not hold a block of {BASE} words")
        self.least_length, self.least_exponent = least_length, least_exponent
        self.n = 0
        self._x, self._sums = np.empty(64, np.uint64), np.zeros(65, np.uint64)
        self._looked: dict[int, int] = {}  # block size: the windows before this start have met the blocks
        self._open: dict[int, list[int]] = {}  # period: start and end of the matches that reach the last word
        self._runs: dict[tuple[int, int], int] = {}  # start and end: smallest period
        self._known: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends of its squares' runs

    def append(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        old, self.n = self.n, self.n + len(ids)
        self._grow()
        _Powers.reach(self.n + 1)
        self._x[old : self.n] = _mixed(ids)
        np.cumsum(self._x[old : self.n] * _Powers.up[old : self.n], out=self._sums[old + 1 : self.n + 1])
        self._sums[old + 1 : self.n + 1] += self._sums[old]
        for q in sorted(self._open):
            self._advance(q)
        b = BASE
        while self.least_exponent * (1 if b == BASE else 2 * b) <= self.n:
            self._catch(b)
            b *= 2

    def finish(self) -> list[Run]:
        for q, (left, right) in sorted(self._open.items()):
            self._close(q, left, right)
        self._open.clear()
        return sorted(Run(a, e - a, q) for (a, e), q in self._runs.items())

    def _grow(self) -> None:
        if self.n > len(self._x):
            size = max(self.n, 2 * len(self._x))
            self._x = np.concatenate([self._x, np.empty(size - len(self._x), np.uint64)])
            self._sums = np.concatenate([self._sums, np.zeros(size + 1 - len(self._sums), np.uint64)])

    def _hashes(self, start: int, stop: int, b: int, step: int = 1) -> np.ndarray:
        """The hashes of the windows of b words at start, start + step and so on before stop."""
        return (self._sums[start + b : stop + b : step] - self._sums[start:stop:step]) * _Powers.down[start:stop:step]

    def _advance(self, q: int) -> None:
        left, right = self._open[q]
        right += _same_for(self._x[right : self.n - q], self._x[right + q : self.n])
        self._open[q][1] = right
        if right < self.n - q:
            del self._open[q]
            self._close(q, left, right)

    def _close(self, q: int, left: int, right: int) -> None:
        """Matches at [left, right) with what follows q words later have ended: a run, if they hold a square."""
        length = right - left + q
        if right - left < q:
            return
        starts, ends = self._known.setdefault(q, ([], []))
        at = bisect_right(starts, left)
        starts.insert(at, left)
        ends.insert(at, left + length)
        if length >= max(self.least_length, self.least_exponent * q):
            span = (left, left + length)
            self._runs[span] = min(q, self._runs.get(span, q))

    def _catch(self, b: int) -> None:
        """Lets the windows of b words that have become complete meet the blocks whose catchers are open."""
        low, high = (1, 4 * b) if b == BASE else (2 * b, 4 * b)
        first, stop = max(self._looked.get(b, 0), low), self.n - b + 1
        if first >= stop:
            return
        self._looked[b] = stop
        windows, p = self._hashes(first, stop, b), np.arange(first, stop)
        lowest = max(0, (first - high) // b)
        blocks = self._hashes(lowest * b, (stop - low) // b * b + 1, b, b)
        nearest = (p - low) // b
        caught = []
        for back in range(-(-(high - low) // b)):
            j = nearest - back
            hit = np.flatnonzero((windows == blocks[np.maximum(j - lowest, 0)]) & (j >= lowest))
            s = j[hit] * b
            q = p[hit] - s
            keep = q < high
            caught.append((s[keep], q[keep]))
        s, q = (np.concatenate(x) for x in zip(*caught, strict=True))
        if len(s):
            self._compare(*self._unexplained(s, q, b), b)

    def _unexplained(self, s: np.ndarray, q: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Without the pairs inside a run whose period divides q: their run is that run."""
        known = [(d, *spans) for d, spans in self._known.items()] + [(d, [a], [e + d]) for d, (a, e) in self._open.items() if e - a >= d]
        for d, starts, ends in known:
            if not len(s):
                break
            at = np.searchsorted(starts, s, "right") - 1
            inside = (at >= 0) & (np.asarray(ends)[at] >= s + q + b) & (q % d == 0) & (q > d)
            s, q = s[~inside], q[~inside]
        return s, q

    def _compare(self, s: np.ndarray, q: np.ndarray, b: int) -> None:
        order = np.lexsort((s, q))
        x, n, done = self._x, self.n, (0, 0)
        for at, lag in zip(s[order].tolist(), q[order].tolist(), strict=True):
            if done[0] == lag and at < done[1] or lag in self._open and at >= self._open[lag][0]:
                continue
            if not np.array_equal(x[at : at + b], x[at + lag : at + lag + b]):
                continue
            left = at - _same_for(x[:at][::-1], x[lag : at + lag][::-1])
            right = at + b + _same_for(x[at + b : n - lag], x[at + b + lag : n])
            done = (lag, right)
            if right == n - lag:
                self._open[lag] = [left, right]
            else:
                self._close(lag, left, right)


def runs_of(ids: np.ndarray, least_length: int = 24, least_exponent: int = 3, batch: int = 1 << 15) -> list[Run]:
    """The runs of a sequence of ids, by start, then period; ids are appended batch by batch."""
    if len(ids) < least_length:
        return []
    c = Catchers(least_length, least_exponent)
    for i in range(0, len(ids), batch):
        c.append(ids[i : i + batch])
    return c.finish()
