"""Windows over many codes' dates at once, in numpy: matrices dates x codes, with the results of the windows in ``panel``. NaN is missing.

A window of n dates is merged out of blocks of a power of two dates: their counts, means, and squares and products about the means. So a cell costs the
logarithm of the window, nothing cancels, and a window of equal values has no spread at all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

from shoal.functions.panel import half

Parts = tuple[np.ndarray, ...]


def before(x: np.ndarray, n: int, empty: float = np.nan) -> np.ndarray:
    """Each row's row n dates before; ``empty`` where there is none."""
    out = np.full(x.shape, empty)
    out[n:] = x[: max(len(x) - n, 0)]
    return out


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


class Blocks:
    """What the windows that end at each row hold: ``one`` date's parts, merged with those of the dates before, which have the parts ``empty`` where there are none."""

    def __init__(self, one: Parts, merge: Callable[[Parts, Parts], Parts], empty: tuple[float, ...]) -> None:
        self.levels, self.merge, self.empty, self.held = [one], merge, empty, {}

    def _with(self, late: Parts, early: Parts, n: int) -> Parts:
        """``late``, which holds n dates, and ``early`` of the dates before them."""
        return self.merge(tuple(before(x, n, e) for x, e in zip(early, self.empty, strict=True)), late)

    def over(self, n: int) -> Parts:
        if n < 1:
            raise ValueError(f"a window of {n} dates")
        if n not in self.held:
            while 2 << len(self.levels) - 1 <= n:
                top = self.levels[-1]
                self.levels.append(self._with(top, top, 1 << len(self.levels) - 1))
            found, dates = None, 0
            for k, level in enumerate(self.levels):
                if n >> k & 1:
                    found, dates = level if found is None else self._with(found, level, dates), dates + (1 << k)
            self.held[n] = found
        return self.held[n]


def _moments(a: Parts, b: Parts) -> Parts:
    """(count, mean, sum of squares about it) of the rows of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)  # exactly 0 or 1 where only one side has rows, whose mean then stays as it is
    d = b[1] - a[1]
    return n, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share


def _products(a: Parts, b: Parts) -> Parts:
    """(count, means of x and y, sums of squares of x and y and of products about them) of the rows of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    return n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight


class Series:
    """A matrix, with the blocks that its windows share. Windows give nothing where they hold fewer than half of their dates."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.known = x, ~np.isnan(x)

    @cached_property
    def moments(self) -> Blocks:
        return Blocks((self.known.astype(float), np.where(self.known, self.x, 0.0), np.zeros(self.x.shape)), _moments, (0.0, 0.0, 0.0))

    @cached_property
    def least(self) -> Blocks:
        return Blocks((self.x,), lambda a, b: (np.fmin(a[0], b[0]),), (np.nan,))

    @cached_property
    def most(self) -> Blocks:
        return Blocks((self.x,), lambda a, b: (np.fmax(a[0], b[0]),), (np.nan,))

    def held(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.where(self.moments.over(n)[0] >= half(n), x, np.nan)

    def mean(self, n: int) -> np.ndarray:
        return self.held(self.moments.over(n)[1], n)

    def std(self, n: int) -> np.ndarray:
        count, _, squares = self.moments.over(n)
        return self.held(np.sqrt(ratio(squares, count - 1)), n)  # of no value -1, which ``held`` takes out

    def min(self, n: int) -> np.ndarray:
        return self.held(self.least.over(n)[0], n)

    def max(self, n: int) -> np.ndarray:
        return self.held(self.most.over(n)[0], n)

    def zscore(self, n: int) -> np.ndarray:
        return ratio(self.x - self.mean(n), self.std(n))

    def rank(self, n: int) -> np.ndarray:
        """The share of the window's dates, gaps included, whose value is at most the current one."""
        upto = np.zeros(self.x.shape)
        for k in range(min(n, len(self.x))):
            upto[k:] += self.x[: len(self.x) - k] <= self.x[k:]
        return self.held(upto / np.minimum(np.arange(len(self.x)) + 1, n)[:, None], n)

    def corr(self, other: Series, n: int) -> np.ndarray:
        """Correlation over complete pairs; missing where either side is constant."""
        both = self.known & other.known
        x, y, no = np.where(both, self.x, 0.0), np.where(both, other.x, 0.0), np.zeros(both.shape)
        count, _, _, xx, yy, xy = Blocks((both.astype(float), x, y, no, no, no), _products, (0.0,) * 6).over(n)
        n_1 = count - 1
        out = ratio(ratio(xy, n_1), np.sqrt(ratio(xx, n_1)) * np.sqrt(ratio(yy, n_1)))
        return np.where(count >= max(half(n), 2), out, np.nan)

    def filled(self) -> np.ndarray:
        """The last known value."""
        last = np.maximum.accumulate(np.where(self.known, np.arange(len(self.x))[:, None], 0), axis=0)
        return np.take_along_axis(self.x, last, 0)

    def ref(self, n: int) -> np.ndarray:
        return before(self.x, n)

    def returns(self, n: int) -> np.ndarray:
        """Relative change over n dates of a series whose gaps are filled."""
        return ratio(self.x, before(self.x, n)) - 1

    def ema(self, n: int) -> np.ndarray:
        """The exponential mean of span n, recursive, whose old weight decays over gaps too."""
        alpha = 2 / (n + 1)
        mean, weight, out = np.full(self.x.shape[1], np.nan), np.ones(self.x.shape[1]), np.empty(self.x.shape)
        for t, (x, known) in enumerate(zip(self.x, self.known, strict=True)):
            weight = weight * (1 - alpha)
            later = (weight * mean + alpha * x) / (weight + alpha)
            mean = np.where(known, np.where(np.isnan(mean), x, later), mean)
            weight = np.where(known, 1.0, weight)
            out[t] = mean
        return np.where(np.cumsum(self.known, axis=0) >= half(n), out, np.nan)
