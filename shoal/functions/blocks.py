"""One date's cross-section as a matrix, codes x factors, in numpy: average ranks, rank coefficients, correlations of pairs. NaN is missing."""

from __future__ import annotations

import numpy as np


def ranks(x: np.ndarray) -> np.ndarray:
    """The average rank of each value in its column, from 1; NaN where there is none."""
    out = np.full(x.shape, np.nan, order="F")
    for k in range(x.shape[1]):
        known = np.flatnonzero(~np.isnan(x[:, k]))
        v = x[known, k]
        o = np.argsort(v)
        s = v[o]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        size = np.diff(np.r_[first, len(s)])
        out[known[o], k] = np.repeat(first + (size + 1) / 2, size)
    return out


def standard(r: np.ndarray) -> np.ndarray:
    """Columns less their mean, of length 1; NaN for constant ones."""
    r = r - r.mean(0)
    size = np.sqrt((r * r).sum(0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 1e-12, r / size, np.nan)


def rank_ic(x: np.ndarray, y: np.ndarray, masked: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, coefficient) of each column with ``y``: ranks over the rows where both are known or, ``masked``, each side's own."""
    n, out = np.zeros(x.shape[1], np.int64), np.full(x.shape[1], np.nan)
    own_x, own_y = (ranks(x), ranks(y[:, None])[:, 0]) if masked else (x, y)
    for columns, rows in classes(~np.isnan(x) & ~np.isnan(y)[:, None]):
        n[columns] = rows.sum()
        if rows.sum() > 1:
            a, b = own_x[np.ix_(rows, columns)], own_y[rows, None]
            a, b = (a, b) if masked else (ranks(a), ranks(b))
            out[columns] = standard(b).T[0] @ standard(a)
    return n, out


def classes(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, rows) of the columns that share a mask."""
    found: dict[bytes, list[int]] = {}
    for k, own in enumerate(np.ascontiguousarray(np.packbits(mask, axis=0).T)):
        found.setdefault(own.tobytes(), []).append(k)
    return [(np.array(columns), mask[:, columns[0]]) for columns in found.values()] if mask.size else []


def ranks_of(x: np.ndarray, order: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``ranks(x[rows][:, columns])`` from the order of all rows of ``x``, without sorting again; those values are known."""
    place = np.cumsum(rows) - 1
    out = np.empty((rows.sum(), len(columns)), order="F")
    for k, c in enumerate(columns.tolist()):
        o = order[:, c]
        o = o[rows[o]]
        s = x[o, c]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        out[place[o], k] = np.repeat(first + (size + 1) / 2, size)
    return out


def correlate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that both have, correlation of the ranks over these) of each column of ``a`` with each of ``b``; rows are the same codes.

    Columns are sorted once. Those with one mask are multiplied at once; ranks are taken again only over the rows that two different masks share, and of
    the pairs of a matrix with itself, once for both orders.
    """
    n, out = np.zeros((a.shape[1], b.shape[1]), np.int64), np.full((a.shape[1], b.shape[1]), np.nan)
    own = a is b
    a = np.asfortranarray(a)
    b = a if own else np.asfortranarray(b)
    order_a = np.asfortranarray(np.argsort(a, axis=0))
    order_b = order_a if own else np.asfortranarray(np.argsort(b, axis=0))
    left = classes(~np.isnan(a))
    right = left if own else classes(~np.isnan(b))
    for k, (mine, rows) in enumerate(left):
        held: dict[bytes, np.ndarray] = {}
        for other, more in right[k if own else 0 :]:
            both = rows & more
            at = np.ix_(mine, other)
            n[at] = both.sum()
            if both.sum() > 1:
                key = both.tobytes()
                if key not in held:
                    held[key] = standard(ranks_of(a, order_a, mine, both)).T
                out[at] = held[key] @ (held[key].T if own and other is mine else standard(ranks_of(b, order_b, other, both)))
            if own:
                n[np.ix_(other, mine)], out[np.ix_(other, mine)] = n[at].T, out[at].T
    return n, out
