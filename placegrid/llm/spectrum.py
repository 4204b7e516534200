"""Eigendecompositions of scatter matrices kept up to date by rank-one updates: secular equations with deflation."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def secular_roots(poles: np.ndarray, weights: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + scale * sum(weights / (poles - x)), one after each of the rising ``poles``; weights add up to one.

    Given as the matrix ``away`` of pole - root (a row for each root), exact to rounding even where a root is next to
    a pole, and the roots. A rational step through the two poles around a root is taken as long as it stays inside
    the bracket, which is halved otherwise.
    """
    m = len(poles)
    upper = np.append(poles[1:], poles[-1] + scale)
    width = upper - poles
    k = np.arange(m)

    def value(from_pole, at):
        return 1 + scale * (weights / (from_pole - at[:, None])).sum(axis=1)

    lower_half = value(poles[None, :] - poles[:, None], width / 2) > 0
    origin = np.where(lower_half | (k == m - 1), k, np.minimum(k + 1, m - 1))
    from_pole = poles[None, :] - poles[origin][:, None]
    low = np.where(lower_half, 0.0, np.where(k == m - 1, width / 2, -width / 2))
    high = np.where(lower_half, width / 2, np.where(k == m - 1, width * (1 + 4 * _EPS), 0.0))
    at = (low + high) / 2
    below = k[None, :] <= k[:, None]
    for _ in range(120):
        away = from_pole - at[:, None]
        terms = scale * weights / away
        f = 1 + terms.sum(axis=1)
        open_ = (np.abs(f) > 4 * m * _EPS * (1 + np.abs(terms).sum(axis=1))) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        slopes = terms / away
        left, slope = np.where(below, slopes, 0.0).sum(axis=1), slopes.sum(axis=1)
        right = slope - left
        d1, d2 = away[k, k], away[k, np.minimum(k + 1, m - 1)]
        with np.errstate(all="ignore"):
            c = f - d1 * left - d2 * right
            a = (d1 + d2) * f - d1 * d2 * slope
            b = d1 * d2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = d1[-1] + left[-1] * d1[-1] ** 2 / (f[-1] - left[-1] * d1[-1])
            new = at + step
            inside = (new > low) & (new < high)
        at = np.where(open_, np.where(inside, new, (low + high) / 2), at)
    return from_pole - at[:, None], poles[origin] + at


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) after ``row`` times its transpose is added.

    Deflation leaves as they are the pairs that the row hardly touches; of values that are the same to rounding all but
    one are turned out of its way by a reflection.
    """
    z = vectors.T @ row
    scale = float(z @ z)
    if scale == 0:
        return values, vectors
    z = z / np.sqrt(scale)
    small = 8 * _EPS * max(float(np.abs(values).max()), scale)
    vectors = vectors.copy()
    first = 0
    while first < len(values):
        last = int(np.searchsorted(values, values[first] + small, "right"))
        if last - first > 1 and np.count_nonzero(z[first:last]) > 1:
            own = z[first:last].copy()
            length = np.sqrt(own @ own)
            mirror = own.copy()
            mirror[-1] += np.copysign(length, own[-1])
            mirror /= np.sqrt(mirror @ mirror)
            group = vectors[:, first:last]
            vectors[:, first:last] = group - 2 * np.outer(group @ mirror, mirror)
            z[first:last] = 0
            z[last - 1] = -np.copysign(length, own[-1])
        first = last
    active = np.flatnonzero(scale * np.abs(z) > small)
    if not len(active):
        return values, vectors
    poles, parts = values[active], z[active]
    away, roots = secular_roots(poles, parts ** 2 / (parts @ parts), scale * float(parts @ parts))
    # The weights for which these roots are exact, so that the vectors are orthogonal to rounding.
    gaps = np.abs(poles[None, :] - poles[:, None]) + np.eye(len(poles))
    size = np.exp((np.log(np.maximum(np.abs(away), 1e-300)).sum(axis=0) - np.log(gaps).sum(axis=0)) / 2)
    turn = (np.copysign(size, parts)[None, :] / away).T
    turn /= np.sqrt((turn ** 2).sum(axis=0))
    values = values.copy()
    values[active], vectors[:, active] = roots, vectors[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Rows seen, their mean, and the eigenpairs of their centred scatter matrix."""

    def __init__(self, size: int):
        self.rows, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, row: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def add_rows(self, rows: np.ndarray) -> None:
        """Takes in rows: those of the triangle that has the same centred scatter, then the way between the means."""
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        for row in np.linalg.qr(rows - mean, mode="r"):
            self.add(row)
        self._move(len(rows), mean)

    def merge(self, rows: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in another spectrum: each of its eigenpairs is a rank-one update, and so is the way between the means."""
        if not rows:
            return
        if not self.rows:
            self.rows, self.mean, self.values, self.vectors = rows, mean, values, vectors
            return
        for value, vector in zip(values, vectors.T):
            if value > 0:
                self.add(np.sqrt(value) * vector)
        self._move(rows, mean)

    def _move(self, rows: int, mean: np.ndarray) -> None:
        whole = self.rows + rows
        self.add(np.sqrt(self.rows * rows / whole) * (mean - self.mean))
        self.mean = self.mean + (mean - self.mean) * (rows / whole)
        self.rows = whole
