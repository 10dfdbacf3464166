"""Lloyd-Max codebooks for a coordinate of a random unit vector.

All of it is small driver-side work that depends on the dimension and the bits
alone, so it is done once a process."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

GRID = 100_000


def density(x: np.ndarray, d: int) -> np.ndarray:
    """Density on (-1, 1) of one coordinate of a uniform unit vector in d dimensions; flat below 3."""
    if d < 3:
        return np.full_like(x, 0.5, dtype=float)
    log_scale = math.lgamma(d / 2) - math.lgamma((d - 1) / 2) - math.log(math.pi) / 2
    return np.exp(log_scale + (d - 3) / 2 * np.log1p(-np.minimum(x * x, 1 - 1e-9)))


@cache
def _mass(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid, and cumulated weight and first moment before each grid point."""
    x = np.linspace(-1, 1, GRID + 2)[1:-1]
    w = density(x, d)
    return x, np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([[0.0], np.cumsum(w * x)])


@cache
def centroids(d: int, bits: int, rounds: int = 500, tolerance: float = 1e-10) -> tuple[float, ...]:
    """The 2^bits levels of least mean squared error, ascending.

    Each round puts a level at the mean of its cell; an empty cell's goes to the
    middle of the cell."""
    x, weight, moment = _mass(d)
    n = 1 << bits
    levels = -1 + (2 * np.arange(n) + 1) / n
    for _ in range(rounds):
        cuts = np.concatenate([[-1.0], (levels[1:] + levels[:-1]) / 2, [1.0]])
        at = np.searchsorted(x, cuts)
        at[0], at[-1] = 0, len(x)
        mass = np.diff(weight[at])
        means = np.where(mass > 1e-300, np.diff(moment[at]) / np.where(mass > 1e-300, mass, 1), (cuts[1:] + cuts[:-1]) / 2)
        moved = float(np.abs(means - levels).max())
        levels = means
        if moved < tolerance:
            break
    return tuple(map(float, levels))


def boundaries(levels: tuple[float, ...]) -> tuple[float, ...]:
    """Midpoints of neighbouring levels."""
    return tuple((a + b) / 2 for a, b in zip(levels, levels[1:], strict=False))


def expected_error(d: int, bits: int) -> float:
    """Mean squared error of a coordinate under the codebook, by integration over the grid."""
    x, _, _ = _mass(d)
    w = density(x, d)
    levels = np.array(centroids(d, bits))
    nearest = levels[np.searchsorted(np.array(boundaries(tuple(levels))), x)]
    return float((w * (x - nearest) ** 2).sum() / w.sum())


@cache
def rotation(d: int, seed: int) -> tuple[tuple[float, ...], ...]:
    """A random rotation: the orthogonal factor of a Gaussian matrix, its first column
    negated if it would mirror. Stored with the codes, since linear-algebra
    libraries differ in signs."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return tuple(tuple(map(float, row)) for row in q)
