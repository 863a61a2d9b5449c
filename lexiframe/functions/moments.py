"""Count, mean and scatter of vectors, part by part; numpy only, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np


class Moments(NamedTuple):
    n: int
    mean: np.ndarray
    # The sum of (x - mean) (x - mean)^T.
    scatter: np.ndarray


def moments(block: np.ndarray) -> Moments:
    """The moments of the rows of ``block``."""
    mean = block.mean(axis=0)
    apart = block - mean
    return Moments(len(block), mean, apart.T @ apart)


def merged(parts: Iterable[Moments]) -> Moments | None:
    """The moments of all parts together, without the loss of digits of plain sums of squares; None without parts."""
    out = None
    for part in parts:
        if out is None:
            out = part
            continue
        if part.mean.shape != out.mean.shape:
            raise ValueError("vectors differ in length")
        n, step = out.n + part.n, part.mean - out.mean
        scatter = out.scatter + part.scatter + np.outer(step, step) * (out.n * part.n / n)
        out = Moments(n, out.mean + step * (part.n / n), scatter)
    return out


def points_of(m: Moments) -> np.ndarray:
    """A few points that have the mean and the sample covariance of all the vectors."""
    values, vectors = np.linalg.eigh(m.scatter / (m.n - 1))
    d = len(values)
    away = vectors.T * np.sqrt(np.maximum(values, 0.0) * (2 * d - 1) / 2)[:, None]
    return np.concatenate([m.mean + away, m.mean - away])
