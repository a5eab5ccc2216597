"""Bounded samples of labelled rows, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(key: str, count: int) -> Column:
    """crc32 of a key as text, modulo `count`: the fold of a row. A null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % count, F.lit(0))


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` of the rows, or all; which ones depends on the key alone.

    The choice is by hash, with the rate taken from an exact count, so the sample is as
    large for a table of any size.
    """
    total = rows.count()
    if total <= most:
        return rows
    parts = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(parts)) < int(parts * most / total))


def logistic(features: np.ndarray, labels: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method; they are pulled towards `prior`."""
    x = np.hstack([features, np.ones((len(features), 1))])
    weights = prior.astype(float).copy()
    pull = np.full(len(weights), strength)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - chance) - pull * (weights - prior)
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights
