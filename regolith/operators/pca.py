"""Principal components of bands: covariance in one scan, the small eigenproblem on the driver, projection as a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.bands import finite
from regolith.operators import moments

#: Bands up to which one aggregate in the JVM gives all covariances; more would make a plan of their number squared.
FEW_BANDS = 8


@dataclass
class Component:
    mean: list[float]
    loadings: np.ndarray  # a column for each component, the largest variance first
    index: int
    sign: int


def covariance(df: DataFrame, bands: Sequence[str], sample: Column | None = None) -> tuple[int, list[float], np.ndarray]:
    """Rows, means and sample covariances over rows where all bands are known: by one aggregate for up to FEW_BANDS bands, by blocks of
    moments (see operators.moments) for more."""
    rows = df if sample is None else df.where(sample)
    rows = rows.select(*[finite(F.col(b).cast("double")).alias(b) for b in bands])
    if len(bands) > FEW_BANDS:
        n, mean, out = moments.covariance(rows)
        return (n, mean.tolist(), out) if n else (0, [0.0] * len(bands), np.zeros((len(bands), len(bands))))
    rows = rows.dropna()
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    got = rows.agg(F.count("*").alias("n"), *[F.avg(b) for b in bands], *[F.covar_samp(bands[i], bands[j]) for i, j in pairs]).first()
    out = np.zeros((len(bands), len(bands)))
    for (i, j), v in zip(pairs, got[1 + len(bands) :], strict=True):
        out[i, j] = out[j, i] = v if v is not None else 0.0
    return got.n, list(got[1 : 1 + len(bands)]), out


def votes(loading: np.ndarray, bands: Sequence[str], positive: Sequence[str], negative: Sequence[str]) -> int:
    """Wanted signs that a component has, less those it has not; a loading of 0 has none."""
    at = dict(zip(bands, loading, strict=True))
    return sum(1 if at[b] > 0 else -1 for b in positive if b in at) + sum(1 if at[b] < 0 else -1 for b in negative if b in at)


def crosta(df: DataFrame, bands: Sequence[str], positive: Sequence[str], negative: Sequence[str], sample: Column | None = None) -> Component:
    """The component whose signs fit best, of equals the one of larger variance, turned so that what is wanted is high."""
    n, mean, cov = covariance(df, bands, sample)
    if n < len(bands) + 1:
        raise ValueError(f"{n} rows are too few for {len(bands)} bands")
    _, vectors = np.linalg.eigh(cov)
    loadings = vectors[:, ::-1]
    scores = [votes(loadings[:, k], bands, positive, negative) for k in range(len(bands))]
    best = int(np.argmax(np.abs(scores)))
    return Component(mean, loadings, best, -1 if scores[best] < 0 else 1)


def projection(component: Component, bands: Sequence[str]) -> Column:
    parts = [(F.col(b) - m) * float(v) for b, m, v in zip(bands, component.mean, component.loadings[:, component.index], strict=True)]
    return sum(parts[1:], parts[0]) * component.sign
