"""Spectral unmixing: endmembers from extreme pixels, non-negative abundances, natural exposures."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.operators.stats import between_quantiles, quantiles_of
from regolith.session import staged


#: Pixels with all scores below which the last score's pixels are taken instead.
LEAST_VALID = 30


def endmembers(pixels: DataFrame, bands: Sequence[str], scores: dict[str, Column], share: float = 0.02, least: int = 5, roi: Column | None = None) -> DataFrame:
    """name and mean band values of the pixels with the highest scores: a share of the valid ones with that score, `least` at least.

    Valid are pixels (in the region) with all scores; where they are fewer than LEAST_VALID, all pixels with the last score, which
    is the brightness. A score that no valid pixel has gives the mean of all valid ones. The threshold of each score is its exact
    quantile, all found together, so pixels are filtered, not sorted in one task; of pixels that tie at the threshold those with
    the smallest (y, x) count. Scores are worked out once and written, as each scan would take its formulas anew.
    """
    inside = F.lit(True) if roi is None else F.coalesce(roi, F.lit(False))
    known = pixels.select("y", "x", *bands, inside.alias("_inside"), *[score.alias(f"s_{name}") for name, score in scores.items()])
    scored = staged(known, "scored")
    every = functools.reduce(lambda a, b: a & b, [F.col(f"s_{name}").isNotNull() for name in scores], F.col("_inside"))
    last = F.col(f"s_{list(scores)[-1]}").isNotNull()
    valid = scored.where(every)
    counted = scored.agg(F.count_if(every).alias("valid"), *[F.count_if(last & F.col(f"s_{name}").isNotNull()).alias(name) for name in scores]).first()
    numbers = dict.fromkeys(scores, counted.valid)
    if counted.valid < LEAST_VALID:
        valid, numbers = scored.where(last), {name: counted[name] for name in scores}
    take = {name: min(n, max(least, int(n * share))) for name, n in numbers.items()}
    limits = quantiles_of(valid, {name: (F.col(f"s_{name}"), [(n - take[name]) / max(1, n - 1)]) for name, n in numbers.items() if n})
    out = []
    for name in scores:
        picked = valid
        if take[name]:
            s, limit = F.col(f"s_{name}"), limits[name][0]
            sure, near = s > limit + abs(limit) * 1e-12, F.abs(s - limit) <= abs(limit) * 1e-12
            known = valid.where(sure | near)
            over = known.agg(F.count_if(sure)).first()[0]
            picked = known.where(sure).unionByName(known.where(near).orderBy("y", "x").limit(take[name] - over))
        out.append(picked.agg(*[F.avg(b).alias(b) for b in bands]).select(F.lit(name).alias("name"), *bands))
    return functools.reduce(DataFrame.unionByName, out)


#: Members up to which every set of them is tried.
FEW_MEMBERS = 4


def solve(spectra: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Non-negative least squares for many spectra (rows) and members (columns), exactly: by every set of members where they are few,
    else by active sets."""
    return _every_set(spectra, members) if members.shape[1] <= FEW_MEMBERS else _active_sets(spectra, members)


def _together(products: np.ndarray, right: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Least squares of each row over its own free members; rows with the same ones are solved together."""
    out = np.zeros_like(right)
    patterns, which = np.unique(free, axis=0, return_inverse=True)
    which = which.ravel()
    for k, pattern in enumerate(patterns):
        own = np.flatnonzero(pattern)
        if len(own):
            rows = np.flatnonzero(which == k)
            out[np.ix_(rows, own)] = right[np.ix_(rows, own)] @ np.linalg.pinv(products[np.ix_(own, own)], hermitian=True)
    return out


def _active_sets(spectra: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active sets for all rows side by side: of each row the member that would lessen the residual most is freed;
    where a free one turns negative, the row goes back to where the first of them meets zero and holds it there. A row is done when no
    held member would help."""
    products, right = members.T @ members, spectra @ members
    n, k = right.shape
    found, free = np.zeros((n, k)), np.zeros((n, k), bool)
    least = 1e-12 * max(1.0, float(np.abs(products).max(initial=0))) * np.maximum(1.0, np.abs(spectra).max(1, initial=0))
    open_ = np.arange(n)
    for _ in range(30 * k):
        gain = right[open_] - found[open_] @ products
        gain[free[open_]] = -np.inf
        best = gain.argmax(1)
        helps = gain[np.arange(len(open_)), best] > least[open_]
        open_, best = open_[helps], best[helps]
        if not len(open_):
            break
        free[open_, best] = True
        rows = open_
        while len(rows):
            new = _together(products, right[rows], free[rows])
            below = free[rows] & (new <= 0)
            good = ~below.any(1)
            found[rows[good]] = new[good]
            rows, new, below = rows[~good], new[~good], below[~good]
            if not len(rows):
                break
            old = found[rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(below, old / (old - new), np.inf)
            step = np.nan_to_num(step, nan=0.0, posinf=np.inf).min(1)
            moved = old + step[:, None] * (new - old)
            # What has met zero is held there: the members whose step was least, and whatever rounding left at or below zero.
            ratio = np.where(below, old / np.where(below, old - new, 1), np.inf)
            free[rows] &= ~(below & ((ratio <= step[:, None]) | (moved <= 0)))
            found[rows] = np.where(free[rows], np.maximum(moved, 0), 0)
    return found


def _every_set(spectra: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Every set of members is solved for all rows at once, and each row takes the non-negative solution of least residual, with
    2 ** members solves."""
    n, k = len(spectra), members.shape[1]
    best, error = np.zeros((n, k)), (spectra**2).sum(1)
    for size in range(1, k + 1):
        for own in itertools.combinations(range(k), size):
            part = members[:, own]
            a = spectra @ np.linalg.pinv(part).T
            rest = ((spectra - a @ part.T) ** 2).sum(1)
            good = (a >= 0).all(1) & (rest < error - 1e-15)
            best[good] = 0
            best[np.ix_(good, own)] = a[good]
            error[good] = rest[good]
    return best


def _dot(a: Sequence, b: Sequence):
    """The products' sum from the first to the last, whatever the machine's own matrix routines do."""
    return functools.reduce(lambda total, own: total + own[0] * own[1], zip(a[1:], b[1:], strict=True), a[0] * b[0])


def _determinant(m: Sequence[Sequence]):
    """By the first row, of numbers or of columns of them."""
    if len(m) == 1:
        return m[0][0]
    parts = [(-m[0][k] if k % 2 else m[0][k]) * _determinant([[v for c, v in enumerate(row) if c != k] for row in m[1:]]) for k in range(len(m))]
    return functools.reduce(lambda a, b: a + b, parts)


def solve_by_products(spectra: np.ndarray, members: np.ndarray) -> np.ndarray:
    """What solve() finds for few members, from the products of members and spectra alone, by Cramer's rule: the arithmetic that a database
    can do, operation for operation, so that both round alike. Where members are nearly dependent it keeps about half the digits."""
    k, e, x = members.shape[1], members.T, spectra.T
    g = [[_dot(e[i], e[j]) for j in range(k)] for i in range(k)]
    h, square = [_dot(e[i], x) for i in range(k)], _dot(x, x)
    best, least = np.zeros((len(spectra), k)), np.full(len(spectra), np.inf)
    for size in range(1, k + 1):
        for own in itertools.combinations(range(k), size):
            whole, a = _determinant([[g[i][j] for j in own] for i in own]), np.zeros((k, len(spectra)))
            for j in own:
                with np.errstate(divide="ignore", invalid="ignore"):
                    a[j] = _determinant([[h[i] if c == j else g[i][c] for c in own] for i in own]) / whole
            rest = square - 2 * _dot(a, h)
            for i, j in itertools.product(range(k), repeat=2):
                rest = rest + a[i] * a[j] * g[i][j]
            good = (a >= 0).all(0) & (rest < least)
            best[good], least[good] = a.T[good], rest[good]
    return best


Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]


def unmix(pixels: DataFrame, bands: Sequence[str], members: np.ndarray, names: Sequence[str], keys: Sequence[str] = ("y", "x"), sum_to_one: bool = True, solver: Solver = solve) -> DataFrame:
    """keys, the abundance of each member and rmse, for pixels with all bands known. members: bands by members, a matrix of any number of
    members that goes out with the tasks. solver: solve, or solve_by_products for what SQL gives to the last digit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(bands))])
            known = np.isfinite(x).all(1)
            x, batch = x[known], batch.filter(pa.array(known))
            a = solver(x, members)
            total = functools.reduce(np.add, a.T)[:, None]
            if sum_to_one:
                a = np.where(total > 1e-9, a / np.where(total > 1e-9, total, 1), a)
            off = [(_dot(a.T, own) - value) ** 2 for own, value in zip(members, x.T, strict=True)]
            rmse = np.sqrt(functools.reduce(np.add, off) / len(off))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(a[:, i].copy()) for i in range(a.shape[1])), pa.array(rmse)], names=[*keys, *names, "rmse"])

    rows = pixels.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands])
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in (*names, "rmse")])
    return rows.mapInArrow(run, schema)


def summary(unmixed: DataFrame) -> DataFrame:
    """n_unmixed and mean_rmse (null for none) of unmix()'s pixels."""
    return unmixed.agg(F.count("*").alias("n_unmixed"), F.avg("rmse").alias("mean_rmse"))


def exposure(ndvi: Column, bsi: Column, ndvi_max: float = 0.25, bsi_min: float = 0.0) -> Column:
    """Whether a pixel is bare ground; false where an index is unknown."""
    return F.coalesce((ndvi < ndvi_max) & (bsi > bsi_min), F.lit(False))


def exposure_score(df: DataFrame, ndvi: Column, bsi: Column) -> Column:
    parts = between_quantiles(df, {"bsi": bsi, "ndvi": ndvi})
    return parts["bsi"] * (1 - parts["ndvi"])


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
