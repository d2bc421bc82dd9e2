"""Means and covariances of wide rows in one scan: blocks of moments that merge, for cubes of hundreds of bands."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that meet in one task on their way to the driver, which gets about as many.
FAN = 16

Block = tuple[int, np.ndarray, np.ndarray]  # rows, their mean, sums of products of deviations from it


def block(rows: np.ndarray) -> Block:
    """The moments of rows (a column for each band). They are centred first, so large means lose no digits."""
    width = rows.shape[1]
    if not len(rows):
        return 0, np.zeros(width), np.zeros((width, width))
    mean = rows.mean(0)
    apart = rows - mean
    return len(rows), mean, apart.T @ apart


def merged(a: Block, b: Block) -> Block:
    """The moments of the rows of both: each mean shifts to the common one."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch in which every value is a finite number: of columns of numbers, or of one column of lists of equal length."""
    if pa.types.is_list(batch.schema.types[0]):
        lists = batch.column(0).drop_null()
        if not len(lists):
            return np.zeros((0, 0))
        sizes = np.diff(lists.offsets.to_numpy())
        if (sizes != sizes[0]).any():
            raise ValueError("spectra of different lengths")
        out = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), int(sizes[0]))
    else:
        out = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.zeros((0, batch.num_columns))
    return out[np.isfinite(out).all(1)]


def covariance(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample covariances (divisor n - 1) over the rows without unknown values: of columns of numbers, or of one column
    of arrays. One scan; a task holds one block of K * K numbers for K bands, and blocks are merged in a tree, so the driver gets
    about FAN of them. Zeros for fewer than two rows; arrays of different lengths raise an error."""
    values = rows.select(*[F.col(f"`{c}`").cast("array<double>" if kind.startswith("array") else "double") for c, kind in rows.dtypes])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: Block | None = None
        for batch in batches:
            own = matrix(batch)
            if len(own):
                whole = block(own) if whole is None else _checked(whole, block(own))
        if whole is not None:
            yield pa.RecordBatch.from_pydict({"n": [whole[0]], "mean": [whole[1].tobytes()], "products": [whole[2].tobytes()]})

    parts = values.mapInArrow(run, "n long, mean binary, products binary").rdd.map(_unpacked)
    empty: Block = (0, np.zeros(0), np.zeros((0, 0)))
    count = parts.getNumPartitions()
    n, mean, products = parts.treeAggregate(empty, _checked, _checked, max(2, math.ceil(math.log(max(2, count), FAN))))
    return n, mean, products / max(1, n - 1)


def _unpacked(row) -> Block:
    mean = np.frombuffer(row.mean)
    return row.n, mean, np.frombuffer(row.products).reshape(len(mean), len(mean))


def _checked(a: Block, b: Block) -> Block:
    if a[0] and b[0] and len(a[1]) != len(b[1]):
        raise ValueError("spectra of different lengths")
    return merged(a, b)


def projected(rows: DataFrame, spectrum: str, mean: Sequence[float], loadings: np.ndarray, into: str = "scores") -> DataFrame:
    """rows with the scores of each spectrum on the components (columns of loadings) as an array; null where the spectrum is null or has
    an unknown value."""
    sent = rows.sparkSession.sparkContext.broadcast((np.asarray(mean, float), np.asarray(loadings, float)))

    @F.arrow_udf("array<double>")
    def scores(lists: pa.Array) -> pa.Array:
        own, components = sent.value
        known = lists.is_valid().to_numpy(zero_copy_only=False)
        values = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(own))
        out = (values - own) @ components
        good = np.zeros(len(lists), bool)
        good[known] = np.isfinite(values).all(1)
        flat = np.zeros((len(lists), components.shape[1]))
        flat[known] = out
        offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * components.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()), mask=pa.array(~good))

    return rows.withColumn(into, scores(F.col(spectrum).cast("array<double>")))
