"""Whitening of embeddings: moments merged in a tree over the partitions, eigenvectors on the driver, an identity check by a second pass."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become whole steps of 1 / STEPS.
STEPS = 64
#: Added to an entry's steps, so that they are positive.
OFFSET = 1_000_000
#: Entries beyond so many steps count as that many, which keeps sums within 64 bits.
FARTHEST = 1 << 36
#: Of an entry in the merge tree: as many as this meet in one task, and not many more on the driver.
FAN = 16
#: A component whose variance is a smaller share of the first one's is rounding, and cannot be brought to 1.
LEAST_SHARE = 1e-11
BITS_63 = (1 << 63) - 1


@dataclass
class Moments:
    """Rows seen, their exact sums, their mean and their centred scatter (sums of products of deviations from the mean)."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        """Of one block of rows, centred before anything is multiplied."""
        if not len(rows):
            return cls(0, [], np.zeros(0), np.zeros((0, 0)))
        mean = rows.mean(0)
        centred = rows - mean
        sums = rows.sum(0).tolist() if rows.dtype.kind == "i" else []
        return cls(len(rows), sums, mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Of both blocks: Chan's pairwise formula."""
        if not self.n or not other.n:
            return self if self.n else other
        if len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} entries")
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + apart * (other.n / n), scatter)

    def packed(self) -> pa.RecordBatch:
        values = {"n": [self.n], "sums": [[str(s) for s in self.sums]], "mean": [self.mean.tobytes()], "scatter": [self.scatter.tobytes()]}
        return pa.RecordBatch.from_pydict(values, schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())]))

    @classmethod
    def unpacked(cls, row) -> Moments:
        mean = np.frombuffer(row.mean)
        return cls(row.n, [int(s) for s in row.sums], mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)))


@dataclass
class Whitening:
    """What fit() found. With no components there is nothing to whiten: no vectors, or all the same."""

    n: int
    sums: list[int]  # of the steps without OFFSET
    components: np.ndarray  # a column for each
    variances: np.ndarray
    total: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return (self.variances / self.total).tolist()

    def project(self, steps: np.ndarray) -> np.ndarray:
        return ((steps - self.mean) @ self.components) / np.sqrt(self.variances)

    def deviations(self, steps: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S) ** 2 of each row, None where 63 bits don't hold it."""
        rough = self.n * steps.astype(float) - np.array(self.sums, float)
        small = ((rough**2).sum(1) < 2.0**62) & (np.abs(steps).max(1, initial=0) * float(self.n) < 2.0**62)
        if max(map(abs, self.sums), default=0) >= 1 << 62:
            small[:] = False
        out: list[int | None] = [None] * len(steps)
        sums = np.array(self.sums if small.any() else [0] * len(self.sums), np.int64)
        for k, found in zip(np.flatnonzero(small).tolist(), ((self.n * steps[small] - sums) ** 2).sum(1).tolist(), strict=True):
            out[k] = found
        for k in np.flatnonzero(~small).tolist():
            exact = sum((self.n * x - s) ** 2 for x, s in zip(steps[k].tolist(), self.sums, strict=True))
            out[k] = exact if exact <= BITS_63 else None
        return out


def steps_of(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be used, and their entries in whole steps (floor of STEPS times the entry), a row for each.

    Not used: null and empty vectors, and those with an entry that is null or not finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    used = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    sizes = np.unique(lengths[used])
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} entries")
    width = int(sizes[0]) if len(sizes) else 0
    own = values[np.repeat(used, lengths)].reshape(-1, width) if width else np.zeros((0, 0))
    return used, np.clip(np.floor(own * STEPS), -FARTHEST, FARTHEST).astype(np.int64)


def _tree_moments(vectors: DataFrame, found: Whitening | None = None) -> Moments:
    """The moments of a table's only column of vectors: in steps, or as `found` whitens them. Each partition gives one entry; entries
    meet FAN at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Moments.of(np.zeros((0, 0)))
        for batch in batches:
            steps = steps_of(batch.column(0))[1]
            if len(steps):
                whole = whole.merge(Moments.of(found.project(steps) if found else steps))
        yield whole.packed()

    parts = vectors.mapInArrow(run, "n long, sums array<string>, mean binary, scatter binary").rdd.map(Moments.unpacked)
    if not parts.getNumPartitions():
        return Moments.of(np.zeros((0, 0)))
    depth = max(2, math.ceil(math.log(parts.getNumPartitions(), FAN)))
    return parts.treeReduce(Moments.merge, depth)


def fit(rows: DataFrame, vector_col: str = "embedding", most: int = 32) -> Whitening:
    """The mean and the first `most` principal components of all usable vectors' steps, by falling variance (divisor n).

    First pass: each partition has its count, exact sums, local mean and centred scatter, which a tree merges by Chan's formula, so
    that no large sums of squares cancel; the driver gets about FAN matrices of d * d numbers and finds the eigenvectors. Second pass:
    the covariance of the whitened vectors, merged alike; identity_error is its largest distance from the identity.

    Each eigenvector's sign is such that its largest entry is positive. Components with less than LEAST_SHARE of the first one's
    variance, which rank-deficient or few vectors leave, are left out. Vectors of different lengths raise an error; entries beyond
    FARTHEST steps count as FARTHEST. An empty table, or one whose vectors are all alike, has no components.
    """
    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    whole = _tree_moments(vectors)
    if not whole.n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    covariance = whole.scatter / whole.n
    variances, components = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-variances, kind="stable")[:most]
    variances, components = variances[order], components[:, order]
    real = variances > LEAST_SHARE * max(variances[0], 0)
    variances, components = variances[real], components[:, real]
    largest = np.abs(components).argmax(0)
    components = components * np.sign(components[largest, np.arange(len(variances))])
    found = Whitening(whole.n, whole.sums, components, variances, float(np.trace(covariance)), 0.0)
    if len(variances):
        again = _tree_moments(vectors, found)
        found.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(variances))).max())
    return found


def whiten(rows: DataFrame, found: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, deviation (long: the exact sum over dimensions of (n * x - S) ** 2, with x an entry's steps plus OFFSET and S the sum of
    x over all vectors; null beyond 63 bits) and whitened (array<double>, an entry for each component) of each usable vector.

    Null ids stay, repeated rows have a row each, other columns do not pass. Vectors must be as long as those fitted on."""
    kind = rows.schema[id_col].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            used, steps = steps_of(batch.column(1))
            if not len(steps):
                continue
            if steps.shape[1] != len(own.sums):
                raise ValueError(f"vectors of {steps.shape[1]} entries, fitted on {len(own.sums)}")
            flat = own.project(steps)
            offsets = np.arange(len(steps) + 1, dtype=np.int32) * flat.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).filter(pa.array(used)), "deviation": pa.array(own.deviations(steps), pa.int64()), "whitened": lists})

    chosen = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)
