"""Whitening against numpy and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from regolith.llm import queries, whitening


def exact(vectors):
    """Steps with the offset, their exact covariance, and the exact deviations."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    centred = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    d = len(sums)
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    return np.array(centred, float) / n, covariance, [sum(a * a for a in row) for row in centred]


def test_merged_moments_are_those_of_all_rows():
    rows = np.random.default_rng(1).integers(10**6, 10**6 + 50, (1000, 5))
    cuts = [0, 1, 1, 400, 403, 1000]
    whole = whitening.Moments.of(rows[:0])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        whole = whole.merge(whitening.Moments.of(rows[a:b]))
    assert whole.n == 1000 and whole.sums == rows.sum(0).tolist()
    assert np.allclose(whole.mean, rows.mean(0), rtol=1e-14)
    assert np.allclose(whole.scatter, np.cov(rows.T, bias=True) * 1000, rtol=1e-8, atol=1e-3)
    with pytest.raises(ValueError, match="5 and of 4"):
        whole.merge(whitening.Moments.of(rows[:, :4]))


def test_query_op12(spark):
    path = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    usable = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    centred, covariance, deviations = exact([v for _, v in usable])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = queries.op12_whitening(spark, path).collect()
    assert len(found) == 32 * len(usable)
    by = {(r.vec_id, r.component): r for r in found}
    for k in range(32):
        wanted = centred @ vectors[:, k] / math.sqrt(values[k])
        own = np.array([by[i, k + 1].whitened for i, _ in usable])
        assert np.abs(own - wanted * np.sign(own @ wanted)).max() < 1e-8
        assert math.isclose(by[usable[0][0], k + 1].explained, values[k] / values.sum(), rel_tol=1e-9)
    assert [by[i, 1].deviation for i, _ in usable] == deviations
    assert {r.n for r in found} == {len(usable)}
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 0.0], "x"), (2, [-0.25, 2.0, 0.0], "x"), (2, [-0.25, 2.0, 0.0], "x"), (None, [0.1, 0.3, 0.0], "x"), (4, None, "x"), (5, [0.1, None, 0.2], "x"), (6, [0.1, nan, 0.2], "x"), (7, [inf, 0.0, 0.1], "x"), (8, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, deviation string").repartition(3)
    found = whitening.fit(table)
    # The third entry never varies, so two components have any variance.
    assert found.n == 4 and len(found.variances) == 2 and found.identity_error < 1e-12
    out = whitening.whiten(table, found).collect()
    assert sorted(r.vec_id or -1 for r in out) == [-1, 1, 2, 2] and all(len(r.whitened) == 2 for r in out)
    centred, _, deviations = exact([np.float32(v).tolist() for _, v, _ in rows[:4]])
    assert sorted(r.deviation for r in out) == sorted(deviations)
    assert whitening.fit(table.limit(0)).n == 0
    none = whitening.fit(table.where("vec_id = 2"))
    assert none.n == 2 and len(none.variances) == 0
    assert [r.whitened for r in whitening.whiten(table.where("vec_id = 2"), none).collect()] == [[], []]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_whitening(spark, str(tmp_path)).count() == 0


def test_far_entries_and_large_deviations():
    steps = np.array([[1 << 36, 0], [0, 5], [-7, 1 << 36]], np.int64)
    sums = [sum(c) for c in zip(*steps.tolist(), strict=True)]
    own = whitening.Whitening(3, sums, np.eye(2), np.ones(2), 2.0, 0.0)
    wanted = [sum((3 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in steps.tolist()]
    assert own.deviations(steps) == [w if w < 1 << 63 else None for w in wanted]
    near = np.array([[1000, -3], [999, 4], [1000, 2]], np.int64)
    own.sums = near.sum(0).tolist()
    assert own.deviations(near) == [sum((3 * a - s) ** 2 for a, s in zip(row, own.sums, strict=True)) for row in near.tolist()]


def test_small_variances_far_from_zero_are_kept(spark):
    own = np.random.default_rng(5)
    wide = np.stack([own.normal(9000, 1000, 500), own.normal(-7000, 0.5, 500), own.normal(0, 20, 500)], 1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<double>").repartition(7)
    found = whitening.fit(table)
    assert len(found.variances) == 3 and found.variances[0] / found.variances[2] > 1e6 and found.identity_error < 1e-9


def test_different_lengths_raise(spark):
    table = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="vectors of"):
        whitening.fit(table)
