"""Blocks of moments against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import moments, pca


def test_merged_blocks_are_those_of_all_rows():
    rows = np.random.default_rng(2).normal(1e6, 3, (500, 6)) * np.array([1, 10, 0.1, 1, 1, 0])
    whole = moments.block(rows[:0])
    for a, b in ((0, 1), (1, 1), (1, 320), (320, 500)):
        whole = moments.merged(whole, moments.block(rows[a:b]))
    assert whole[0] == 500 and np.allclose(whole[1], rows.mean(0), rtol=1e-13)
    assert np.allclose(whole[2] / 499, np.cov(rows.T), rtol=1e-8, atol=1e-8)


def test_columns_and_arrays_with_unknown_values(spark):
    own = np.random.default_rng(3)
    rows = own.normal(100, 5, (400, 12)).tolist()
    rows[3][4] = float("nan")
    rows[5][0] = None
    rows[7][11] = float("inf")
    good = np.array([r for k, r in enumerate(rows) if k not in (3, 5, 7)])
    names = [f"b{k}" for k in range(12)]
    wide = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} double" for n in names)).repartition(7)
    for table in (wide, wide.select(F.array(*names).alias("s")), wide.select(F.array(*names).alias("s")).union(spark.createDataFrame([(None,)], "s array<double>"))):
        n, mean, cov = moments.covariance(table)
        assert n == 397 and np.allclose(mean, good.mean(0)) and np.allclose(cov, np.cov(good.T))
    n, mean, cov = pca.covariance(wide, names)
    assert n == 397 and np.allclose(mean, good.mean(0)) and np.allclose(cov, np.cov(good.T))
    n, mean, cov = pca.covariance(wide, names[:4], F.col("b1") > 100)
    some = np.array([r for k, r in enumerate(rows) if k not in (3, 5, 7) or k == 7 or k == 3])
    some = np.array([[np.nan if x is None else x for x in r[:4]] for r in rows], float)
    some = some[np.isfinite(some).all(1) & (some[:, 1] > 100)]
    assert n == len(some) and np.allclose(cov, np.cov(some.T))


def test_empty_and_short_tables(spark):
    none = spark.createDataFrame([], "s array<double>")
    assert moments.covariance(none)[0] == 0
    one = spark.createDataFrame([([1.0, 2.0],)], "s array<double>")
    n, mean, cov = moments.covariance(one)
    assert n == 1 and mean.tolist() == [1, 2] and not cov.any()
    names = [f"b{k}" for k in range(10)]
    empty = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    assert pca.covariance(empty, names)[0] == 0
    with pytest.raises(ValueError, match="too few"):
        pca.crosta(empty, names, ["b1"], [])
    with pytest.raises(Exception, match="different lengths"):
        moments.covariance(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "s array<double>").repartition(2))


def test_224_bands_in_one_scan(spark):
    own = np.random.default_rng(5)
    mixed = own.normal(size=(224, 5))
    rows = own.normal(size=(3000, 5)) @ mixed.T + own.normal(0, 0.01, (3000, 224))
    table = spark.createDataFrame([(r.tolist(),) for r in rows], "s array<double>").repartition(8)
    n, mean, cov = moments.covariance(table)
    assert n == 3000 and np.allclose(cov, np.cov(rows.T))
    values, vectors = np.linalg.eigh(cov)
    assert values[-5:].sum() > 0.99 * values.sum()
    scores = np.array([r.scores for r in moments.projected(table, "s", mean, vectors[:, ::-1][:, :5]).collect()])
    assert np.allclose(np.cov(scores.T), np.diag(values[::-1][:5]), atol=1e-8)


def test_projection_of_unknown_spectra(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0])], "id long, s array<double>")
    found = {r.id: r.scores for r in moments.projected(table, "s", [1.0, 1.0], np.eye(2)).collect()}
    assert found == {1: [0.0, 1.0], 2: None, 3: None, 4: None}
