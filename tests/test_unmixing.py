"""Unmixing with many members, against the conditions that a non-negative least-squares solution meets."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import unmixing


def checked(spectra, members, found, within=1e-7):
    gain = (spectra - found @ members.T) @ members
    scale = np.maximum(1, np.abs(spectra).max(1, keepdims=True)) * max(1, np.abs(members).max()) * len(members)
    assert (found >= 0).all()
    assert (gain <= within * scale).all()  # no member that is held at zero would help
    assert (np.abs(gain * (found > 0)) <= within * scale).all()  # free members are where they should be


@pytest.mark.parametrize(("bands", "members"), [(60, 20), (224, 30), (10, 5), (8, 12), (6, 6)])
def test_optimality(bands, members):
    own = np.random.default_rng(members)
    m = np.abs(own.normal(1, 0.5, (bands, members)))
    true = own.random((800, members)) * (own.random((800, members)) < 0.3)
    spectra = true @ m.T + own.normal(0, 0.02, (800, bands))
    spectra[:50] = own.normal(0, 1, (50, bands))
    spectra[50] = 0
    found = unmixing.solve(spectra, m)
    checked(spectra, m, found)
    assert not found[50].any()
    if bands > members:
        assert np.allclose(unmixing.solve(true @ m.T, m), true, atol=1e-6)


def test_both_ways_agree():
    own = np.random.default_rng(3)
    m = np.abs(own.normal(1, 0.5, (7, 4)))
    spectra = own.normal(1, 1, (500, 7))
    assert np.allclose(unmixing._every_set(spectra, m), unmixing._active_sets(spectra, m), atol=1e-9)


def test_members_that_repeat():
    own = np.random.default_rng(5)
    m = np.abs(own.normal(1, 0.5, (20, 6)))
    m = np.column_stack([m, m[:, 0], 2 * m[:, 1], m[:, 2] + m[:, 3]])
    spectra = own.random((300, 9)) @ m.T
    found = unmixing.solve(spectra, m)
    checked(spectra, m, found, 1e-6)
    assert np.allclose(found @ m.T, spectra, atol=1e-6)


def test_unmix_with_twenty_members(spark):
    own = np.random.default_rng(7)
    bands, names = [f"b{k}" for k in range(40)], [f"m{k}" for k in range(20)]
    m = np.abs(own.normal(1, 0.5, (40, 20)))
    true = own.random((500, 20)) * (own.random((500, 20)) < 0.2)
    rows = [(k, *map(float, r)) for k, r in enumerate(true @ m.T)] + [(1000, *[None] * 40), (1001, *[float("nan")] * 40)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{b} double" for b in bands)).repartition(3)
    began = time.time()
    found = unmixing.unmix(df, bands, m, names, keys=["k"], sum_to_one=False).orderBy("k").collect()
    assert time.time() - began < 60 and len(found) == 500
    assert np.allclose([[r[n] for n in names] for r in found], true, atol=1e-6) and max(r.rmse for r in found) < 1e-6
    assert unmixing.summary(unmixing.unmix(df.where(F.col("k") > 900), bands, m, names, keys=["k"])).first().n_unmixed == 0


def test_scores_of_endmembers_are_worked_out_once(spark):
    from regolith.plans import pixel_queries

    found = pixel_queries.endmembers(spark, "/root/testdata/sf0.001")
    assert "get_json_object" not in found._jdf.queryExecution().toString()  # no scan after the first takes the bands' formulas again


def test_few_members_round_like_sql_where_bands_are_large(spark, tmp_path):
    # 75,000 pixels: means of 1,500 members never lie midway between two rounded ones, where the order of addition would tell.
    import duckdb

    from regolith.plans import pixel_queries

    con = duckdb.connect()
    con.execute(f"COPY (SELECT e.* REPLACE (event_id + g * 10000 AS event_id, user_id + g * 1500 AS user_id) FROM '/root/testdata/sf0.01/events.parquet' e, range(8) r(g) WHERE event_id + g * 10000 < 75000) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    expected = con.execute(pixel_queries._unmix_sql()).fetchall()
    found = [tuple(r) for r in pixel_queries.unmix_nnls(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
