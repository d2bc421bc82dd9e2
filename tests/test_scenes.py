"""Statistics scene by scene against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import scenes


def made_up(seed=1):
    own = random.Random(seed)
    rows = []
    for scene, n in [("a", 700), ("b", 90), ("c", 1), ("d", 2), (None, 60), ("ties", 400), ("same", 50), ("empty", 5), ("wide", 300)]:
        for k in range(n):
            v = {"ties": float(own.choice([1, 2, 2, 2, 3])), "same": 4.25, "empty": None, "wide": 10 ** own.uniform(-8, 8)}.get(scene, own.gauss(3, 2))
            rows.append((scene, k, v, own.choice([None, -1.0, own.random()])))
    rows += [("a", -1, float("nan"), 1.0), ("b", -2, float("inf"), 1.0), ("b", -3, float("-inf"), float("nan")), ("empty", -4, float("nan"), None)]
    own.shuffle(rows)
    return rows


def groups(rows, column):
    out = {}
    for r in rows:
        v = r[column]
        out.setdefault(r[0], [])
        if v is not None and math.isfinite(v):
            out[r[0]].append(v)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = made_up()
    return rows, spark.createDataFrame(rows, "scene string, k long, v double, w double").repartition(5).cache()


@pytest.mark.parametrize("small", [scenes.SMALL, 60])
def test_quantiles_against_numpy(table, monkeypatch, small):
    rows, df = table
    monkeypatch.setattr(scenes, "SMALL", small)
    if small == 60:
        monkeypatch.setattr(scenes, "BRACKET", 0.05)
    shares = [0.0, 0.02, 0.5, 0.95, 1.0]
    found = {r.scene: r for r in scenes.quantiles_by(df, ["scene"], {"v": (F.col("v"), shares), "n": (F.col("w"), [0.25])}).collect()}
    for column, name, wanted in ((2, "v", shares), (3, "n", [0.25])):
        for scene, values in groups(rows, column).items():
            own = found[scene]
            assert own[f"n_{name}"] == len(values)
            assert own[name] == ([None] * len(wanted) if not values else pytest.approx(np.quantile(values, wanted).tolist(), rel=1e-12))
    assert len(found) == 9


def test_thresholds_and_anomalies(table):
    rows, df = table
    for method in ("mean_std", "median_mad", "percentile"):
        limits = {}
        for scene, v in groups(rows, 2).items():
            limits[scene] = None
            if v:
                middle = np.median(v)
                limits[scene] = {"mean_std": np.mean(v) + 2 * np.std(v), "median_mad": middle + 2 * 1.4826 * np.median(np.abs(np.array(v) - middle)), "percentile": np.percentile(v, 95)}[method]
        found = scenes.anomalies(df, ["scene"], {"v": F.col("v")}, method).collect()
        assert len(found) == len(rows)
        for r in found:
            limit = limits[r.scene]
            assert (r.v_threshold is None) == (limit is None) and (limit is None or math.isclose(r.v_threshold, limit, rel_tol=1e-9))
            if limit is not None and r.v is not None and math.isfinite(r.v) and abs(r.v - limit) > 1e-9 * max(1, abs(limit)):
                assert r.v_over == (r.v > limit)
            if r.v is None or not math.isfinite(r.v):
                assert not r.v_over
    with pytest.raises(ValueError, match="unknown"):
        scenes.thresholds(df, ["scene"], {"v": F.col("v")}, "other")


def test_a_region_bounds_what_counts(table):
    rows, df = table
    found = scenes.anomalies(df, ["scene"], {"v": F.col("v")}, "percentile", roi=F.col("k") < 40)
    for scene, values in groups([r for r in rows if r[1] < 40], 2).items():
        own = found.where(F.col("scene").eqNullSafe(scene)).collect()
        assert all(math.isclose(r.v_threshold, np.percentile(values, 95), rel_tol=1e-12) for r in own) if values else all(r.v_threshold is None for r in own)
        assert all(r.k < 40 for r in own if r.v_over)
    ratios = {r.scene: r.v for r in scenes.anomaly_ratios(found, ["scene"], {"v": (F.col("v_over"), F.col("v"))}, roi=F.col("k") < 40).collect()}
    for scene in ratios:
        own = [r for r in found.collect() if r.scene == scene]
        assert ratios[scene] == sum(r.v_over for r in own) / max(1, sum(r.k < 40 for r in own))


def test_stretches(table):
    rows, df = table
    plain, shown = groups(rows, 2), groups(rows, 3)
    for r in scenes.between_quantiles(df, ["scene"], {"out": F.col("v")}).collect():
        v = plain[r.scene]
        low, high = np.quantile(v, [0.02, 0.98]) if v else (0, 0)
        if high - low < 1e-9:
            assert r.out == 0
        elif r.v is None or not math.isfinite(r.v):
            assert r.out is None
        else:
            assert math.isclose(r.out, min(max((r.v - low) / (high - low), 0), 1), rel_tol=1e-9, abs_tol=1e-12)
    for r in scenes.stretched(df, ["scene"], {"out": F.col("w")}, gamma=0.5).collect():
        positive = [x for x in shown[r.scene] if x > 0]
        if r.w is None or not math.isfinite(r.w) or not positive:
            assert r.out == 0
        else:
            low, high = np.quantile(positive, [0.02, 0.98])
            assert math.isclose(r.out, min(max((r.w - low) / max(high - low, 1e-6), 0), 1) ** 0.5, rel_tol=1e-9, abs_tol=1e-12)


def test_proximity(table):
    rows, df = table
    plain = groups(rows, 2)
    for r in scenes.proximity(df, ["scene"], F.abs("v")).collect():
        own = [abs(x) for x in plain[r.scene]]
        scale = (np.median(own) if own else 0) or 1.0
        assert math.isclose(r.proximity, math.exp(-abs(r.v) / (scale + 1e-9)) if r.v is not None and math.isfinite(r.v) else 0.0, rel_tol=1e-9, abs_tol=1e-300)


def test_soft_over(table):
    rows, df = table
    limits = scenes.thresholds(df, ["scene"], {"threshold": F.col("v")}, "percentile")
    by = {r.scene: r.threshold for r in limits.collect()}
    plain = groups(rows, 2)
    for r in scenes.soft_over(df, ["scene"], F.col("v"), limits).collect():
        limit = by[r.scene]
        if limit is None or r.v is None or not math.isfinite(r.v):
            assert r.soft == 0
            continue
        over = [x for x in plain[r.scene] if x > limit]
        top = np.quantile(over, 0.95) if over else max(plain[r.scene])
        assert math.isclose(r.soft, min(max((r.v - limit) / max(top - limit, 1e-6), 0), 1), rel_tol=1e-9, abs_tol=1e-12)


def test_three_scans(spark, tmp_path):
    """Whatever the number of scenes and layers, the table is read three times."""
    log = str(tmp_path / "log")

    def read(batches):
        n = 0
        for batch in batches:
            n += batch.num_rows
            yield batch
        with open(log, "a") as file:
            file.write(f"{n}\n")

    rows = spark.range(3000).selectExpr("id % 50 AS scene", "id * 1.0D AS v", "id % 7 * 1.0D AS w").coalesce(2)
    seen = rows.mapInArrow(read, "scene long, v double, w double")
    found = scenes.quantiles_by(seen, ["scene"], {"v": (F.col("v"), [0.02, 0.98]), "w": (F.col("w"), [0.5])})
    assert found.count() == 50 and sum(map(int, open(log).read().split())) == 3 * 3000


def test_many_scenes_and_empty_tables(spark, tmp_path):
    many = spark.range(200_000).select((F.col("id") % 10_000).alias("scene"), F.col("id").cast("double").alias("v"))
    many.write.parquet(f"{tmp_path}/many")
    found = scenes.quantiles_by(spark.read.parquet(f"{tmp_path}/many"), ["scene"], {"v": (F.col("v"), [0.5])})
    assert found.count() == 10_000
    assert found.where(F.abs(F.col("v")[0] - (F.col("scene") + 95_000)) > 1e-9).count() == 0
    none = many.limit(0)
    assert scenes.quantiles_by(none, ["scene"], {"v": (F.col("v"), [0.5])}).count() == 0
    assert scenes.anomalies(none, ["scene"], {"v": F.col("v")}, "median_mad").count() == 0
