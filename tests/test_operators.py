"""Operators against plain numpy, on made-up arrays with gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.functions import bands, coordinates, text
from regolith.operators import batch, deformation, evidence, grid, knowledge, pca, runs, spatial, stats, unmixing
from regolith.plans import catalog


def image(spark, layers, scene="s"):
    names = list(layers)
    height, width = next(iter(layers.values())).shape
    rows = [(scene, y, x, *[None if not np.isfinite(layers[n][y, x]) else float(layers[n][y, x]) for n in names]) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "scene string, y int, x int, " + ", ".join(f"{n} double" for n in names))


def test_formulas(spark):
    px = spark.createDataFrame([(1.0, 2.0), (1.0, 1e-6), (1.0, -1e-5), (3.0, 0.0), (None, 1.0)], "B1 double, B8A double")
    known = {"B1": F.col("B1"), "B8A": F.col("B8A")}
    assert [r[0] for r in px.select(bands.band_expression("+B1/B8A", known)).collect()] == [0.5, None, pytest.approx(-1e5), None, None]
    assert px.select(bands.band_expression("-(B1-2)*3+B8A/2", known)).first()[0] == 4.0
    for bad in ("B1**2", "abs(B1)", "B1.real", "B2/B1", "1+2", "B1<2", "B1 if B1 else 2", "B1;", "", "True*B1", "__import__('os')", "R(2.10)"):
        with pytest.raises(ValueError):
            bands.band_expression(bad, known)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_by_brackets(spark, n):
    values = np.round(np.random.default_rng(n).normal(size=n) * 3, 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    wanted = np.percentile(values, [0, 2, 33.3, 50, 98, 100])
    for direct in (5, 10_000):
        assert np.allclose(stats.quantiles(df, F.col("v"), [0, 0.02, 0.333, 0.5, 0.98, 1], direct), wanted)
    assert stats.quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_thresholds(spark):
    v = np.random.default_rng(1).normal(size=400)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 3, "v double")
    middle = np.median(v)
    wanted = {"mean_std": v.mean() + 2 * v.std(), "percentile": np.percentile(v, 95), "median_mad": middle + 2 * 1.4826 * np.median(np.abs(v - middle))}
    for method, limit in wanted.items():
        assert stats.threshold(df, F.col("v"), method) == pytest.approx(limit)
    assert stats.threshold(df.limit(0), F.col("v")) is None and df.select(F.count_if(stats.over(F.col("v"), None))).first()[0] == 0
    with pytest.raises(ValueError):
        stats.threshold(df, F.col("v"), "other")


def test_layers_overlap_in_prospectivity(spark):
    own = np.random.RandomState(7)
    layers = {"alteration": own.rand(80, 80) * 0.05, "veg_stress": own.rand(80, 80) * 0.1, "structure": np.zeros((80, 80)), "deformation": np.full((80, 80), np.nan)}
    layers["veg_stress"][30:45, 30:45] = 0.9
    layers["structure"][35:50, 28:42] = 0.8
    px = image(spark, layers)
    score, used = evidence.fuse(px, {n: F.col(n) for n in layers})
    assert "deformation" not in used and sum(used.values()) == pytest.approx(1)
    scored = px.withColumn("score", score)
    limit = stats.quantiles(scored, F.col("score"), [0.92])[0]
    hit = scored.withColumn("hit", F.col("score") >= limit)
    share = lambda where: hit.where(where).agg(F.avg(F.col("hit").cast("int"))).first()[0]
    assert share("y BETWEEN 35 AND 44 AND x BETWEEN 30 AND 41") > 0.5 and share("y < 15 AND x < 15") < 0.05
    nothing, none = evidence.fuse(px, {"deformation": F.col("deformation")})
    assert none == {} and px.select(F.max(nothing)).first()[0] == 0


def test_exposures_and_unmixing(spark):
    own = np.random.RandomState(11)
    cube = own.uniform(0.02, 0.08, (7, 50, 50))
    cube[4, :, :25], cube[3, :, :25] = 0.50, 0.04
    cube[5, :, 25:], cube[3, :, 25:], cube[4, :, 25:] = 0.40, 0.30, 0.25
    names = ["coastal", "blue", "green", "red", "nir", "swir1", "swir2"]
    px = image(spark, dict(zip(names, cube, strict=True)))
    ndvi, bsi = bands.ndvi(F.col("nir"), F.col("red")), bands.bsi(F.col("blue"), F.col("red"), F.col("nir"), F.col("swir1"))
    mask = px.withColumn("m", unmixing.exposure(ndvi, bsi).cast("int"))
    assert mask.where("x >= 25").agg(F.avg("m")).first()[0] > 0.8 and mask.where("x < 25").agg(F.avg("m")).first()[0] < 0.05
    bright = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    rows = {r["name"]: [r[n] for n in names] for r in unmixing.endmembers(px, names, {"vegetation": ndvi, "rock_soil": bsi, "shade": -bright}).collect()}
    out = unmixing.unmix(px, names, np.array(list(rows.values())).T, list(rows))
    assert out.where("x >= 25").agg(F.avg("rock_soil")).first()[0] > out.where("x < 25").agg(F.avg("rock_soil")).first()[0] + 0.3
    assert out.agg(F.min("vegetation"), F.max(F.abs(F.col("vegetation") + F.col("rock_soil") + F.col("shade") - 1))).first() == pytest.approx((0, 0), abs=1e-9)


def test_non_negative_least_squares_meets_its_conditions():
    own = np.random.default_rng(5)
    members, y = own.random((6, 3)), own.normal(size=(200, 6))
    a = unmixing.solve(y, members)
    slope = (y - a @ members.T) @ members
    assert (a >= 0).all() and (slope <= 1e-8).all() and np.abs(slope * a).max() < 1e-8


def test_components_join_sides_not_corners(spark):
    own = np.random.default_rng(8)
    for share in (0.3, 0.6):
        grid_ = own.random((25, 40)) < share
        labels = np.full(grid_.shape, -1)
        for y, x in zip(*np.nonzero(grid_), strict=True):
            if labels[y, x] < 0:
                stack, labels[y, x] = [(y, x)], y * 1000 + x
                while stack:
                    cy, cx = stack.pop()
                    for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                        if 0 <= ny < 25 and 0 <= nx < 40 and grid_[ny, nx] and labels[ny, nx] < 0:
                            labels[ny, nx] = y * 1000 + x
                            stack.append((ny, nx))
        cells = spark.createDataFrame([("s", int(y), int(x)) for y, x in zip(*np.nonzero(grid_), strict=True)], "scene string, y int, x int")
        found = {(r.y, r.x): (r.label.y, r.label.x0) for r in grid.components(cells).collect()}
        parts = {}
        for (y, x), top in found.items():
            parts.setdefault(labels[y, x], set()).add(top)
        assert len(found) == grid_.sum() and all(tops == {divmod(int(k), 1000)} for k, tops in parts.items())


def test_closing_ends_at_the_edge(spark):
    mask = np.random.default_rng(3).random((14, 17)) < 0.25
    wide = np.pad(mask, 2)
    dilated = np.any([np.roll(wide, (i, j), (0, 1)) for i in range(-2, 3) for j in range(-2, 3)], 0)[2:-2, 2:-2]
    outer = np.pad(dilated, 2)
    wanted = np.all([np.roll(outer, (i, j), (0, 1)) for i in range(-2, 3) for j in range(-2, 3)], 0)[2:-2, 2:-2]
    got = grid.closing(image(spark, {"m": mask.astype(float)}), F.col("m") > 0).collect()
    assert {(r.y, r.x) for r in got if r.closed} == set(zip(*map(lambda v: v.tolist(), np.nonzero(wanted)), strict=True))


def test_crossings_include_shared_vertices(spark):
    points = [(1, 0, 0.0, 0.0), (1, 1, 2.0, 2.0), (1, 2, 4.0, 0.0), (2, 0, 0.0, 2.0), (2, 1, 2.5, 0.0), (3, 0, 9.0, 9.0), (3, 1, 9.0, 8.0)]
    found = grid.crossings(grid.segments(spark.createDataFrame(points, "line_id int, seq int, lon double, lat double"))).collect()
    assert sorted((round(r.x, 4), round(r.y, 4)) for r in found) == [(1.1111, 1.1111), (2.0, 2.0)]


def test_principal_components(spark):
    own = np.random.default_rng(2)
    data = own.normal(size=(300, 4)) @ own.normal(size=(4, 4))
    names = ["B1", "B2", "B3", "B4"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data] + [(None, 1.0, 1.0, 1.0)], ", ".join(f"{n} double" for n in names))
    found = pca.crosta(df, names, ["B1", "B7"], ["B3", "B4"])
    values, vectors = np.linalg.eigh(np.cov(data, rowvar=False))
    scores = [pca.votes(vectors[:, k], names, ["B1", "B7"], ["B3", "B4"]) for k in (3, 2, 1, 0)]
    assert abs(scores[found.index]) == max(map(abs, scores)) and found.index == int(np.argmax(np.abs(scores)))
    got = np.array([r[0] for r in df.limit(300).select(pca.projection(found, names)).collect()])
    assert np.allclose(np.abs(got), np.abs((data - data.mean(0)) @ vectors[:, 3 - found.index]))
    with pytest.raises(ValueError):
        pca.crosta(df.limit(4), names, ["B1"], [])


def test_scores_differ_by_mode(spark):
    row = spark.createDataFrame([(True, False, 1)], "ratio boolean, pca boolean, priority int")
    masks = {"ratio": F.col("ratio"), "pca": F.col("pca"), "band_depth": None}
    got = row.select(*[evidence.mineral_score(masks, F.col("priority"), m) for m in ("library", "route")], evidence.mineral_score({"a": F.col("ratio")}, F.lit(3), "hyper")).first()
    assert tuple(got) == pytest.approx((1 / 3, 1 / 2, 0.25))


def test_association_and_decay_without_samples(spark):
    px = spark.createDataFrame([(True, None), (False, 3.0)], "m boolean, d double")
    assert tuple(evidence.association(px, F.col("m"), F.col("d")).first()) == (1, None, None)
    assert tuple(evidence.association(px.limit(0), F.col("m"), F.col("d")).first()) == (0, None, None)
    pairs = spark.createDataFrame([(10, 0.9), (20, 0.8)], "baseline int, coherence double")
    assert tuple(deformation.decay(pairs).first()) == (None, 2)


def test_texts(spark):
    row = spark.createDataFrame([("a b/c（x）B1 / B2（低）", "  ", "Landsat8/9_L2", "B08a")], "e string, n string, s string, b string")
    got = row.select(text.clean_ratio(F.col("e")), text.safe_name(F.col("n")), text.normalized_sensor(F.col("s")), text.band_name(F.col("b")), text.safe_name(F.lit("金矿 (a)-b")), text.directory_name(F.lit(" A_b--C "))).first()
    assert tuple(got) == ("ab/cB1/B2", "x", "Landsat8", "B8A", "金矿_a_-b", "a b c")


def test_run_store(spark, tmp_path):
    rows = [("r1", "p", "A", "2024-01-01", 1), ("r2", "p", "A", "2024-01-02", 2), ("r3", "p", "A_b", "2024-01-03", 3), ("r4", "q", "A", None, 4)]
    table = str(tmp_path / "runs")
    runs.save(spark.createDataFrame(rows, "run_id string, project string, deposit string, created_at string, n int"), table)
    stored = runs.load(spark, table)
    assert {(r.project, r.deposit): r.run_id for r in runs.latest(stored).collect()} == {("p", "A"): "r2", ("p", "A_b"): "r3", ("q", "A"): "r4"}
    assert [r.run_id for r in runs.surplus(stored, 1).collect()] == ["r1"] and runs.surplus(stored, 0).count() == 0
    assert [r.run_id for r in runs.summaries(stored).collect()] == ["r3", "r2", "r1", "r4"] and runs.load(spark, table, "r3").first().n == 3


def test_effective_sensor(spark):
    rows = [("ASTER", ["ASTER", "Landsat8"], ["Landsat8", "Sentinel2"]), ("Landsat8", ["Landsat8"], ["Landsat8"]), (None, [], ["ASTER"]), ("ASTER", ["ASTER"], ["Landsat8"])]
    df = spark.createDataFrame(rows, "p string, able array<string>, usable array<string>")
    assert [r[0] for r in df.select(knowledge.effective_sensor(F.col("p"), F.col("able"), F.col("usable"))).collect()] == ["Landsat8", "Landsat8", None, None]


def test_batch_isolates_what_fails(spark):
    own = np.random.default_rng(6)
    layers = {f"B{k}": own.uniform(0.05, 0.3, (30, 30)) for k in range(1, 6)}
    layers["B5"][10:14, 10:14] *= 3
    layers["B2"][0, 0] = np.nan
    px = image(spark, layers)
    targets = [
        batch.Target("clay", 1, ratio="B5/B4", pca=(["B2", "B3", "B4", "B5"], ["B5"], ["B4"])),
        batch.Target("none", 2),
        batch.Target("bad", 2, ratio="B5**2", pca=(["B9"], ["B9"], [])),
        batch.Target("rare", 3, ratio="B1/B2"),
    ]
    roi = F.col("y") < 25
    found = batch.analyze(px, targets, roi=roi)
    rows = {(r.mineral, r.method): r for r in found.results.collect()}
    assert set(found.warnings) == {("bad", "ratio"), ("bad", "pca")} and len(rows) == 4
    v = (layers["B5"] / layers["B4"])[:25].astype(float)
    limit = v.mean() + 2 * v.std()
    assert rows["clay", "ratio"].threshold == pytest.approx(limit) and rows["clay", "ratio"].n_anomaly == (v > limit).sum()
    assert rows["clay", "ratio"].anomaly_ratio == pytest.approx((v > limit).sum() / 750) and rows["bad", "pca"].n_anomaly == 0
    top = found.layers.agg(F.max("score"), F.count_if("high")).first()
    assert top[0] == 1.0 and 0 < top[1] < 40 and found.layers.where("y >= 25 AND score > 0").count() == 0
    only = batch.analyze(px, targets, ["ratio"], "median_mad", selected=["rare"]).results.collect()
    assert [r.mineral for r in only] == ["rare"] and batch.supported_minerals("ASTER") == ["aloh", "carbonate", "ferrous", "silica", "propylitic"]
    double = batch.spectral_composite(px.withColumns({"a": F.col("B1") > 0.1, "b": F.col("B2") > 0.2}), [("a", 1), ("b", 2)])
    assert {(r.overlap, r.score, r.high) for r in double.where("B2 IS NOT NULL").select("overlap", "score", "high").distinct().collect()} == {(0, 0.0, False), (1, 1.0, False), (1, 0.5, False), (2, 1.5, True)}


def test_scaling_needs_whole_bands(spark):
    px = spark.createDataFrame([(2000.0, 5.0), (30.0, 1.0)], "B1 double, B2 double")
    assert batch.scaled(px, ["B1", "B2"]).first().B1 == 0.2
    assert batch.scaled(px.unionByName(spark.createDataFrame([(None, 1.0)], "B1 double, B2 double")), ["B1", "B2"]).first().B1 == 2000
    assert batch.scaled(px.where("B1 < 1"), ["B1", "B2"]).count() == 0


def test_resampling(spark):
    grid_ = np.arange(20, dtype=float).reshape(4, 5)
    grid_[0, 4] = np.nan
    px = image(spark, {"value": grid_})
    cells = spark.createDataFrame([("s", i, j) for i in range(7) for j in range(9)], "scene string, i int, j int")
    row, column = spatial.zoom_place(F.col("i"), 4, 7), spatial.zoom_place(F.col("j"), 5, 9)
    got = {(r.i, r.j): r.value for r in spatial.resample(px, cells, row, column).collect()}
    assert len(got) == 63 and got[6, 8] == 19 and got[1, 1] == pytest.approx((0 + 1 + 5 + 6) / 4) and got[0, 8] is None and got[0, 7] == 3
    near = {(r.i, r.j): r.value for r in spatial.resample(px, cells, row, column, method="nearest").collect()}
    assert near[6, 8] == 19 and near[1, 1] == 6 and near[0, 8] is None
    x, y = spatial.to_world((30.0, 0.0, 5.0, 0.0, -30.0, 9.0), F.lit(2.0), F.lit(3.0))
    back = spark.range(1).select(x, y, *spatial.to_pixel((30.0, 0.0, 5.0, 0.0, -30.0, 9.0), x, y)).first()
    assert tuple(back) == pytest.approx((65, -81, 2, 3))


def test_smoothing_mirrors_the_edge(spark):
    grid_ = np.random.default_rng(4).random((9, 12))
    w = np.exp(-0.5 * (np.arange(-3, 4) / 0.8) ** 2)
    w /= w.sum()
    wide = np.pad(grid_, 3, mode="symmetric")
    wanted = sum(w[i] * w[j] * wide[i : i + 9, j : j + 12] for i in range(7) for j in range(7))
    for r in spatial.smoothed(image(spark, {"v": grid_}), "v", 0.8).collect():
        assert r.v == pytest.approx(wanted[r.y, r.x])


def test_boxes(spark):
    points = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, -1.0), ("b", 9.0, 9.0)], "roi_id string, lon double, lat double")
    boxes = spatial.bounding_boxes(points)
    assert {tuple(r) for r in boxes.collect()} == {("a", 1, -1, 3, 2), ("b", 9, 9, 9, 9)}
    assert {r.roi_id: r.usable for r in spatial.coverage(boxes, 3, 2, 5, 5).collect()} == {"a": True, "b": False}


def test_crossings_of_all_orders_by_brute_force(spark):
    path = "/root/testdata/sf0.001"
    lines = {}
    orders = spark.read.parquet(f"{path}/orders.parquet").collect()
    for o in sorted(orders, key=lambda o: o.o_orderkey):
        lon = o.o_custkey % 100 + o.o_totalprice * 100 % 997 * 1.2 / 997
        lines.setdefault(o.o_custkey, []).append((o.o_orderkey, lon, o.o_custkey // 100 + o.o_orderkey * 37 % 1009 * 1.2 / 1009))
    segs = sorted(((line, p[0]), *p[1:], *q[1:]) for line, points in lines.items() for p, q in zip(points, points[1:], strict=False))
    x1, y1, x2, y2 = np.array([s[1:] for s in segs]).T
    wanted = set()
    for i in range(len(segs)):
        with np.errstate(all="ignore"):
            d = (x2[i] - x1[i]) * (y2 - y1) - (y2[i] - y1[i]) * (x2 - x1)
            t = ((x1 - x1[i]) * (y2 - y1) - (y1 - y1[i]) * (x2 - x1)) / d
            u = ((x1 - x1[i]) * (y2[i] - y1[i]) - (y1 - y1[i]) * (x2[i] - x1[i])) / d
        met = (abs(d) >= 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & (np.arange(len(segs)) > i)
        wanted |= {(*segs[i][0], *segs[j][0]) for j in np.flatnonzero(met)}
    found = catalog.QUERIES["segment_intersections_all"](spark, path).collect()
    assert len(found) == len(wanted) and {(r.line_a, r.seq_a, r.line_b, r.seq_b) for r in found} == wanted
    assert any(r.line_a != r.line_b for r in found) and max(r.seq_b for r in found) > 900


def test_global_medians_do_not_gather_all_values(spark, monkeypatch):
    def gathered(*_):
        raise AssertionError("a median of the whole table in one task")

    monkeypatch.setattr(stats, "DIRECT_ROWS", 100)
    monkeypatch.setattr(F, "median", gathered)
    values = np.random.default_rng(9).random(1000)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "velocity double")
    wanted = pytest.approx(np.median(values), rel=1e-12)
    assert deformation.velocity_summary(df).first().median_velocity == wanted
    assert deformation.stability(df, "velocity").first()["median"] == wanted
    assert evidence.association(df, F.lit(True), F.col("velocity")).first().median_dist_m == wanted
    assert deformation.velocity_summary(df.limit(0)).first().median_velocity is None


def test_quantiles_of_many_layers_take_three_scans(spark, monkeypatch):
    own = np.random.default_rng(12)
    layers = {"even": own.random(3000), "steps": np.round(own.random(3000) * 4), "flat": np.full(3000, 2.5), "few": np.where(np.arange(3000) < 40, own.random(3000), np.nan)}
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*layers.values(), strict=True)] + [(None,) * 4], ", ".join(f"{n} double" for n in layers))
    wanted = {n: (F.col(n), [0.0, 0.02, 0.371, 0.5, 0.98, 1.0]) for n in layers} | {"none": (F.lit(None).cast("double"), [0.5])}
    scans = []

    def counted(frame, *columns, _agg=type(df).agg):
        scans.append(len(columns))
        return _agg(frame, *columns)

    monkeypatch.setattr(type(df), "agg", counted)
    for direct, most in ((10_000, 2), (60, 4)):
        scans.clear()
        found = stats.quantiles_of(df, wanted, direct)
        assert found["none"] == [None]
        for n, v in layers.items():
            assert np.allclose(found[n], np.percentile(v[~np.isnan(v)], [0, 2, 37.1, 50, 98, 100])), n
        assert len(scans) <= most or direct < 100
    scans.clear()
    assert np.allclose(stats.quantiles_of(df, {"even": (F.col("even"), [0.25, 0.5])}, 300)["even"], np.percentile(layers["even"], [25, 50])) and len(scans) == 3


def test_endmembers_want_all_scores_of_a_pixel(spark):
    rows = [(0, x, float(x), 1.0, -1.0 * x, float(x)) for x in range(100)] + [(1, x, 1000.0, None, 5.0, 9e9) for x in range(40)]
    px = spark.createDataFrame(rows, "y int, x int, a double, b double, c double, band double")
    found = {r["name"]: r.band for r in unmixing.endmembers(px, ["band"], {k: F.col(k) for k in "abc"}).collect()}
    assert found == {"a": np.mean([95, 96, 97, 98, 99]), "b": 2.0, "c": 2.0}
    few = px.where("y = 1 OR x < 3")
    assert {r["name"]: r.band for r in unmixing.endmembers(few, ["band"], {k: F.col(k) for k in "abc"}).collect()} == {"a": 9e9, "b": 1.0, "c": 9e9}


def cut(values, mode, reach):
    return np.pad(values, reach, mode=mode)


def plain_lineaments(coherence, limit=0.3, length=9, directions=6, share=90, sigma=0.8):
    known = np.isfinite(coherence)
    low = np.maximum(limit - np.clip(np.where(known, coherence, 1.0), 0, 1), 0)
    w = np.exp(-0.5 * (np.arange(-3, 4) / sigma) ** 2)
    w /= w.sum()
    height, width = low.shape
    wide = cut(low, "symmetric", 3)
    smooth = sum(w[i] * w[j] * wide[i : i + height, j : j + width] for i in range(7) for j in range(7))
    wide, reach = cut(smooth, "edge", length // 2), length // 2
    means = []
    for k in range(directions):
        cells = {(round(reach + t * np.sin(np.pi * k / directions)), round(reach + t * np.cos(np.pi * k / directions))) for t in range(-reach, reach + 1)}
        means.append(sum(wide[int(i) : int(i) + height, int(j) : int(j) + width] for i, j in cells) / len(cells))
    strength = np.max(means, axis=0)
    own = strength[known]
    if own.size and own.max() - own.min() > 1e-9:
        a, b = np.percentile(own, [2, 98])
        strength = np.clip((strength - a) / (b - a + 1e-9), 0, 1)
    over = np.percentile(strength[known], share)
    return np.where(known, strength, np.nan), known & (strength >= over - 1e-9) & (strength > 1e-4) & (over > 1e-4)


def test_lineaments_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(spatial.tiled, "__defaults__", ("value", 16))
    own = np.random.default_rng(13)
    coherence = own.random((37, 45))
    coherence[12, 5:40] = 0.02
    coherence[20:23, 7:9] = np.nan
    coherence[0, 0] = np.nan
    strength, line = plain_lineaments(coherence)
    for r in deformation.lineaments(image(spark, {"c": coherence}), F.col("c")).collect():
        if np.isnan(strength[r.y, r.x]):
            assert r.strength is None and not r.lineament
        else:
            assert r.strength == pytest.approx(strength[r.y, r.x], abs=1e-6) and r.lineament == line[r.y, r.x]
    assert line[12].sum() > 25
    calm = deformation.lineaments(image(spark, {"c": np.full((12, 12), 0.9)}), F.col("c"))
    assert calm.agg(F.max("strength"), F.count_if("lineament")).first() == (0, 0)


def test_a_pixel_without_coherence_counts_only_in_pairs_without_a_layer(spark):
    schema = "y int, x int, pair string, ref_date date, sec_date date, disp double, coherence double"
    rows = [(0, 0, "a", "2024-01-01", "2024-12-31", 10.0, None), (0, 1, "a", "2024-01-01", "2024-12-31", 10.0, 0.9), (0, 0, "b", "2024-01-01", "2024-12-31", 30.0, None), (0, 1, "b", "2024-01-01", "2024-12-31", 30.0, None)]
    seen = spark.createDataFrame([(y, x, p, a, b, d, c) for y, x, p, a, b, d, c in rows], schema.replace("date date", "date string")).withColumns({c: F.to_date(c) for c in ("ref_date", "sec_date")})
    for observations in (seen, deformation.stack(seen.drop("coherence"), seen.where("pair = 'a'").select("pair", "y", "x", "coherence"))):
        found = {(r.y, r.x): (r.velocity, r.n_valid) for r in deformation.velocity(deformation.rates(observations)).collect()}
        assert found == {(0, 0): (pytest.approx(30 * 365.25 / 365), 1), (0, 1): (pytest.approx(20 * 365.25 / 365), 2)}
    places = deformation.first_pair_places(spark.createDataFrame([("a", 10, 20), ("b", 19, 39), ("c", 1, 20)], "pair string, height int, width int"))
    assert {r.pair: (r.row_scale, r.column_scale) for r in places.collect()} == {"a": (1, 1), "b": (2, 2), "c": (0, 1)}


def test_library_mode_takes_all_targets_and_only_methods_that_apply(spark):
    px = spark.createDataFrame([(1.0, 2.0)] * 9 + [(9.0, 1.0)], "B1 double, B2 double")
    targets = [batch.Target("rare", 3, ratio="B1/B2"), batch.Target("other", 1, pca=(["B1", "B2"], ["B1"], []))]
    assert [(r.mineral, r.method) for r in batch.analyze(px, targets, mode="library").results.collect()] == [("rare", "ratio"), ("other", "pca")]
    assert [(r.mineral, r.method) for r in batch.analyze(px, targets).results.collect()] == [("other", "pca")]
    with pytest.raises(ValueError):
        batch.alteration(px, "Sentinel2", "carbonate")
    with pytest.raises(ValueError):
        batch.alteration(px, "Sentinel2", "gold")
    near = batch.analyze(px.withColumn("near", F.lit(0.5)), targets[:1], ["ratio"], mode="library", near=F.col("near"), prior_weight=0.4).layers
    assert near.agg(F.max("score")).first()[0] == pytest.approx(0.25 * (1 - 0.4 + 0.4 * 0.5))
    found = batch.associations(batch.analyze(px.withColumn("d", F.col("B1") * 100), targets, mode="library"), F.col("d")).where("mineral = 'rare'").first()
    assert (found.n_near, found.median_dist_m, found.frac_within_buffer) == (1, 900, 0)


def test_candidates_of_equal_confidence_come_by_their_place(spark):
    candidates = spark.createDataFrame([("r", 0, "t1", 0.7, "first"), ("r", 1, "t2", 0.7, "second"), ("r", 2, "t3", 0.5, "far")], "region string, pos int, structure_type string, confidence double, evidence string")
    mapping = spark.createDataFrame([("t1", 0, "zinc"), ("t2", 0, "alpha"), ("t2", 1, "zinc"), ("t3", 0, "beta")], "structure_type string, map_pos int, deposit string")
    known = spark.createDataFrame([("zinc",), ("alpha",), ("beta",)], "deposit string")
    assert [(r.deposit, r.evidence) for r in knowledge.structural_candidates(candidates, mapping, known).orderBy("rank").collect()] == [("zinc", "first"), ("alpha", "second")]
    regions = spark.createDataFrame([("r",), ("none",), ("oil",)], "region string")
    more = candidates.unionByName(spark.createDataFrame([("oil", 0, "t9", 0.91234, "x")], candidates.schema))
    states = {r.region: (r.status, r.primary_model, r.primary_confidence) for r in knowledge.structural_states(regions, more, mapping, known).collect()}
    assert states == {"r": ("ok", "t1", 0.7), "none": ("no_product", None, None), "oil": ("non_alteration", "t9", 0.912)}
    close = spark.createDataFrame([("r", 0, "b", "x", 0.70004), ("r", 1, "a", "x", 0.70044)], "region string, pos int, deposit string, commodity string, confidence double")
    nearby = spark.createDataFrame([("r", "y")], "region string, commodity string")
    assert [r.deposit for r in knowledge.corroborated(close, nearby).orderBy("rank").collect()] == ["b", "a"]


def test_distinct_crossings(spark):
    points = [(1, 0, 0.0, 0.0), (1, 1, 2.0, 2.0), (2, 0, 0.0, 2.0), (2, 1, 2.0, 0.0), (3, 0, 1.0, 0.0), (3, 1, 1.0, 2.0)]
    found = grid.crossings(grid.segments(spark.createDataFrame(points, "line_id int, seq int, lon double, lat double")))
    assert found.count() == 3 and [tuple(r) for r in grid.crossing_points(found).collect()] == [(1.0, 1.0, 3)]


def test_boxes_meet_once(spark):
    own = np.random.default_rng(14)
    boxes = []
    for k in range(2):
        low = np.round(own.random((60, 2)) * 20, 1)
        boxes.append([(int(i), *map(float, (*a, *(a + s)))) for i, (a, s) in enumerate(zip(low, np.round(own.random((60, 2)) * 5, 1), strict=True))] + [(100, -3.0, 2.0, -3.0, 9.0), (101, 4.0, 4.0, 6.0, 6.0), (102, 6.0, 1.0, 8.0, 4.0)])
    a, b = (spark.createDataFrame(x, f"{n} int, west double, south double, east double, north double") for n, x in zip(("i", "j"), boxes, strict=True))
    wanted = sorted((i, j) for i, w, s, e, n in boxes[0] for j, w2, s2, e2, n2 in boxes[1] if w <= e2 and e >= w2 and s <= n2 and n >= s2)
    assert sorted((r.i, r.j) for r in grid.overlaps(a, b).collect()) == wanted


def test_cells_on_the_outline(spark):
    cells = spark.createDataFrame([(float(x), float(y)) for x in range(9) for y in range(9)], "x double, y double")
    ring = [[(1, 1), (6, 1), (6, 4), (1, 4)]]
    assert {(r.x, r.y) for r in cells.where(grid.inside_cells(F.col("x"), F.col("y"), ring)).collect()} == {(x, y) for x in range(1, 7) for y in range(1, 5)}
    line = [[(0, 0), (8, 4)]]
    assert {(r.x, r.y) for r in cells.where(grid.on_outline(F.col("x"), F.col("y"), line)).collect()} >= {(0, 0), (2, 1), (4, 2), (8, 4)}


def test_the_store_is_confined_and_manifests_gather(spark):
    assert runs.confined("/data/runs", "p/r1") == "/data/runs/p/r1" and runs.confined("/data/runs/", ".") == "/data/runs"
    assert runs.confined("/data/runs", "../other") is None and runs.confined("/data/runs", "/etc/passwd") is None and runs.confined("/data/runs", "../runs2/x") is None
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([1, 2],), ([1, None, 3, 4, 5, 6],), (None,)], "t array<int>")
    assert [r[0] for r in df.select(runs.affine_list(df.t)).collect()] == [[1, 2, 3, 4, 5, 6], None, None, None]
    own = spark.createDataFrame([("r1", "p", "d", "2024"), ("r2", "p", "d", "2025")], "run_id string, project string, deposit string, created_at string")
    results = spark.createDataFrame([("r1", "B", "clay", "ratio", 5), ("r1", "A", "iron", "pca", 3)], "run_id string, sensor string, mineral string, method string, n int")
    composites = spark.createDataFrame([("r1", "A", 7), ("r1", "B", 8)], "run_id string, sensor string, high_pixels int")
    found = runs.manifests(own, results, composites)
    rows = {r.run_id: r for r in found.collect()}
    assert [(x.sensor, x.mineral, x.n) for x in rows["r1"].results] == [("A", "iron", 3), ("B", "clay", 5)] and rows["r1"].high_pixels == 15
    assert (rows["r2"].results, rows["r2"].n_results, rows["r2"].high_pixels) == ([], 0, 0)
    assert [tuple(r) for r in runs.summaries(found).collect()] == [("r2", "p", "d", "2025", 0, 0), ("r1", "p", "d", "2024", 2, 15)]


def test_vegetation_targets_are_for_red_edge_sensors():
    assert knowledge.vegetation_target("Sentinel2_L2").stress == ("B4", "B5", "B6", "B7", "B8") and knowledge.vegetation_target("ASTER") is None


def test_unmixing_meets_its_conditions_on_a_query(spark):
    path = "/root/testdata/sf0.001"
    names = ["B1", "B2", "B3", "B4"]
    rows = catalog.QUERIES["endmembers"](spark, path).orderBy("name").collect()
    members = np.array([[r[c] for r in rows] for c in names])
    from regolith.plans import views

    px = {(r.y, r.x): np.array([r[c] for c in names]) for r in views.raster(spark, path).collect()}
    out = unmixing.unmix(views.raster(spark, path), names, members, [r["name"] for r in rows], sum_to_one=False).collect()
    assert len(out) == len(px)
    for r in out:
        a = np.array([r[x["name"]] for x in rows])
        slope = members.T @ (px[r.y, r.x] - members @ a)
        assert (a >= 0).all() and (slope <= 1e-6 * np.abs(members.T @ px[r.y, r.x])).all() and np.abs(slope * a).max() <= 1e-6 * (px[r.y, r.x] ** 2).sum()


def test_prospectivity_of_a_region(spark):
    rows = [(i, float(i), i < 100) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, v double, roi boolean")
    scored, summary = evidence.prospectivity(df, {"alteration": F.col("v"), "flat": F.lit(1.0)}, roi=F.col("roi"))
    score = np.clip((np.arange(120) - 2.38) / (116.62 - 2.38), 0, 1)[:100]
    limit = np.percentile(score, 90)
    assert tuple(summary.first()) == pytest.approx((limit, (score >= limit).mean(), score.mean()))
    assert scored.where("NOT roi AND (score IS NOT NULL OR high)").count() == 0 and scored.where("high").count() == (score >= limit).sum()
    _, nothing = evidence.prospectivity(df, {"flat": F.lit(1.0)})
    assert tuple(nothing.first()) == (None, 0, 0)


def test_tiles_go_both_ways(spark):
    row = spark.range(1).select(text.tile_lon(text.tile_x(F.lit(12.5), F.lit(7)), F.lit(7)), text.tile_lat(text.tile_y(F.lit(-41.25), F.lit(7)), F.lit(7)), *[text.few_tiles(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), F.lit(z)) for z in (7, 9)]).first()
    assert tuple(row) == (pytest.approx(12.5), pytest.approx(-41.25), True, False)


def _snyder(lon, lat, middle):
    """Transverse Mercator by series in the distance from the meridian, another way than Krueger's."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    p, q = np.radians(lat), e2 / (1 - e2)
    n, t, c, d = a / np.sqrt(1 - e2 * np.sin(p) ** 2), np.tan(p) ** 2, q * np.cos(p) ** 2, np.radians(lon - middle) * np.cos(p)
    steps = np.linspace(0, p, 200_001)
    m = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5, steps)
    x = k0 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * q) * d**5 / 120)
    y = k0 * (m + n * np.tan(p) * (d**2 / 2 + (5 - t + 9 * c + 4 * c**2) * d**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * q) * d**6 / 720))
    return 500000 + x, y


def test_coordinates(spark):
    places = [(32647, 99.0, 0.0), (32647, 101.5, 18.75), (32747, 97.25, -33.5), (32601, -177.5, 79.0), (3857, 12.5, 45.0), (3857, -179.0, -60.0), (4326, 1.0, 2.0), (27700, 1.0, 2.0)]
    df = spark.createDataFrame(places, "code int, lon double, lat double")
    x, y = coordinates.from_lonlat(F.col("code"), F.col("lon"), F.col("lat"))
    rows = df.select("*", x.alias("x"), y.alias("y")).select("*", *[c.alias(n) for c, n in zip(coordinates.to_lonlat(F.col("code"), F.col("x"), F.col("y")), ("u", "v"), strict=True)]).collect()
    assert len(rows) == len(places)
    for r in rows:
        if r.code == 27700:
            assert r.x is None and r.v is None
            continue
        assert (r.u, r.v) == pytest.approx((r.lon, r.lat), abs=1e-9)
        if r.code > 32000:
            wanted = _snyder(r.lon, r.lat, r.code % 100 * 6 - 183)
            assert (r.x, r.y) == pytest.approx((wanted[0], wanted[1] + (1e7 if r.code > 32700 else 0)), abs=0.005)
        elif r.code == 3857:
            assert (r.x, r.y) == pytest.approx((r.lon * 20037508.342789244 / 180, 6378137 * np.arcsinh(np.tan(np.radians(r.lat)))), abs=1e-6)


def test_warped(spark):
    """A plane of a UTM raster seen in degrees, and its box."""
    source, grid = (10.0, 0.0, 500000.0, 0.0, -10.0, 2000000.0), (1e-4, 0.0, 99.0005, 0.0, -1e-4, 18.0875)
    cells = spark.range(80 * 80).select(F.lit("s").alias("scene"), F.floor(F.col("id") / 80).alias("y"), (F.col("id") % 80).alias("x"))
    pixels = cells.withColumn("value", F.col("x") * 2.0 + F.col("y"))
    found = spatial.warped(pixels, source, 32647, cells.where("y < 20 AND x < 30"), grid, 4326).collect()
    assert len(found) == 600
    at = spark.createDataFrame([(99.0005 + 1e-4 * (r.x + 0.5), 18.0875 - 1e-4 * (r.y + 0.5), r.value) for r in found], "lon double, lat double, value double")
    x, y = coordinates.from_lonlat(32647, F.col("lon"), F.col("lat"))
    column, row = (x - 500000) / 10 - 0.5, (2000000 - y) / 10 - 0.5
    inside = column.between(0, 79) & row.between(0, 79)
    told = at.select(inside.alias("inside"), "value", (column * 2 + row).alias("plane")).collect()
    assert sum(t.inside for t in told) > 300 and all(t.value == pytest.approx(t.plane, abs=1e-6) for t in told if t.inside)
    near = {(r.y, r.x): r.value for r in spatial.warped(pixels, source, 32647, cells.where("y < 2"), source, 32647, method="nearest").collect()}
    assert near[1, 7] == 15
    profile = spark.createDataFrame([(80, 80, list(source), 32647), (80, 80, None, 32647)], "height int, width int, transform array<double>, epsg int")
    box, none = sorted(spatial.lonlat_boxes(profile).collect(), key=lambda r: r.west is None)
    assert box.west == pytest.approx(99, abs=1e-9) and box.east == pytest.approx(99.00756, abs=1e-4) and box.south < box.north and none.west is None


def test_unknown_values_are_null_nan_and_infinite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, nan, 0.9), (1, inf, 0.9), (2, None, 0.9), (3, 9.0, nan), (4, 9.0, 0.9), (5, -9.0, 0.1), (6, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "k int, v double, c double")
    assert [r.k for r in df.where(deformation.active(F.col("v"), F.col("c"))).collect()] == [4]
    assert sorted(r.k for r in df.where(deformation.active(F.col("v"))).collect()) == [3, 4, 5]
    known = [9.0, 9.0, -9.0, 1.0]
    assert math.isclose(stats.threshold(df, F.col("v")), np.mean(known) + 2 * np.std(known))
    assert stats.threshold(df, F.col("v"), "percentile") == np.percentile(known, 95)
    assert stats.threshold(df, F.col("v"), "median_mad") == np.median(known) + 2 * stats.MAD_SCALE * np.median(np.abs(np.array(known) - np.median(known)))
    assert sorted(r.k for r in df.where(stats.over(F.col("v"), 2.0)).collect()) == [3, 4]
    assert df.agg(stats.anomaly_ratio(stats.over(F.col("v"), 2.0), F.col("v"))).first()[0] == 0.5
    own = [r[0] for r in df.orderBy("k").select(stats.normalized(F.col("v"), 0.0, 10.0)).collect()]
    assert own == [None, None, None, 0.9, 0.9, 0.0, 0.1]
    both = stats.thresholds(df, {"v": F.col("v"), "c": F.col("c"), "none": F.lit(None).cast("double")}, "median_mad")
    assert both["none"] is None and both["c"] == pytest.approx(0.9)
    assert deformation.stability(df, "c").first()["mean"] == pytest.approx(np.mean([0.9, 0.9, 0.9, 0.9, 0.1, 0.9]))


def test_shares_of_results(spark):
    scored = spark.createDataFrame([(1, 0.9, True), (2, 0.1, False), (3, None, False), (4, 0.8, True)], "k int, score double, high boolean")
    assert deformation.high_shares(scored).first()[0] == 0.5
    lines = spark.createDataFrame([("a", 0.9, True), ("a", 0.1, False), ("a", None, False), ("b", None, False)], "scene string, strength double, lineament boolean")
    assert {tuple(r) for r in deformation.lineament_shares(lines).collect()} == {("a", 0.5), ("b", 0.0)}
    rated = spark.createDataFrame([("p", 1, 3.0), ("p", 2, None), ("q", 1, None)], "pair string, x int, rate double")
    assert deformation.pairs_used(rated) == 2
    unmixed = spark.createDataFrame([(1, 0.2), (2, 0.4)], "x int, rmse double")
    assert [tuple(r) for r in unmixing.summary(unmixed).collect()] == [(2, pytest.approx(0.3))]


def test_lines_are_strong_within_their_own_scene(spark):
    """A scene of weak lines beside one of strong ones keeps its own scale."""
    rows = [(s, y, x, 0.9 - (0.7 * k if x == 10 else 0.0)) for k, s in ((1.0, "strong"), (0.9, "weak")) for y in range(30) for x in range(30)]
    df = spark.createDataFrame(rows, "scene string, y int, x int, c double")
    together = {(r.scene, r.y, r.x): (r.strength, r.lineament) for r in deformation.lineaments(df, F.col("c")).collect()}
    for scene in ("strong", "weak"):
        alone = {(r.scene, r.y, r.x): (r.strength, r.lineament) for r in deformation.lineaments(df.where(F.col("scene") == scene), F.col("c")).collect()}
        assert alone == {k: v for k, v in together.items() if k[0] == scene} and any(line for _, line in alone.values())


def test_radar_joins_in_tasks_of_so_many_rows(spark, tmp_path, monkeypatch):
    """A table of 100 rows with 10 of them a task takes 10 tasks, where the session's shuffles have 4."""
    from regolith.plans import views

    spark.range(20).selectExpr("id AS o_orderkey", "timestamp '2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    columns = "id % 20 AS l_orderkey", "id AS l_suppkey", "id AS l_partkey", "1D AS l_extendedprice", "0D AS l_discount", "timestamp '2024-02-01' AS l_shipdate"
    spark.range(100).selectExpr(*columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(views, "TASK_ROWS", 10)
    found = views.radar(spark, str(tmp_path))
    assert found.count() == 100
    assert "hashpartitioning(l_orderkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["preferred_sensor", "effective_sensor", "targets_catalogue"])
def test_sensors_of_a_mineral_take_no_grouping(spark, name):
    from regolith.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_sensors_by_rows_and_by_groups(spark):
    from regolith.plans import views

    rows = views.alterations(spark, "/root/testdata/sf0.001")
    grouped = knowledge.preferred_sensor(knowledge.by_sensor(rows), ["pos"])
    single = rows.select("pos", knowledge.preferred_of(knowledge.sensor_methods(rows), F.col("pca_sensor")).alias("preferred"))
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, single.collect()))


def test_velocities_are_worked_out_once(spark):
    """Quantiles take several scans, none of which may work out the pixels' rates anew."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pixels = spark.range(100).selectExpr("CAST(id AS double) AS velocity").mapInArrow(run, "velocity double")
    (found,) = deformation.velocity_summary(pixels).collect()
    assert tuple(found) == (49.5, 49.5, 0.0, 99.0) and seen.value == 100
