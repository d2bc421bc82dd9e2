"""Closing, components and resampling over many tiles, against plain versions of whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import grid, spatial


def flooded(cells):
    """cell -> first cell of its component in scan order."""
    left, out = set(cells), {}
    for start in sorted(cells):
        if start in out:
            continue
        stack = [start]
        out[start] = start
        while stack:
            y, x = stack.pop()
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left and n not in out:
                    out[n] = start
                    stack.append(n)
    return out


def spiral(size):
    """One path that winds from a corner inwards, one cell apart from itself."""
    cells, y, x, dy, dx = set(), 0, 0, 0, 1
    while True:
        cells.add((y, x))
        ahead, two = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        if not (0 <= ahead[0] < size and 0 <= ahead[1] < size) or two in cells or ahead in cells:
            dy, dx = dx, -dy
            ahead, two = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
            if ahead in cells or two in cells or not (0 <= ahead[0] < size and 0 <= ahead[1] < size):
                return cells
        y, x = ahead


SHAPES = {
    "spiral": spiral(61),
    "comb": {(y, x) for y in range(60) for x in range(60) if x % 4 == 0 or y == 59},
    "noise": {(int(y), int(x)) for y, x in np.argwhere(np.random.default_rng(1).random((70, 50)) < 0.6)},
    "below zero": {(y - 30, x - 33) for y, x in spiral(41)},
    "one": {(5, 5)},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_over_many_tiles(spark, shape):
    cells = SHAPES[shape]
    other = {(y + 1, x) for y, x in cells}
    rows = [("a", y, x) for y, x in cells] + [("b", y, x) for y, x in other] + [("a", *next(iter(cells)))]
    found = grid.components(spark.createDataFrame(rows, "scene string, y int, x int"), tile=8, most_rounds=12).collect()
    for scene, own in (("a", cells), ("b", other)):
        wanted = flooded(own)
        got = [((r.y, r.x), (r.label.y, r.label.x0)) for r in found if r.scene == scene]
        assert len(got) == len(own) and dict(got) == wanted


def test_no_cells(spark):
    assert grid.components(spark.createDataFrame([], "scene string, y int, x int")).count() == 0


@pytest.mark.parametrize("size", [3, 5, (3, 7), (1, 5), 11])
def test_closing_with_rectangles_over_tiles(spark, monkeypatch, size):
    own = np.random.default_rng(3)
    mask = own.random((50, 45)) < 0.15
    down, right = (size, size) if isinstance(size, int) else size
    ry, rx = down // 2, right // 2

    def shifted(values):
        wide = np.pad(values, ((ry, ry), (rx, rx)))
        return [wide[i : i + 50, j : j + 45] for i in range(2 * ry + 1) for j in range(2 * rx + 1)]

    wanted = np.all(shifted(np.any(shifted(mask), 0)), 0)
    pixels = spark.createDataFrame([("s", y, x, bool(mask[y, x])) for y in range(50) for x in range(45)], "scene string, y int, x int, m boolean")
    monkeypatch.setattr(spatial, "tiled", lambda *args, tiled=spatial.tiled: tiled(*args, tile=16))
    found = grid.closing(pixels, F.col("m"), size)
    assert found.schema["closed"].dataType.simpleString() == "int"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.y, r.x) for r in found.collect() if r.closed}
    assert got == {(int(y), int(x)) for y, x in np.argwhere(wanted)}


def at(values, y, x):
    return values[y, x] if 0 <= y < values.shape[0] and 0 <= x < values.shape[1] else np.nan


def plain(values, row, column, method):
    if method == "nearest":
        return at(values, int(np.floor(row + 0.5)), int(np.floor(column + 0.5)))
    y, x = int(np.floor(row)), int(np.floor(column))
    if method == "cubic":
        def kernel(t):
            t = abs(t)
            return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

        parts = [(kernel(row - y - i) * kernel(column - x - j), at(values, y + i, x + j)) for i in range(-1, 3) for j in range(-1, 3)]
        if not any(np.isnan(v) for w, v in parts if abs(w) > 1e-15):
            return sum(w * v for w, v in parts if abs(w) > 1e-15)
    parts = [((1 - abs(row - y - i)) * (1 - abs(column - x - j)), at(values, y + i, x + j)) for i in (0, 1) for j in (0, 1)]
    known = sum(w for w, v in parts if w > 0 and not np.isnan(v))
    return sum(w * v for w, v in parts if w > 0 and not np.isnan(v)) / known if known > 0 else np.nan


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_resampling_over_blocks(spark, method):
    own = np.random.default_rng(4)
    values = own.normal(5, 2, (40, 37))
    values[own.random(values.shape) < 0.05] = np.nan
    other = own.normal(0, 1, (40, 37))
    pixels = spark.createDataFrame([("s", n, y, x, float(v[y, x])) for n, v in (("a", values), ("b", other), ("unused", other)) for y in range(40) for x in range(37)], "scene string, layer string, y int, x int, value double")
    places = [(k, float(r), float(c)) for k, (r, c) in enumerate(own.uniform(-3, 43, (600, 2)))] + [(1000 + k, float(k), 8.0) for k in range(40)] + [(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, 1e300, 1.0), (2003, 39.0, 36.0), (2004, 7.9999999999999999, 15.9999999999999999)]
    target = spark.createDataFrame([("s", *p) for p in places], "scene string, k int, row double, col double")
    found = {r.k: r for r in spatial.resample_layers(pixels, target, F.col("row"), F.col("col"), ["a", "b"], method, window=8).collect()}
    assert len(found) == len(places)
    for k, r, c in places:
        for name, source in (("a", values), ("b", other)):
            wanted = plain(source, r, c, method) if r is not None and np.isfinite(r) and abs(r) < 1e9 else np.nan
            if np.isnan(wanted):
                assert found[k][name] is None, (k, r, c)
            else:
                assert found[k][name] == pytest.approx(wanted, rel=1e-9, abs=1e-9), (k, r, c)


def test_each_side_is_shuffled_once(spark):
    pixels = spark.range(100).selectExpr("'s' AS scene", "id div 10 AS y", "id % 10 AS x", "id * 1.0 AS value")
    target = spark.range(50).selectExpr("'s' AS scene", "id AS k", "id / 7.0 AS r")
    plan = spatial.resample(pixels, target, F.col("r"), F.col("r"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    with pytest.raises(ValueError, match="unknown method"):
        spatial.resample(pixels, target, F.col("r"), F.col("r"), method="other")
