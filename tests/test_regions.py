"""The index of regions against plain ray casting."""

import json
import math
import random

import pytest

from regolith.functions import coordinates
from regolith.operators import grid, regions
from regolith.sources import rasters

NAMES = "scene string, region long, part int, ring int, seq int, x double, y double"


def crossed(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


def rows_of(shapes, scene="s"):
    """shapes: region -> list of rings."""
    return [(scene, r, 0, k, i, float(x), float(y)) for r, rings in shapes.items() for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]


def star(own, x, y, size, n, whole):
    angles = sorted(own.uniform(0, 2 * math.pi) for _ in range(n))
    points = [(x + math.cos(a) * size * own.uniform(0.3, 1), y + math.sin(a) * size * own.uniform(0.3, 1)) for a in angles]
    return [(round(a), round(b)) for a, b in points] if whole else points


@pytest.mark.parametrize("at", [0.0, 0.5])
def test_regions_against_ray_casting(spark, at):
    own = random.Random(4)
    shapes = {}
    for r in range(40):
        x, y = own.uniform(-10, 130), own.uniform(-10, 130)
        shapes[r] = [star(own, x, y, own.choice([3, 10, 60, 100]), own.choice([3, 5, 30]), r % 2 == 0) for _ in range(own.choice([1, 1, 2, 3]))]
    shapes[100] = [[(0, 0), (128, 0), (128, 128), (0, 128)], [(32, 32), (96, 32), (96, 96), (32, 96)]]  # a hole, on the borders of cells
    shapes[101] = [[(10, 10), (10, 10), (10, 10)]]
    shapes[102] = [[(5, 5), (50, 5)]]
    shapes[103] = [[(0.0, 0.0), (120.0, 119.0), (120.0, 119.5), (0.0, 0.5), (0.0, 0.0)]]  # a sliver, closed
    vertices = spark.createDataFrame(rows_of(shapes) + [("s", 104, 0, 0, 0, None, 1.0), ("other", 1, 0, 0, 0, 0.0, 0.0), ("other", 1, 0, 0, 1, 5.0, 0.0), ("other", 1, 0, 0, 2, 0.0, 5.0)], NAMES)
    pixels = spark.range(140 * 140).selectExpr("'s' AS scene", "id div 140 AS y", "id % 140 AS x", "id AS regions_before")
    found = regions.regions_at(pixels, regions.index(vertices, at), at).collect()
    assert len(found) == 140 * 140
    for p in found:
        assert p.regions == [r for r, rings in sorted(shapes.items()) if crossed(p.x + at, p.y + at, rings)], (p.x, p.y)


def test_outlines_as_plans_of_literals_have_them(spark):
    own = random.Random(8)
    for _ in range(4):
        ring = star(own, 40, 40, 38, own.choice([3, 6, 9]), True)
        pixels = spark.range(6400).selectExpr("'s' AS scene", "id div 80 AS y", "id % 80 AS x")
        x, y = pixels.x.cast("double"), pixels.y.cast("double")
        wanted = {(p.y, p.x) for p in pixels.where(grid.inside_cells(x, y, [[(float(a), float(b)) for a, b in ring]])).collect()}
        found = regions.regions_at(pixels, regions.index(spark.createDataFrame(rows_of({1: [ring]}), NAMES)), outline=True).where("size(regions) > 0").collect()
        assert {(p.y, p.x) for p in found} == wanted


def test_a_long_edge_is_in_the_cells_along_it(spark):
    shape = {1: [[(0.0, 0.0), (32000.0, 32000.0), (32000.0, 32001.0), (0.0, 1.0)]]}
    cells = regions.index(spark.createDataFrame(rows_of(shape), NAMES)).count()
    assert 1000 <= cells < 5000


def test_no_vertex_is_a_literal_of_the_plan(spark):
    vertices = spark.createDataFrame(rows_of({1: [[(1, 1), (9, 1), (5, 9)]]}), NAMES)
    pixels = spark.range(100).selectExpr("'s' AS scene", "id div 10 AS y", "id % 10 AS x")
    small = regions.regions_at(pixels, regions.index(vertices))._jdf.queryExecution().optimizedPlan().toString()
    more = spark.createDataFrame(rows_of({1: [[(math.cos(k), math.sin(k)) for k in range(500)]]}), NAMES)
    large = regions.regions_at(pixels, regions.index(more))._jdf.queryExecution().optimizedPlan().toString()
    assert len(large) < 1.1 * len(small)


def test_empty_tables(spark):
    none = spark.createDataFrame([], NAMES)
    pixels = spark.range(4).selectExpr("'s' AS scene", "id AS y", "id AS x")
    assert [p.regions for p in regions.regions_at(pixels, regions.index(none)).collect()] == [[]] * 4
    assert regions.regions_at(pixels.limit(0), regions.index(none)).count() == 0


def test_geojson_in_degrees_on_a_projected_raster(spark, tmp_path):
    # UTM zone 33 north, pixels of 30 m; a multipolygon with a hole.
    transform, epsg = [30.0, 0.0, 500000.0, 0.0, -30.0, 5_000_000.0], 32633
    center = spark.range(1).select(*coordinates.to_lonlat(epsg, *(regions.F.lit(v) for v in (501000.0, 4_999_000.0)))).first()
    lon, lat = center
    outer = [[lon - 0.009, lat - 0.007], [lon + 0.009, lat - 0.006], [lon + 0.008, lat + 0.007], [lon - 0.01, lat + 0.006], [lon - 0.009, lat - 0.007]]
    hole = [[lon - 0.003, lat - 0.002], [lon + 0.003, lat - 0.002], [lon, lat + 0.003], [lon - 0.003, lat - 0.002]]
    other = [[lon + 0.0095, lat - 0.006], [lon + 0.0115, lat - 0.006], [lon + 0.0105, lat]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[outer, hole], [other]]}}))
    read = rasters.read_geojson(spark, f"{tmp_path}/a.geojson").withColumn("region", regions.F.lit(7).cast("long"))
    profiles = spark.createDataFrame([("s", transform, epsg), ("bare", None, None)], "scene string, transform array<double>, epsg int")
    boxes = spark.createDataFrame([("s", lon - 0.02, lat - 0.02, lon + 0.02, lat + 0.02), ("far", 0.0, 0.0, 1.0, 1.0)], "scene string, west double, south double, east double, north double")
    drawn = regions.meeting(read, boxes)
    assert {r.scene for r in drawn.select("scene").distinct().collect()} == {"s"}
    pixels = spark.range(80 * 80).selectExpr("id div 80 AS y", "id % 80 AS x").crossJoin(spark.createDataFrame([("s",), ("bare",)], "scene string"))
    found = {(p.scene, p.y, p.x): p.roi for p in regions.region_mask(pixels, profiles, drawn).collect()}
    points = spark.createDataFrame([(i, j, *p) for i, ring in enumerate((outer[:-1], hole[:-1], other)) for j, p in enumerate(ring)], "ring int, seq int, lon double, lat double")
    world = points.select("ring", "seq", *[c.alias(n) for c, n in zip(coordinates.from_lonlat(epsg, points.lon, points.lat), "xy", strict=True)]).orderBy("ring", "seq").collect()
    rings = [[((p.x - 500000.0) / 30, (5_000_000.0 - p.y) / 30) for p in world if p.ring == i] for i in range(3)]
    inside = {(y, x) for y in range(80) for x in range(80) if crossed(x + 0.5, y + 0.5, rings)}
    assert {(y, x) for (scene, y, x), roi in found.items() if scene == "s" and roi} == inside and 500 < len(inside) < 6000
    assert all(roi for (scene, _, _), roi in found.items() if scene == "bare")


def test_the_order_of_fallbacks(spark):
    pixels = spark.range(100).selectExpr("id div 10 AS y", "id % 10 AS x").crossJoin(spark.createDataFrame([("geo",), ("cells",), ("none",), ("unknown",)], "scene string"))
    profiles = spark.createDataFrame([("geo", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 4326), ("cells", None, 4326), ("unknown", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 99999)], "scene string, transform array<double>, epsg int")
    square = [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]
    drawn = spark.createDataFrame([(s, 1, 0, 0, i, *p) for s in ("geo", "cells", "unknown") for i, p in enumerate(square)], NAMES.replace("x double, y double", "lon double, lat double"))
    cells = spark.createDataFrame([(s, 1, 0, 0, i, *p) for s in ("geo", "cells", "unknown") for i, p in enumerate(square)], NAMES)
    out = {}
    for p in regions.region_mask(pixels, profiles, drawn, cells).where("roi").collect():
        out.setdefault(p.scene, set()).add((p.y, p.x))
    assert out["geo"] == {(y, x) for y in (1, 2, 3) for x in (1, 2, 3)}
    assert out["cells"] == out["unknown"] == {(y, x) for y in (1, 2, 3, 4) for x in (1, 2, 3, 4)}
    assert len(out["none"]) == 100
    assert regions.region_mask(pixels, profiles).where("roi").count() == 400


def test_spans_hold_what_the_index_holds_and_a_covered_pixel_is_one_row(spark):
    points = [("s", r, p, 0, i, float(x), float(y)) for r, p, ring in [(1, 0, [(0, 0), (9.5, 0.5), (4, 8)]), (1, 1, [(20, 2), (90, 2), (90, 7), (20, 7)]), (2, 0, [(5, -3), (70.5, 4), (3, 9), (30, 4)])] for i, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(points, "scene string, region int, part int, ring int, seq int, x double, y double")
    pixels = spark.range(1200).selectExpr("'s' AS scene", "id DIV 100 AS y", "id % 100 AS x")
    for at in (0.0, 0.5):
        found = regions.spans(vertices, at)
        each = {(r.y, r.x, k) for r in regions.regions_at(pixels, regions.index(vertices, at), at).collect() for k in r.regions}
        assert each and {(r.y, r.x, r.region) for r in regions.pairs_at(pixels, found).collect()} == each
        marked = regions.covered(pixels, found).collect()
        assert len(marked) == 1200 and {(r.y, r.x) for r in marked if r.covered} == {(y, x) for y, x, _ in each}


def test_a_mask_gathers_no_regions(spark):
    from regolith.plans import region_queries

    plan = region_queries.regions_in_degrees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "bit_or" in plan and "array_sort" not in plan  # what meets the pixels is bits, not a list of regions in each row
