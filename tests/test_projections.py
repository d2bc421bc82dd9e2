"""Projections against published worked examples (EPSG guidance note 7-2; Snyder, Map Projections: A Working Manual), and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.functions import coordinates, projections
from regolith.functions.projections import Projection
from regolith.operators import spatial

FOOT = 1200 / 3937
TEXAS = projections.from_parameters({"kind": "lambert_conformal", "ellipsoid": "Clarke1866", "lat0": 27 + 50 / 60, "lon0": -99.0, "lat1": 28 + 23 / 60, "lat2": 30 + 17 / 60, "x0": 2000000 * FOOT, "unit": FOOT})
ALBERS = projections.from_parameters({"kind": "albers", "ellipsoid": "Clarke1866", "lat0": 23.0, "lon0": -96.0, "lat1": 29.5, "lat2": 45.5})
NORTH = Projection("polar_stereographic", lat0=90.0, scale=0.994, x0=2e6, y0=2e6)
ANTARCTIC = Projection("polar_stereographic", lat0=-90.0, lat1=-71.0, lon0=70.0, x0=6e6, y0=6e6)
BRITISH = projections.from_parameters({"kind": "transverse_mercator", "ellipsoid": "Airy1830", "lat0": 49.0, "lon0": -2.0, "scale": 0.9996012717, "x0": 400000.0, "y0": -100000.0})


@pytest.mark.parametrize(("p", "lon", "lat", "x", "y", "within"), [(TEXAS, -96.0, 28.5, 2963503.91, 254759.80, 0.01), (ALBERS, -75.0, 35.0, 1885472.7, 1535925.0, 0.06), (NORTH, 44.0, 73.0, 3320416.75, 632668.43, 0.01), (ANTARCTIC, 120.0, -75.0, 7255380.79, 7053389.56, 0.01), (BRITISH, 0.5, 50.5, 577274.99, 69740.50, 0.01)])
def test_published_examples(p, lon, lat, x, y, within):
    found = projections.forward(p, [lon], [lat])
    assert abs(found[0][0] - x) < within and abs(found[1][0] - y) < within
    back = projections.inverse(p, found[0], found[1])
    assert abs(back[0][0] - lon) < 1e-9 and abs(back[1][0] - lat) < 1e-9


def test_geocentric_places_and_shifts():
    lon, lat = 2 + 7 / 60 + 46.38 / 3600, 53 + 48 / 60 + 33.82 / 3600
    x, y, z = projections.geocentric(projections.WGS84, lon, lat, 73.0)
    assert np.allclose([x, y, z], [3771793.968, 140253.342, 5124304.349], atol=0.001)
    moved = projections.shifted((0, 0, 4.5, 0, 0, 0.554, 0.219), np.array([3657660.66]), np.array([255768.55]), np.array([5201382.11]))
    assert np.allclose(np.ravel(moved), [3657660.78, 255778.43, 5201387.75], atol=0.01)
    back = projections.shifted((0, 0, 4.5, 0, 0, 0.554, 0.219), *moved, back=True)
    assert np.allclose(np.ravel(back), [3657660.66, 255768.55, 5201382.11], atol=1e-6)


def test_round_trips_with_a_shift_of_datum():
    own = np.random.default_rng(1)
    shift = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
    for p, lon, lat in ((BRITISH, (-6, 2), (50, 58)), (TEXAS, (-105, -93), (26, 33)), (ALBERS, (-120, -70), (25, 49)), (NORTH, (-180, 180), (65, 89.9)), (ANTARCTIC, (-180, 180), (-89.9, -60)), (Projection("lambert_conformal", lat0=-30, lat1=-20, lat2=-40, lon0=135), (115, 155), (-45, -10))):
        for own_shift in (None, shift, shift[:3]):
            moved = Projection(**{**vars(p), "shift": own_shift})
            a, b = own.uniform(*lon, 300), own.uniform(*lat, 300)
            back = projections.inverse(moved, *projections.forward(moved, a, b))
            # With a shift the height that a place has on the other datum is dropped: millimetres, or centimetres far from where a shift is meant for.
            within = 2e-8 if own_shift is None else 2e-6
            assert np.abs((back[0] - a) * np.cos(np.radians(b))).max() < within and np.abs(back[1] - b).max() < within


def test_transverse_mercator_is_utm_where_it_is(spark):
    p = Projection("transverse_mercator", lon0=15.0, scale=0.9996, x0=500000.0)
    own = np.random.default_rng(2)
    places = spark.createDataFrame([(float(a), float(b)) for a, b in zip(own.uniform(12, 18, 200), own.uniform(-10, 80, 200), strict=True)], "lon double, lat double")
    utm, mine = coordinates.from_lonlat(32633, F.col("lon"), F.col("lat")), projections.forward_columns(p, F.col("lon"), F.col("lat"))
    for r in places.select(*utm, *mine).collect():
        assert abs(r[0] - r[2]) < 1e-4 and abs(r[1] - r[3]) < 1e-4
    back = places.select("lon", "lat", *[c.alias(n) for n, c in zip("xy", mine, strict=True)])
    for r in back.select("lon", "lat", *projections.inverse_columns(p, F.col("x"), F.col("y"))).collect():
        assert abs(r[0] - r[2]) < 1e-9 and abs(r[1] - r[3]) < 1e-9
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "lon double, lat double")
    assert [tuple(r) for r in odd.select(*projections.forward_columns(p, F.col("lon"), F.col("lat"))).collect()] == [(None, None)] * 2


def keyed(entries):
    """A key directory and double parameters of (key, value or values)."""
    directory, doubles = [1, 1, 0, len(entries)], []
    for key, value in entries:
        if isinstance(value, int):
            directory += [key, 0, 1, value]
        else:
            own = value if isinstance(value, tuple) else (value,)
            directory += [key, 34736, len(own), len(doubles)]
            doubles += own
    return directory, doubles


def test_from_geokeys():
    earth = [(1024, 1), (2057, 6378206.4), (2059, 294.978698214)]
    texas = keyed([*earth, (3075, 8), (3076, 9003), (3078, 28 + 23 / 60), (3079, 30 + 17 / 60), (3084, -99.0), (3085, 27 + 50 / 60), (3086, 2000000.0), (3087, 0.0)])
    x, y = projections.forward(projections.from_geokeys(*texas), [-96.0], [28.5])
    assert abs(x[0] - 2963503.91) < 0.01 and abs(y[0] - 254759.80) < 0.01
    albers = keyed([*earth, (3075, 11), (3076, 9001), (3078, 29.5), (3079, 45.5), (3080, -96.0), (3081, 23.0), (3082, 0.0), (3083, 0.0)])
    assert projections.from_geokeys(*albers) == ALBERS
    polar = keyed([(1024, 1), (3075, 15), (3081, -71.0), (3095, 70.0), (3082, 6e6), (3083, 6e6)])
    assert projections.from_geokeys(*polar) == ANTARCTIC
    up = keyed([(1024, 1), (3075, 15), (3081, 90.0), (3095, 0.0), (3092, 0.994), (3082, 2e6), (3083, 2e6)])
    assert projections.from_geokeys(*up) == NORTH
    moved = keyed([(1024, 1), (2057, 6377563.396), (2059, 299.3249646), (2062, (446.4, -125.1, 542.0, 0.15, 0.247, 0.842, -20.5)), (3075, 1), (3080, -2.0), (3081, 49.0), (3092, 0.9996012717), (3082, 400000.0), (3083, -100000.0)])
    found = projections.from_geokeys(*moved)
    assert found.kind == "transverse_mercator" and found.shift == (446.4, -125.1, 542.0, 0.15, 0.247, 0.842, -20.5)
    assert projections.from_geokeys(*keyed([(1024, 1), (3072, 32633)])) is None
    assert projections.from_geokeys(*keyed([(1024, 2), (2057, 6378388.0), (2059, 297.0)])) == Projection("lonlat", 6378388.0, 297.0)


def test_wrong_parameters():
    with pytest.raises(ValueError, match="unknown projection"):
        Projection("other")
    with pytest.raises(ValueError, match="three or seven"):
        Projection("lonlat", shift=(1.0, 2.0))
    with pytest.raises(ValueError, match="standard parallel"):
        Projection("albers")


def test_warping_between_projections(spark):
    """A raster in Lambert's projection on a grid in degrees: a plane stays a plane of its own coordinates."""
    p = Projection("lambert_conformal", lat0=46.5, lat1=44.0, lat2=49.0, lon0=3.0, x0=700000.0, y0=6600000.0)
    transform = [1000.0, 0.0, 600000.0, 0.0, -1000.0, 6700000.0]
    pixels = spark.range(200 * 200).selectExpr("'s' AS scene", "id div 200 AS y", "id % 200 AS x", "(id % 200 + 0.5) * 2.0 + (id div 200 + 0.5) AS value")
    target = spark.range(400).selectExpr("'s' AS scene", "id div 20 AS y", "id % 20 AS x")
    grid = [0.02, 0.0, 2.9, 0.0, -0.02, 46.9]
    found = spatial.warped(pixels, transform, p, target, grid, 4326).collect()
    lon, lat = np.array([2.9 + 0.02 * (r.x + 0.5) for r in found]), np.array([46.9 - 0.02 * (r.y + 0.5) for r in found])
    x, y = projections.forward(p, lon, lat)
    wanted = (x - 600000) / 1000 * 2 + (6700000 - y) / 1000
    assert np.allclose([r.value for r in found], wanted, atol=1e-6)
