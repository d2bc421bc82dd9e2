"""Queries on grids: resampling, layers found by box, smoothing, affine places, boxes of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import projections
from regolith.operators import evidence, spatial
from regolith.plans import views
from regolith.plans.catalog import query

#: Where a cell of the resampled grid lies on the raster's axes: first place and step.
ROW, COLUMN = (0.2512345678, 0.95310179804), (1.5, 0.8713456789)


def _kernel(t: str) -> str:
    return f"CASE WHEN abs({t}) <= 1 THEN (1.5 * abs({t}) - 2.5) * abs({t}) * abs({t}) + 1 WHEN abs({t}) < 2 THEN ((-0.5 * abs({t}) + 2.5) * abs({t}) - 4) * abs({t}) + 2 ELSE 0 END"


_SHARE = "greatest(0, 1 - abs(r - floor(r) - i)) * greatest(0, 1 - abs(c - floor(c) - j))"


@query("resampled_grid", f"""WITH {views.RASTER}, spot AS (SELECT y, x, {ROW[0]}::DOUBLE + y * {ROW[1]}::DOUBLE AS r, {COLUMN[0]}::DOUBLE + x * {COLUMN[1]}::DOUBLE AS c FROM px), o AS (SELECT i, j FROM range(-1, 3) a(i), range(-1, 3) b(j)),
 w AS (SELECT spot.y, spot.x, {_kernel('(r - floor(r) - i)')} * {_kernel('(c - floor(c) - j)')} AS w, {_SHARE} AS s, CASE WHEN px.y % 13 <> 5 OR px.x % 7 <> 3 THEN px.B1 END AS v FROM spot, o LEFT JOIN px ON px.y = floor(spot.r) + i AND px.x = floor(spot.c) + j),
 g AS (SELECT y, x, sum(w * v) AS cubic, count(CASE WHEN w <> 0 AND v IS NULL THEN 1 END) AS gaps, sum(CASE WHEN s > 0 THEN s * v END) / sum(CASE WHEN s > 0 AND v IS NOT NULL THEN s END) AS linear FROM w GROUP BY y, x)
SELECT y, x, round(linear, 6) AS bilinear, round(CASE WHEN gaps = 0 THEN cubic ELSE linear END, 6) AS cubic FROM g""")
def resampled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster, with gaps, on a grid of other places, bilinear and cubic."""
    px = views.raster(spark, sf_dir)
    target = px.select("scene", "y", "x")
    gappy = px.select("scene", "y", "x", F.when((F.col("y") % 13 != 5) | (F.col("x") % 7 != 3), F.col("B1")).alias("value"))
    row, column = ROW[0] + F.col("y") * ROW[1], COLUMN[0] + F.col("x") * COLUMN[1]
    found = [spatial.resample(gappy, target, row, column, method=m).withColumnRenamed("value", m) for m in ("bilinear", "cubic")]
    both = found[0].join(found[1], ["scene", "y", "x"])
    return both.select("y", "x", F.round("bilinear", 6).alias("bilinear"), F.round("cubic", 6).alias("cubic"))


@query("zoomed_axis", """WITH s AS (SELECT c_custkey AS axis, c_custkey % 97 + 2 AS a, c_custkey * 7 % 60 + 1 AS b FROM customer), t AS (SELECT axis, a, b, unnest(range(b)) AS i FROM s)
SELECT axis, i, round(CASE WHEN b > 1 THEN i * ((a - 1) / (b - 1)::DOUBLE) ELSE 0 END, 9) AS place FROM t""")
def zoomed_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the cells of zoomed axes of many lengths lie on their source's axis."""
    key = F.col("c_custkey")
    axes = views.read(spark, sf_dir, "customer").select(key.alias("axis"), (key % 97 + 2).alias("a"), (key * 7 % 60 + 1).alias("b"))
    cells = axes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    return cells.select("axis", "i", F.round(spatial.zoom_place(F.col("i"), F.col("a"), F.col("b")), 9).alias("place"))


TRANSFORM = [29.5, 1.25, 500000.0, 0.75, -30.25, 4100000.0]
_A, _B, _C, _D, _E, _F = TRANSFORM


@query("affine_places", f"""WITH {views.RASTER}, w AS (SELECT y, x, {_A} * x + {_B} * y + {_C} AS wx, {_D} * x + {_E} * y + {_F} AS wy FROM px)
SELECT y, x, round(wx, 6)::DOUBLE AS wx, round(wy, 6)::DOUBLE AS wy, round(((wx + 10 - {_C}) * {_E} - (wy - {_F}) * {_B}) / ({_A} * {_E} - {_B} * {_D}), 6)::DOUBLE AS col, round(((wy - {_F}) * {_A} - (wx + 10 - {_C}) * {_D}) / ({_A} * {_E} - {_B} * {_D}), 6)::DOUBLE AS row FROM w""")
def affine_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in world coordinates, and places 10 to the east of them back in pixels."""
    wx, wy = spatial.to_world(TRANSFORM, F.col("x"), F.col("y"))
    world = views.raster(spark, sf_dir).select("y", "x", wx.alias("wx"), wy.alias("wy"))
    column, row = spatial.to_pixel(TRANSFORM, F.col("wx") + 10, F.col("wy"))
    return world.select("y", "x", *[F.round(c, 6).alias(n) for n, c in (("wx", F.col("wx")), ("wy", F.col("wy")), ("col", column), ("row", row))])


#: A conformal cone over the Atlantic, on the sphere that web maps use, so that SQL's own formulas stay short.
_CONE = projections.Projection("lambert_conformal", axis=6378137.0, inverse_flattening=0.0, lon0=-20.0, lat0=30.0, lat1=20.0, lat2=50.0, x0=1000.0, y0=-500.0)


@query("conical_places", """WITH c AS (SELECT ln(cos(radians(20)) / cos(radians(50))) / ln(tan(radians(70)) / tan(radians(55))) AS n), k AS (SELECT n, 6378137.0 * cos(radians(20)) * pow(tan(radians(55)), n) / n AS f FROM c),
 p AS (SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0 - 100 AS lon, (c_custkey * 53 % 1300) / 10.0 - 50 AS lat FROM customer), q AS (SELECT *, f / pow(tan(radians(45 + lat / 2)), n) AS r, n * radians(lon + 20) AS a, f / pow(tan(radians(60)), n) AS r0 FROM p, k)
SELECT c_custkey, round(1000 + r * sin(a), 3) AS x, round(-500 + r0 - r * cos(a), 3) AS y, round(lon, 6)::DOUBLE AS lon, round(lat, 6)::DOUBLE AS lat FROM q""")
def conical_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a projection given by parameters, and back in degrees."""
    key = F.col("c_custkey")
    places = views.read(spark, sf_dir, "customer").select("c_custkey", ((key * 37 % 1600) / 10.0 - 100).alias("lon"), ((key * 53 % 1300) / 10.0 - 50).alias("lat"))
    x, y = projections.forward_columns(_CONE, F.col("lon"), F.col("lat"))
    placed = places.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = projections.inverse_columns(_CONE, F.col("x"), F.col("y"))
    return placed.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("region_boxes", "SELECT s_nationkey AS roi_id, min(s_acctbal) AS west, min(s_suppkey) AS south, max(s_acctbal) AS east, max(s_suppkey) AS north, max(s_acctbal) >= 0 AND min(s_acctbal) <= 2000 AND max(s_suppkey) >= 10 AND min(s_suppkey) <= 40 AS usable FROM supplier GROUP BY s_nationkey")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of regions from their vertices, and which touch another box."""
    points = views.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("roi_id"), F.col("s_acctbal").alias("lon"), F.col("s_suppkey").alias("lat"))
    return spatial.coverage(spatial.bounding_boxes(points), 0.0, 10.0, 2000.0, 40.0)


def _mirrored(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


def _smoothing_sql(sigma: float) -> str:
    import math

    reach = spatial.gaussian_reach(sigma)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    weights = ", ".join(f"({d}, {w / sum(raw)!r})" for d, w in zip(range(-reach, reach + 1), raw, strict=True))
    return f"""WITH {views.RASTER}, n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), g(d, wt) AS (VALUES {weights}),
 gx AS MATERIALIZED (SELECT l.y, l.x, sum(s.B1 * g.wt) AS v FROM px l CROSS JOIN n CROSS JOIN g JOIN px s ON s.y = l.y AND s.x = {_mirrored('l.x + g.d', 'n.w')} GROUP BY l.y, l.x)
SELECT l.y, l.x, round(sum(s.v * g.wt), 6)::DOUBLE AS value FROM gx l CROSS JOIN n CROSS JOIN g JOIN gx s ON s.x = l.x AND s.y = {_mirrored('l.y + g.d', 'n.h')} GROUP BY l.y, l.x"""


@query("smoothed_raster", _smoothing_sql(0.8))
def smoothed_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir).select("scene", "y", "x", F.col("B1").alias("value"))
    return spatial.smoothed(px, "value", 0.8).select("y", "x", F.round("value", 6).alias("value"))


#: Products of a structural survey: a box each, in the target's own coordinates, and a grid of 10 units.
_LAYERS = {"distance": "B4 * 6", "density": "B2", "hillshade": "B3", "slope": "B1"}


def _products(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each event type's cells as the layers of a product, which covers the whole raster but in the first of them."""
    px = views.raster(spark, sf_dir)
    kinds = px.groupBy("event_type").agg(F.min("y").alias("n")).select(F.col("event_type").alias("product"), F.col("event_type").alias("pos"))
    first = F.col("product") == "click"
    boxes = {"west": F.when(first, 5000.0).otherwise(0.0), "south": F.lit(-100.0), "east": F.when(first, 6000.0).otherwise(1000.0), "north": F.lit(1e9)}
    products = kinds.withColumns(boxes).withColumn("transform", F.lit([10.0, 0.0, 0.0, 0.0, 10.0, 0.0]))
    cells = px.select(F.col("event_type").alias("product"), "y", "x", F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.expr(e).cast("double").alias("value")) for n, e in _LAYERS.items()])))
    return products, cells


@query("layers_by_box", f"""WITH {views.RASTER}, p AS (SELECT min(event_type) AS product FROM px WHERE event_type <> 'click'), src AS (SELECT y, x, B4 * 6 AS distance, B1 AS slope FROM px JOIN p ON event_type = product),
 o AS (SELECT i, j FROM range(2) a(i), range(2) b(j)), spot AS (SELECT y, x, (y * 10 + 4.0) / 10 AS r, (x * 10 + 2.5) / 10 AS c FROM px),
 w AS (SELECT spot.y, spot.x, {_SHARE} AS s, distance, slope FROM spot, o LEFT JOIN src ON src.y = floor(spot.r) + i AND src.x = floor(spot.c) + j)
SELECT y, x, round(sum(s * distance) / sum(CASE WHEN distance IS NOT NULL THEN s END), 6) AS distance, round(sum(s * slope) / sum(CASE WHEN slope IS NOT NULL THEN s END), 6) AS slope FROM w GROUP BY y, x""")
def layers_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural layers of the first product that touches a box, on the raster's own cells."""
    target = views.raster(spark, sf_dir).select("scene", "y", "x", (F.col("x") * 10 + 2.5).alias("lon"), (F.col("y") * 10 + 4.0).alias("lat"))
    found = spatial.layers_on_grid(*_products(spark, sf_dir), target, (10.0, 0.0, 900.0, 500.0))
    return found.select("y", "x", F.round("distance", 6).alias("distance"), F.round("slope", 6).alias("slope"))


_NEAR = "coalesce(exp(-distance / (m.med + 1e-9)), 0.0)"


@query("prospectivity_by_box", f"""WITH {views.RASTER}, p AS (SELECT min(event_type) AS product FROM px WHERE event_type <> 'click'), src AS (SELECT y, x, B4 * 6 AS distance FROM px JOIN p ON event_type = product),
 o AS (SELECT i, j FROM range(2) a(i), range(2) b(j)), spot AS (SELECT y, x, B2 AS alteration, B3 AS stress, (y * 10 + 4.0) / 10 AS r, (x * 10 + 2.5) / 10 AS c FROM px),
 w AS (SELECT spot.y, spot.x, alteration, stress, {_SHARE} AS s, distance FROM spot, o LEFT JOIN src ON src.y = floor(spot.r) + i AND src.x = floor(spot.c) + j),
 g AS (SELECT y, x, max(alteration) AS alteration, max(stress) AS stress, sum(s * distance) / sum(CASE WHEN distance IS NOT NULL THEN s END) AS distance FROM w GROUP BY y, x),
 m AS (SELECT median(distance) AS med FROM g), l AS (SELECT alteration AS a, stress AS v, {_NEAR} AS n FROM g, m),
 q AS (SELECT quantile_cont(a, 0.02) al, quantile_cont(a, 0.98) ah, quantile_cont(v, 0.02) vl, quantile_cont(v, 0.98) vh, quantile_cont(n, 0.02) nl, quantile_cont(n, 0.98) nh FROM l),
 f AS (SELECT (0.3 * greatest(least((a - al) / (ah - al), 1.0), 0.0) + 0.25 * greatest(least((v - vl) / (vh - vl), 1.0), 0.0) + 0.2 * greatest(least((n - nl) / (nh - nl), 1.0), 0.0)) / 0.75 AS score FROM l, q),
 t AS (SELECT quantile_cont(score, 0.9) AS thr FROM f)
SELECT round(max(thr), 6) AS threshold, round(avg(score), 6) AS score_mean FROM f, t""")
def prospectivity_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a raster with the structure that a product found by box adds; there is no product of deformation there."""
    target = views.raster(spark, sf_dir).select("scene", "y", "x", (F.col("x") * 10 + 2.5).alias("lon"), (F.col("y") * 10 + 4.0).alias("lat"), F.col("B2").alias("alteration"), F.col("B3").alias("stress"))
    layers = {"alteration": F.col("alteration"), "veg_stress": F.col("stress")}
    _, summary = evidence.prospectivity_at(target, layers, (10.0, 0.0, 900.0, 500.0), structure=_products(spark, sf_dir))
    return summary.select(F.round("threshold", 6).alias("threshold"), F.round("score_mean", 6).alias("score_mean"))
