"""Queries on regions that are tables: suppliers as polygons of several parts with holes, events as pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import regions
from regolith.plans import views
from regolith.plans.catalog import query

#: A star and a hole around 0, by which each supplier's rings are drawn.
STAR = [(-1.0, -0.2), (-0.3, -0.35), (0.1, -1.0), (0.35, -0.25), (1.0, 0.15), (0.3, 0.4), (-0.15, 1.0), (-0.4, 0.3)]
HOLE = [(-0.2, -0.1), (0.15, -0.2), (0.1, 0.2)]


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, region, part, ring, seq, x, y: a star with a hole for each supplier, and a second part for every third one."""
    key, size = F.col("s_suppkey"), F.col("s_nationkey") + 4
    points = F.array(*[F.struct(F.lit(k).alias("ring"), F.lit(i).alias("seq"), F.lit(u).alias("u"), F.lit(v).alias("v")) for k, ring in enumerate((STAR, HOLE)) for i, (u, v) in enumerate(ring)])
    own = views.read(spark, sf_dir, "supplier").select(key.alias("region"), size.alias("size"), (key * 37 % 100 + 0.3).cast("double").alias("x0"), (key * 53 % 100 + 0.7).cast("double").alias("y0"))
    parts = own.withColumn("part", F.explode(F.when(F.col("region") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    each = parts.select("region", "part", "size", "x0", "y0", F.inline(points))
    x = F.col("x0") + F.col("part") * F.col("size") * 1.5 + F.col("size") * F.col("u")
    return each.select(F.lit("s").alias("scene"), "region", "part", "ring", "seq", x.alias("x"), (F.col("y0") + F.col("size") * F.col("v")).alias("y"))


_POINTS = ", ".join(f"({k}, {i}, {u}::DOUBLE, {v}::DOUBLE)" for k, ring in enumerate((STAR, HOLE)) for i, (u, v) in enumerate(ring))
_VERTICES = f"""verts AS (
  SELECT region, part, ring, seq, x0 + part * size * 1.5 + size * u AS x, y0 + size * v AS y
  FROM (SELECT s_suppkey AS region, s_nationkey + 4 AS size, (s_suppkey * 37 % 100 + 0.3)::DOUBLE AS x0, (s_suppkey * 53 % 100 + 0.7)::DOUBLE AS y0 FROM supplier)
  JOIN (VALUES (0), (1)) p(part) ON part = 0 OR region % 3 = 0, (VALUES {_POINTS}) q(ring, seq, u, v))"""


def _edges_sql(table: str) -> str:
    own = "OVER (PARTITION BY region, part, ring ORDER BY seq)"
    return f"edges AS (SELECT region, x AS x1, y AS y1, coalesce(lead(x) {own}, first(x) {own}) AS x2, coalesce(lead(y) {own}, first(y) {own}) AS y2 FROM {table})"


def _rays_sql(at: float) -> str:
    """Every pixel's ray against every edge."""
    return f"hits AS (SELECT region, px.y, px.x FROM px JOIN edges ON (y1 > px.y + {at}) <> (y2 > px.y + {at}) AND px.x + {at} < (x2 - x1) * (px.y + {at} - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"


@query("regions_of_pixels", f"WITH {views.RASTER}, {_VERTICES}, {_edges_sql('verts')}, {_rays_sql(0.0)} SELECT region, count(*) AS n_inside, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM hits GROUP BY region")
def regions_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pixels each of many regions holds."""
    each = regions.pairs_at(views.raster(spark, sf_dir).select("scene", "y", "x"), regions.spans(_vertices(spark, sf_dir)))
    return each.groupBy("region").agg(F.count("*").alias("n_inside"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


#: A raster in web Mercator with pixels of 400 m, and the degrees that a step of the drawn regions takes.
TRANSFORM, DEGREES = [400.0, 0.0, 1113000.0, 0.0, -400.0, 6276000.0], 0.0036
_LON = f"10.0 + x * {DEGREES}"
_LAT = f"49.0 - y * {DEGREES}"


@query("regions_in_degrees", f"""WITH {views.RASTER}, {_VERTICES},
 placed AS (SELECT region, part, ring, seq, (6378137.0 * radians({_LON}) - {TRANSFORM[2]}) / {TRANSFORM[0]} AS x, (6378137.0 * ln(tan(radians(45 + ({_LAT}) / 2))) - {TRANSFORM[5]}) / {TRANSFORM[4]} AS y FROM verts),
 {_edges_sql('placed')}, {_rays_sql(0.5)}
SELECT y, count(*) AS n_inside, min(x) AS first_x, max(x) AS last_x FROM (SELECT DISTINCT y, x FROM hits) GROUP BY y""")
def regions_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask of regions drawn in degrees on a raster in a projected system."""
    drawn = _vertices(spark, sf_dir).select("scene", "region", "part", "ring", "seq", F.expr(_LON).alias("lon"), F.expr(_LAT).alias("lat"))
    profiles = spark.range(1).select(F.lit("s").alias("scene"), F.lit(TRANSFORM).alias("transform"), F.lit(3857).alias("epsg"))
    masked = regions.region_mask(views.raster(spark, sf_dir).select("scene", "y", "x"), profiles, drawn)
    return masked.where("roi").groupBy("y").agg(F.count("*").alias("n_inside"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))
