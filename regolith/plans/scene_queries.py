"""Queries scene by scene: each event type is a scene of its own, with its own thresholds and stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import bands as b
from regolith.operators import scenes
from regolith.plans import views
from regolith.plans.catalog import query

KEY = ["event_type"]


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    return px.withColumn("v", b.band_expression("(B1+B4)/(B2+B3)", {f"B{i}": F.col(f"B{i}") for i in range(1, 5)}))


_V = f"WITH {views.RASTER}, ix AS (SELECT *, CASE WHEN abs(B2 + B3) > 1e-6 THEN (B1 + B4) / (B2 + B3) END AS v FROM px)"
_COUNTED = "SELECT ix.event_type, round(max(thr), 6) AS threshold, count(CASE WHEN v > thr THEN 1 END) AS n_anomaly, round(count(CASE WHEN v > thr THEN 1 END) / greatest(count(v), 1)::DOUBLE, 6) AS ratio FROM ix JOIN t ON ix.event_type = t.event_type GROUP BY ix.event_type"


def _counted(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    found = scenes.anomalies(_index(spark, sf_dir), KEY, {"v": F.col("v")}, method)
    shares = scenes.anomaly_ratios(found, KEY, {"ratio": (F.col("v_over"), F.col("v"))})
    each = found.groupBy(*KEY).agg(F.round(F.max("v_threshold"), 6).alias("threshold"), F.count_if("v_over").alias("n_anomaly"))
    return scenes.joined(each, shares, KEY).select(*KEY, "threshold", "n_anomaly", F.round("ratio", 6).alias("ratio"))


@query("scene_mean_std", f"{_V}, t AS (SELECT event_type, avg(v) + 2 * stddev_pop(v) AS thr FROM ix GROUP BY event_type) {_COUNTED}")
def scene_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "mean_std")


@query("scene_p95", f"{_V}, t AS (SELECT event_type, quantile_cont(v, 0.95) AS thr FROM ix GROUP BY event_type) {_COUNTED}")
def scene_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "percentile")


@query("scene_median_mad", f"""{_V}, m AS (SELECT event_type, median(v) AS med FROM ix GROUP BY event_type),
 t AS (SELECT ix.event_type, max(med) + 2 * 1.4826 * median(abs(v - med)) AS thr FROM ix JOIN m ON ix.event_type = m.event_type GROUP BY ix.event_type) {_COUNTED}""")
def scene_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "median_mad")


def _between(value: str, low: str, high: str, least: str) -> str:
    return f"greatest(least(({value} - {low}) / {least.format(f'{high} - {low}')}, 1.0), 0.0)"


@query("scene_normalized", f"""WITH {views.RASTER}, q AS (SELECT event_type, quantile_cont(B1, 0.02) AS l1, quantile_cont(B1, 0.98) AS h1, quantile_cont(B4, 0.02) AS l4, quantile_cont(B4, 0.98) AS h4 FROM px GROUP BY event_type)
SELECT y, x, round(CASE WHEN h1 - l1 < 1e-9 THEN 0 ELSE {_between('B1', 'l1', 'h1', '({})')} END, 6)::DOUBLE AS n1, round(CASE WHEN h4 - l4 < 1e-9 THEN 0 ELSE {_between('B4', 'l4', 'h4', '({})')} END, 6)::DOUBLE AS n4
FROM px JOIN q ON px.event_type = q.event_type""")
def scene_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scenes.between_quantiles(views.raster(spark, sf_dir), KEY, {"n1": F.col("B1"), "n4": F.col("B4")})
    return out.select("y", "x", *[F.round(c, 6).alias(c) for c in ("n1", "n4")])


@query("scene_stretch", f"""WITH {views.RASTER}, s AS (SELECT y, x, event_type, B1 - 40 AS a, B4 - 20 AS b FROM px),
 q AS (SELECT event_type, quantile_cont(CASE WHEN a > 0 THEN a END, 0.02) al, quantile_cont(CASE WHEN a > 0 THEN a END, 0.98) ah, quantile_cont(CASE WHEN b > 0 THEN b END, 0.02) bl, quantile_cont(CASE WHEN b > 0 THEN b END, 0.98) bh FROM s GROUP BY event_type)
SELECT y, x, round(coalesce(pow({_between('a', 'al', 'ah', 'greatest({}, 1e-6)')}, 0.8), 0.0), 6)::DOUBLE AS red, round(coalesce(pow({_between('b', 'bl', 'bh', 'greatest({}, 1e-6)')}, 0.8), 0.0), 6)::DOUBLE AS green
FROM s JOIN q ON s.event_type = q.event_type""")
def scene_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir).select("y", "x", "event_type", (F.col("B1") - 40).alias("a"), (F.col("B4") - 20).alias("b"))
    out = scenes.stretched(px, KEY, {"red": F.col("a"), "green": F.col("b")}, gamma=0.8)
    return out.select("y", "x", *[F.round(c, 6).alias(c) for c in ("red", "green")])


@query("scene_soft_over", f"""{_V}, t AS (SELECT event_type, avg(v) + 2 * stddev_pop(v) AS thr FROM ix GROUP BY event_type),
 m AS (SELECT ix.event_type, max(thr) AS thr, quantile_cont(CASE WHEN v > thr THEN v END, 0.95) AS top, max(v) AS most FROM ix JOIN t ON ix.event_type = t.event_type GROUP BY ix.event_type)
SELECT y, x, round(coalesce(greatest(least((v - thr) / greatest(coalesce(top, most) - thr, 1e-6), 1.0), 0.0), 0.0), 6)::DOUBLE AS soft FROM ix JOIN m ON ix.event_type = m.event_type""")
def scene_soft_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _index(spark, sf_dir)
    limits = scenes.thresholds(ix, KEY, {"threshold": F.col("v")})
    return scenes.soft_over(ix, KEY, F.col("v"), limits).select("y", "x", F.round("soft", 6).alias("soft"))


@query("scene_proximity", f"""WITH {views.RASTER}, m AS (SELECT event_type, coalesce(nullif(median(B4 * 6), 0), 1.0) AS s FROM px GROUP BY event_type)
SELECT y, x, round(coalesce(exp(-B4 * 6 / (s + 1e-9)), 0.0), 6)::DOUBLE AS proximity FROM px JOIN m ON px.event_type = m.event_type""")
def scene_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.proximity(views.raster(spark, sf_dir), KEY, F.col("B4") * 6).select("y", "x", F.round("proximity", 6).alias("proximity"))
