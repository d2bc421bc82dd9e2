"""Queries on pixels: formulas, thresholds, components, indices, scores, evidence."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import bands as b
from regolith.operators import batch, evidence, grid, moments, pca, stats, unmixing
from regolith.plans import views
from regolith.plans.catalog import query
from regolith.session import shared_folder
from regolith.sources import rasters


def _bands() -> dict:
    return {f"B{i}": F.col(f"B{i}") for i in range(1, 5)}


def _index(spark: SparkSession, sf_dir: str, formula: str = "(B1+B4)/(B2+B3)") -> DataFrame:
    return views.raster(spark, sf_dir).withColumn("v", b.band_expression(formula, _bands()))


_V = f"WITH {views.RASTER}, ix AS (SELECT *, CASE WHEN abs(B2 + B3) > 1e-6 THEN (B1 + B4) / (B2 + B3) END AS v FROM px)"


@query("anomaly_summary", f"""{_V}, t AS (SELECT avg(v) + 2 * stddev_pop(v) AS thr FROM ix)
SELECT event_type AS mineral, count(v) AS n_pixels, count(CASE WHEN v > thr THEN 1 END) AS n_anomaly,
       round(count(CASE WHEN v > thr THEN 1 END) / greatest(count(v), 1)::DOUBLE, 6) AS anomaly_ratio, round(max(thr), 6) AS threshold
FROM ix, t GROUP BY event_type""")
def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula, threshold and anomaly counts of each mineral: two scans of the bands that the formula names."""
    ix = _index(spark, sf_dir)
    limit = stats.threshold(ix, F.col("v"))
    hit = stats.over(F.col("v"), limit)
    ratio = stats.anomaly_ratio(hit, F.col("v"))
    return ix.groupBy(F.col("event_type").alias("mineral")).agg(F.count("v").alias("n_pixels"), F.count_if(hit).alias("n_anomaly"), F.round(ratio, 6).alias("anomaly_ratio"), F.round(F.lit(limit), 6).alias("threshold"))


@query("ratio_safe", f"""WITH {views.SAMPLES}
SELECT l_returnflag, count(*) AS n, count(v) AS n_valid, round(avg(v), 4) AS mean_ratio
FROM (SELECT *, CASE WHEN abs(B3) > 1e-6 THEN B1 / B3 END AS v FROM px) GROUP BY l_returnflag""")
def ratio_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.samples(spark, sf_dir).withColumn("v", b.band_expression("B1/B3", _bands()))
    return px.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.round(F.avg("v"), 4).alias("mean_ratio"))


@query("ratio_nested", f"""WITH {views.RASTER}
SELECT y, x, round(CASE WHEN abs(B1 + B2) > 1e-6 THEN (B1 - B2) / (B1 + B2) END + 0.5 * B3 - (-B4), 6) AS value FROM px""")
def ratio_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "(B1-B2)/(B1+B2) + 0.5*B3 - (-B4)").select("y", "x", F.round("v", 6).alias("value"))


def _threshold_sql(value: str, extra: str = "") -> str:
    return f"{_V}{extra}, t AS (SELECT {value} AS thr FROM ix) SELECT round(max(thr), 6) AS threshold, count(CASE WHEN v > thr THEN 1 END) AS n_anomaly FROM ix, t"


def _thresholded(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    ix = _index(spark, sf_dir)
    limit = stats.threshold(ix, F.col("v"), method)
    return ix.agg(F.round(F.lit(limit), 6).alias("threshold"), F.count_if(stats.over(F.col("v"), limit)).alias("n_anomaly"))


@query("threshold_mean_std", _threshold_sql("avg(v) + 2 * stddev_pop(v)"))
def threshold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thresholded(spark, sf_dir, "mean_std")


@query("threshold_p95", _threshold_sql("quantile_cont(v, 0.95)"))
def threshold_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thresholded(spark, sf_dir, "percentile")


@query("threshold_median_mad", f"""{_V}, m AS (SELECT median(v) AS med FROM ix), t AS (SELECT max(med) + 2 * 1.4826 * median(abs(v - med)) AS thr FROM ix, m)
SELECT round(max(thr), 6) AS threshold, count(CASE WHEN v > thr THEN 1 END) AS n_anomaly FROM ix, t""")
def threshold_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thresholded(spark, sf_dir, "median_mad")


#: A polygon with a hole, as rings of (x, y).
REGION = [[(10.2, 0.7), (80.6, 1.3), (70.4, 60.8), (20.1, 90.5)], [(30.5, 5.5), (50.5, 5.5), (50.5, 8.4), (30.5, 8.4)]]


def _inside_sql() -> str:
    parts = [f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < {x2 - x1} * (y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for ring in REGION for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True) if y1 != y2]
    return f"(({' + '.join(parts)}) % 2 = 1)"


def _region():
    return grid.inside(F.col("x").cast("double"), F.col("y").cast("double"), REGION)


@query("roi_point_in_polygon", f"WITH {views.RASTER} SELECT y, count(*) AS n_inside, min(x) AS first_x, max(x) AS last_x FROM px WHERE {_inside_sql()} GROUP BY y")
def roi_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raster(spark, sf_dir).where(_region()).groupBy("y").agg(F.count("*").alias("n_inside"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))


@query("anomaly_ratio_roi", f"""{_V}, r AS (SELECT *, {_inside_sql()} AS roi FROM ix), t AS (SELECT avg(v) + 2 * stddev_pop(v) AS thr FROM r WHERE roi)
SELECT round(count(CASE WHEN roi AND v > thr THEN 1 END) / greatest(count(CASE WHEN roi THEN 1 END), 1)::DOUBLE, 6) AS ratio FROM r, t""")
def anomaly_ratio_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _index(spark, sf_dir).withColumn("roi", _region())
    limit = stats.threshold(ix.where("roi"), F.col("v"))
    return ix.agg(F.round(stats.anomaly_ratio(stats.over(F.col("v"), limit), F.col("v"), F.col("roi")), 6).alias("ratio"))


@query("anomaly_ratio_noroi", f"""WITH {views.SAMPLES}, ix AS (SELECT CASE WHEN abs(B3) > 1e-6 THEN B1 / B3 END AS v FROM px), t AS (SELECT avg(v) + 2 * stddev_pop(v) AS thr FROM ix)
SELECT round(count(CASE WHEN v > thr THEN 1 END) / greatest(count(v), 1)::DOUBLE, 6) AS ratio FROM ix, t""")
def anomaly_ratio_noroi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = views.samples(spark, sf_dir).select(b.band_expression("B1/B3", _bands()).alias("v"))
    limit = stats.threshold(ix, F.col("v"))
    return ix.agg(F.round(stats.anomaly_ratio(stats.over(F.col("v"), limit), F.col("v")), 6).alias("ratio"))


@query("dn_scaling", f"""WITH {views.RASTER}, m AS (SELECT greatest(max(B1), max(B2), max(B3), max(B4)) > 10 AS scale FROM px)
SELECT event_type, round(avg(CASE WHEN scale THEN B1 / 10000 ELSE B1 END), 8) AS b1, round(avg(CASE WHEN scale THEN B4 / 10000 ELSE B4 END), 8) AS b4 FROM px, m GROUP BY event_type""")
def dn_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = batch.scaled(views.raster(spark, sf_dir), ["B1", "B2", "B3", "B4"])
    return px.groupBy("event_type").agg(*[F.round(F.avg(c), 8).alias(c.lower()) for c in ("B1", "B4")])


_BOX = "max(x) AS east, min(x) AS west, max(y) AS north, min(y) AS south"


@query("bbox_overlap_join", f"""WITH {views.RASTER}, a AS (SELECT B3 AS roi, {_BOX} FROM px GROUP BY B3), c AS (SELECT (y // 7) AS product, {_BOX} FROM px GROUP BY y // 7)
SELECT a.roi, count(*) AS n_products, round(max(greatest(least(a.east, c.east) - greatest(a.west, c.west), 0) * greatest(least(a.north, c.north) - greatest(a.south, c.south), 0)), 4)::DOUBLE AS best_area
FROM a JOIN c ON NOT (a.east < c.west OR a.west > c.east OR a.north < c.south OR a.south > c.north) GROUP BY a.roi""")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    sides = [F.max("x").alias("east"), F.min("x").alias("west"), F.max("y").alias("north"), F.min("y").alias("south")]
    rois = px.groupBy(F.col("B3").alias("roi")).agg(*sides)
    products = px.groupBy(F.floor(F.col("y") / 7).alias("product")).agg(*sides)
    area = grid.overlap_area(*({k: F.col(f"{t}_{k}").cast("double") for k in ("west", "south", "east", "north")} for t in ("a", "b")))
    return grid.overlaps(rois, products).groupBy("roi").agg(F.count("*").alias("n_products"), F.round(F.max(area), 4).alias("best_area"))


@query("pca_cov_matrix", f"""WITH {views.RASTER} SELECT round(covar_samp(B1, B1), 4) AS c11, round(covar_samp(B1, B2), 4) AS c12, round(covar_samp(B1, B3), 4) AS c13,
 round(covar_samp(B2, B2), 4) AS c22, round(covar_samp(B2, B3), 4) AS c23, round(covar_samp(B3, B3), 4) AS c33 FROM px""")
def pca_cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    return views.raster(spark, sf_dir).agg(*[F.round(F.covar_samp(f"B{i}", f"B{j}"), 4).alias(f"c{i}{j}") for i, j in pairs])


@query("pca_k2_closed_form", f"""WITH {views.RASTER}, c AS (SELECT covar_samp(B1, B1) a, covar_samp(B1, B4) b, covar_samp(B4, B4) d, avg(B1) m1, avg(B4) m4 FROM px),
e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l FROM c), v AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS v1, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS v4 FROM e)
SELECT y, x, round(CASE WHEN v1 > 0 THEN 1 ELSE -1 END * ((B1 - m1) * v1 + (B4 - m4) * v4), 4) AS score FROM px, v""")
def pca_k2_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    _, mean, cov = pca.covariance(px, ["B1", "B4"])
    _, vectors = np.linalg.eigh(cov)
    first = pca.Component(mean, vectors[:, ::-1], 0, 1 if vectors[0, 1] > 0 else -1)
    return px.select("y", "x", F.round(pca.projection(first, ["B1", "B4"]), 4).alias("score"))


@query("pca_k4_loadings")
def pca_k4_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["B1", "B2", "B3", "B4"]
    own = pca.crosta(views.samples(spark, sf_dir), names, ["B4"], ["B2", "B3"])
    return spark.createDataFrame([(n, own.index + 1, own.sign, *map(float, row)) for n, row in zip(names, own.loadings, strict=True)], "band string, pc int, sign int, pc1 double, pc2 double, pc3 double, pc4 double")


@query("pca_k4_equations", f"""WITH {views.RASTER}, c AS (SELECT {', '.join(f'covar_samp(B{i}, B{j}) AS c{i}{j}' for i in range(1, 5) for j in range(1, 5))} FROM px)
SELECT * FROM ({' UNION ALL '.join(f'SELECT {i} AS i, {j} AS j, round(c{i}{j}, 4) AS covariance, {int(i == j)}::DOUBLE AS unit FROM c' for i in range(1, 5) for j in range(1, 5))})""")
def pca_k4_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the components' equations give back: the covariances from variances and loadings, and the products of loadings."""
    names = ["B1", "B2", "B3", "B4"]
    px = views.raster(spark, sf_dir)
    own = pca.crosta(px, names, ["B4"], ["B2"]).loadings
    variances = np.diag(own.T @ pca.covariance(px, names)[2] @ own)
    back, unit = own @ np.diag(variances) @ own.T, own @ own.T
    rows = [(i + 1, j + 1, float(back[i, j]), float(unit[i, j])) for i in range(4) for j in range(4)]
    found = spark.createDataFrame(rows, "i int, j int, covariance double, unit double")
    return found.select("i", "j", F.round("covariance", 4).alias("covariance"), F.round(F.abs("unit"), 6).alias("unit"))


_PAIRS = f"""WITH {views.SPECTRA}, v AS (SELECT vec_id, unnest(s) AS x, unnest(range(1, 65)) AS i FROM cube), m AS (SELECT i, avg(x) AS mean FROM v GROUP BY i),
 d AS (SELECT vec_id, v.i, x - mean AS x FROM v JOIN m ON v.i = m.i), c AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM d a JOIN d b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)"""


@query("spectrum_covariance", f"{_PAIRS} SELECT i::INT AS i, j::INT AS j, round(c, 8) AS covariance FROM c")
def spectrum_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All covariances of the 64 bands of the spectra, by one scan."""
    _, _, found = moments.covariance(views.spectra(spark, sf_dir).select("spectrum"))
    rows = [(i + 1, j + 1, float(found[i, j])) for i in range(len(found)) for j in range(len(found))]
    return spark.createDataFrame(rows, "i int, j int, covariance double").withColumn("covariance", F.round("covariance", 8))


@query("spectrum_components", f"{_PAIRS} SELECT round(sum(CASE WHEN i = j THEN c END), 6) AS variance, round(sum(c * c), 6) AS squares, (SELECT count(*) FROM cube) AS n FROM c")
def spectrum_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectra on all their components: the variances of the scores add up to the covariance's trace, their squares to the sum of its
    squared entries, and scores of different components go apart."""
    spectra = views.spectra(spark, sf_dir)
    _, mean, found = moments.covariance(spectra.select("spectrum"))
    loadings = np.linalg.eigh(found)[1][:, ::-1]
    scores = moments.projected(spectra, "spectrum", mean, loadings)
    by = scores.select(F.posexplode("scores").alias("k", "score")).groupBy("k").agg(F.var_samp("score").alias("variance"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum("variance"), 6).alias("variance"), F.round(F.sum(F.col("variance") ** 2), 6).alias("squares"), F.max("n").alias("n"))


def _safe(a: str, c: str) -> str:
    return f"CASE WHEN abs({c}) > 1e-6 THEN ({a}) / ({c}) END"


@query("nd_indices", f"""WITH {views.SAMPLES} SELECT l_orderkey, l_linenumber, round({_safe('B1 - B2', 'B1 + B2')}, 6) AS ndvi, round({_safe('B1 - B3', 'B1 + B3')}, 6) AS ndre,
 round({_safe('B4', 'B3')} - 1, 6) AS cire, round(705 + 35 * {_safe('(B1 + B4) / 2 - B2', 'B3 - B2')}, 6) AS rep,
 round({_safe('(B4 + B1) - (B2 + B3)', '(B4 + B1) + (B2 + B3)')}, 6) AS bsi FROM px""")
def nd_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(f"B{i}") for i in range(1, 5)]
    found = {"ndvi": b.ndvi(c[0], c[1]), "ndre": b.ndre(c[0], c[2]), "cire": b.cire(c[3], c[2]), "rep": b.rep(c[0], c[1], c[2], c[3]), "bsi": b.bsi(c[2], c[0], c[1], c[3])}
    return views.samples(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in found.items()])


def _at(target: float) -> str:
    own = b.window_bands(views.WAVELENGTHS, target)
    return "((" + " + ".join(f"s[{i + 1}]" for i in own) + f") / {len(own)})"


@query("reflectance_window", f"WITH {views.SPECTRA} SELECT vec_id, round({_at(0.665)}, 6) AS r665, round({_at(1.73)}, 6) AS r1730, round({_at(9.0)}, 6) AS r_last FROM cube")
def reflectance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"r665": 0.665, "r1730": 1.73, "r_last": 9.0}
    return views.spectra(spark, sf_dir).select("vec_id", *[F.round(b.reflectance_at(F.col("spectrum"), views.WAVELENGTHS, w), 6).alias(n) for n, w in names.items()])


_FRAC = (2.205 - 2.12) / (2.245 - 2.12)


@query("band_depth", f"""WITH {views.SPECTRA}, c AS (SELECT vec_id, {_at(2.205)} AS r, {_at(2.12)} + ({_at(2.245)} - {_at(2.12)}) * {_FRAC} AS k FROM cube)
SELECT vec_id, round(CASE WHEN k > 1e-4 THEN 1 - r / k END, 6) AS depth, round(CASE WHEN k > 1e-4 THEN -(1 - r / k) END, 6) AS faded FROM c""")
def band_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [b.band_depth(F.col("spectrum"), views.WAVELENGTHS, 2.205, (2.12, 2.245), s) for s in (1, -1)]
    return views.spectra(spark, sf_dir).select("vec_id", F.round(own[0], 6).alias("depth"), F.round(own[1], 6).alias("faded"))


_STRESS = f"""WITH {views.SPECTRA}, c AS (SELECT vec_id, label, {_at(0.665)} AS r, {_at(0.705)} AS e, {_at(0.8)} AS n FROM cube),
 d AS (SELECT vec_id, label, CASE WHEN ({_safe('n - r', 'n + r')}) > -0.2 THEN -({_safe('n - e', 'n + e')}) END AS stress FROM c)"""


@query("veg_stress_ndre", f"{_STRESS} SELECT vec_id, round(stress, 6) AS stress FROM d")
def veg_stress_ndre(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [b.reflectance_at(F.col("spectrum"), views.WAVELENGTHS, w) for w in (0.665, 0.705, 0.740, 0.783, 0.800)]
    return views.spectra(spark, sf_dir).select("vec_id", F.round(b.vegetation_stress(*at, floor=-0.2), 6).alias("stress"))


_MASKS = f"WITH {views.SAMPLES}, m AS (SELECT *, B1 > 40 AS ratio, B4 > 0.06 AS pca, B3 < 0.02 AS depth, (l_orderkey % 3 + 1) AS priority FROM px)"
_WEIGHT = "CASE priority WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = {"ratio": F.col("B1") > 40, "pca": F.col("B4") > 0.06, "depth": F.col("B3") < 0.02, "priority": F.col("l_orderkey") % 3 + 1}
    return views.samples(spark, sf_dir).withColumns(masks)


@query("score_library", f"{_MASKS} SELECT priority, round(sum({_WEIGHT} * (ratio::INT + pca::INT) / 3.0), 4)::DOUBLE AS score FROM m GROUP BY priority")
def score_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = evidence.mineral_score({"ratio": F.col("ratio"), "pca": F.col("pca"), "band_depth": None}, F.col("priority"), "library")
    return _masks(spark, sf_dir).groupBy("priority").agg(F.round(F.sum(score), 4).alias("score"))


@query("score_route", f"{_MASKS} SELECT priority, round(sum({_WEIGHT} * (ratio::INT + pca::INT) / 2.0), 4)::DOUBLE AS score FROM m GROUP BY priority")
def score_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = evidence.mineral_score({"ratio": F.col("ratio"), "pca": F.col("pca"), "band_depth": None}, F.col("priority"))
    return _masks(spark, sf_dir).groupBy("priority").agg(F.round(F.sum(score), 4).alias("score"))


@query("score_hyper", f"""{_MASKS} SELECT priority, round(sum(ratio::INT * 1.0 + pca::INT * 0.5 + depth::INT * 0.25), 4)::DOUBLE AS score, count(CASE WHEN ratio::INT + pca::INT + depth::INT >= 2 THEN 1 END) AS high_confidence FROM m GROUP BY priority""")
def score_hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch.spectral_composite(_masks(spark, sf_dir), [("ratio", 1), ("pca", 2), ("depth", 3)])
    return found.groupBy("priority").agg(F.round(F.sum("score"), 4).alias("score"), F.count_if("high").alias("high_confidence"))


@query("mask_intersection", f"{_MASKS} SELECT l_returnflag, count(CASE WHEN ratio AND pca THEN 1 END) AS n_both, bool_or(ratio AND pca) AS any_both FROM m GROUP BY l_returnflag")
def mask_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = evidence.all_of([F.col("ratio"), F.col("pca")])
    return _masks(spark, sf_dir).groupBy("l_returnflag").agg(F.count_if(both).alias("n_both"), F.bool_or(both).alias("any_both"))


@query("or_masks", f"{_MASKS} SELECT l_returnflag, count(CASE WHEN ratio OR pca OR depth THEN 1 END) AS n_any, count(CASE WHEN ratio AND NOT pca THEN 1 END) AS n_only FROM m GROUP BY l_returnflag")
def or_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _masks(spark, sf_dir)
    return m.groupBy("l_returnflag").agg(F.count_if(evidence.any_of([m.ratio, m.pca, m.depth])).alias("n_any"), F.count_if(m.ratio & ~m.pca).alias("n_only"))


def _norm(c: str) -> str:
    return f"CASE WHEN {c}_h - {c}_l < 1e-9 THEN 0 ELSE greatest(least(({c} - {c}_l) / ({c}_h - {c}_l), 1.0), 0.0) END"


_Q = f"WITH {views.RASTER}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.02) AS {c}_l, quantile_cont({c}, 0.98) AS {c}_h" for c in ("B1", "B2", "B4")) + " FROM px)"


@query("normalize_p2_p98", f"{_Q} SELECT y, x, round({_norm('B1')}, 6)::DOUBLE AS n1, round({_norm('B4')}, 6)::DOUBLE AS n4 FROM px, q")
def normalize_p2_p98(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    own = stats.between_quantiles(px, {c: F.col(c) for c in ("B1", "B4")})
    return px.select("y", "x", F.round(own["B1"], 6).alias("n1"), F.round(own["B4"], 6).alias("n4"))


def _fused_sql(score: str) -> str:
    return f"{_Q}, f AS (SELECT y, x, {score} AS score FROM px, q), t AS (SELECT quantile_cont(score, 0.9) AS thr FROM f) SELECT y, x, round(score, 5)::DOUBLE AS score, score >= thr - 1e-9 AS high FROM f, t"


def _fused(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    layers = {"alteration": F.col("B1"), "structure": F.col("B2"), "soil": F.col("B4"), "constant": F.lit(1.0), "missing": F.lit(None).cast("double")}
    score, _ = evidence.fuse(px, layers, method)
    scored = px.select("y", "x", score.alias("score"))
    limit = stats.quantiles(scored, F.col("score"), [0.9])[0]
    return scored.select("y", "x", F.round("score", 5).alias("score"), (F.col("score") >= limit - 1e-9).alias("high"))


@query("fuse_weighted", _fused_sql(f"least(greatest((0.3 * {_norm('B1')} + 0.2 * {_norm('B2')} + 0.1 * {_norm('B4')}) / 0.6, 0.0), 1.0)"))
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "weighted_sum")


@query("fuse_gamma", _fused_sql(f"pow(1 - (1 - {_norm('B1')}) * (1 - {_norm('B2')}) * (1 - {_norm('B4')}), 0.9) * pow({_norm('B1')} * {_norm('B2')} * {_norm('B4')}, 0.1)"))
def fuse_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "fuzzy_gamma")


@query("proximity_exp", f"WITH {views.RASTER}, m AS (SELECT median(B4) AS s FROM px) SELECT y, x, round(exp(-B4 / (s + 1e-9)), 6) AS proximity FROM px, m")
def proximity_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    return px.select("y", "x", F.round(evidence.proximity(F.col("B4"), stats.quantiles(px, F.col("B4"), [0.5])[0]), 6).alias("proximity"))


@query("terrain_norm", f"WITH {views.RASTER}, m AS (SELECT avg(CASE WHEN B2 > 0 THEN B2 END) AS hs FROM px) SELECT y, x, round(B1 / greatest(least(B2 / (hs + 1e-6), 3.0), 0.3), 4) AS value FROM px, m")
def terrain_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    light = evidence.mean_light(px, F.col("B2"))
    return px.select("y", "x", F.round(evidence.terrain_normalized(F.col("B1"), F.col("B2"), light), 4).alias("value"))


@query("structural_weight", f"WITH {views.RASTER}, m AS (SELECT median(B4) AS s FROM px) SELECT y, x, round(B1 * (1 - 0.15 + 0.15 * exp(-B4 / (s + 1e-9))), 5) AS value FROM px, m")
def structural_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    near = evidence.proximity(F.col("B4"), stats.quantiles(px, F.col("B4"), [0.5])[0])
    return px.select("y", "x", F.round(evidence.structural_weight(F.col("B1"), near), 5).alias("value"))


@query("lineament_association", f"WITH {views.RASTER} SELECT count(*) AS n_anomaly, round(median(B4), 6) AS median_dist_m, round(avg((B4 <= 30)::INT), 6) AS frac_within_buffer FROM px WHERE B1 > 100")
def lineament_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.association(views.raster(spark, sf_dir), F.col("B1") > 100, F.col("B4"), 30.0)
    return found.select("n_anomaly", F.round("median_dist_m", 6).alias("median_dist_m"), F.round("frac_within_buffer", 6).alias("frac_within_buffer"))


_IDX = f"WITH {views.RASTER}, d AS (SELECT *, {_safe('B4 - B1', 'B4 + B1')} AS ndvi, {_safe('(B3 + B1) - (B4 + B2)', '(B3 + B1) + (B4 + B2)')} AS bsi FROM px)"


def _exposure_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(f"B{i}") for i in range(1, 5)]
    return views.raster(spark, sf_dir).withColumns({"ndvi": b.ndvi(c[3], c[0]), "bsi": b.bsi(c[1], c[0], c[3], c[2])})


@query("exposures", f"""{_IDX}, q AS (SELECT quantile_cont(ndvi, 0.02) nl, quantile_cont(ndvi, 0.98) nh, quantile_cont(bsi, 0.02) bl, quantile_cont(bsi, 0.98) bh FROM d)
SELECT event_type, count(CASE WHEN ndvi < 0.25 AND bsi > 0 THEN 1 END) AS exposure_pixels, round(count(CASE WHEN ndvi < 0.25 AND bsi > 0 THEN 1 END) / count(*)::DOUBLE, 6) AS exposure_ratio,
 round(avg(greatest(least((bsi - bl) / (bh - bl), 1), 0) * (1 - greatest(least((ndvi - nl) / (nh - nl), 1), 0))), 6) AS mean_score FROM d, q GROUP BY event_type""")
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _exposure_parts(spark, sf_dir)
    mask = unmixing.exposure(F.col("ndvi"), F.col("bsi"))
    score = unmixing.exposure_score(d, F.col("ndvi"), F.col("bsi"))
    return d.groupBy("event_type").agg(F.count_if(mask).alias("exposure_pixels"), F.round(F.count_if(mask) / F.count("*"), 6).alias("exposure_ratio"), F.round(F.avg(score), 6).alias("mean_score"))


def _member(name: str, score: str) -> str:
    return f"SELECT '{name}' AS name, " + ", ".join(f"round(avg(B{i}), 4) AS B{i}" for i in range(1, 5)) + f" FROM (SELECT * FROM d WHERE {score} IS NOT NULL ORDER BY {score} DESC, y, x LIMIT (SELECT greatest(5, floor(count({score}) * 0.02))::BIGINT FROM d))"


@query("endmembers", f"{_IDX} {_member('vegetation', 'ndvi')} UNION ALL {_member('rock_soil', 'bsi')} UNION ALL {_member('shade', '(-(B1 + B2 + B3 + B4) / 4)')}")
def endmembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["B1", "B2", "B3", "B4"]
    scores = {"vegetation": F.col("ndvi"), "rock_soil": F.col("bsi"), "shade": -(sum((F.col(c) for c in names[1:]), F.col("B1"))) / 4}
    found = unmixing.endmembers(_exposure_parts(spark, sf_dir), names, scores)
    return found.select("name", *[F.round(c, 4).alias(c) for c in names])


def _unmix_sql() -> str:
    """The least residual of the non-negative solutions for every set of members: each by Cramer's rule on the normal equations."""
    members = f"{_member('vegetation', 'ndvi')} UNION ALL {_member('rock_soil', 'bsi')} UNION ALL {_member('shade', '(-(B1 + B2 + B3 + B4) / 4)')}"
    names, bands = ("rock_soil", "shade", "vegetation"), range(1, 5)
    wide = ", ".join(f"max(CASE WHEN name = '{n}' THEN B{i} END) AS e{k}{i}" for k, n in enumerate(names) for i in bands)

    def dot(a: str, b: str) -> str:
        return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in bands) + ")"

    products = ", ".join([f"{dot(f'e{j}', f'e{k}')} AS g{j}{k}" for j in range(3) for k in range(3)] + [f"{dot(f'e{k}', 'B')} AS h{k}" for k in range(3)] + [f"{dot('B', 'B')} AS xx"])

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " + ".join(f"{'-' if k % 2 else ''}({m[0][k]}) * {det([[v for c, v in enumerate(row) if c != k] for row in m[1:]])}" for k in range(len(m))) + ")"

    sets = []
    for own in [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]:
        whole = det([[f"g{j}{k}" for k in own] for j in own])
        found = {k: f"{det([[f'h{j}' if c == k else f'g{j}{c}' for c in own] for j in own])} / {whole}" for k in own}
        sets.append("{" + ", ".join(f"a{k}: {found.get(k, '0.0::DOUBLE')}" for k in range(3)) + "}")
    best = "xx - 2 * (a.a0 * h0 + a.a1 * h1 + a.a2 * h2) + " + " + ".join(f"a.a{j} * a.a{k} * g{j}{k}" for j in range(3) for k in range(3))
    rmse = "sqrt((" + " + ".join(f"pow(n0 * e0{i} + n1 * e1{i} + n2 * e2{i} - B{i}, 2)" for i in bands) + ") / 4)"
    return f"""{_IDX}, m AS ({members}), w AS (SELECT {wide} FROM m), p AS (SELECT y, x, B1, B2, B3, B4, w.*, {products} FROM px, w),
 s AS (SELECT *, unnest([{", ".join(sets)}]) AS a FROM p), r AS (SELECT *, {best} AS rest FROM s WHERE a.a0 >= 0 AND a.a1 >= 0 AND a.a2 >= 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY rest) AS k FROM r), t AS (SELECT *, CASE WHEN a.a0 + a.a1 + a.a2 > 1e-9 THEN a.a0 + a.a1 + a.a2 ELSE 1 END AS total FROM o WHERE k = 1),
 n AS (SELECT *, a.a0 / total AS n0, a.a1 / total AS n1, a.a2 / total AS n2 FROM t)
SELECT y, x, round(n0, 4) AS rock_soil, round(n1, 4) AS shade, round(n2, 4) AS vegetation, round({rmse}, 4) AS rmse FROM n"""


@query("unmix_nnls", _unmix_sql())
def unmix_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = endmembers(spark, sf_dir).orderBy("name").collect()
    names = ["B1", "B2", "B3", "B4"]
    members = np.array([[r[c] for r in rows] for c in names])
    found = unmixing.unmix(views.raster(spark, sf_dir), names, members, [r["name"] for r in rows], solver=unmixing.solve_by_products)
    return found.select("y", "x", *[F.round(c, 4).alias(c) for c in ("rock_soil", "shade", "vegetation", "rmse")])


#: Minerals for the batch queries: two with both methods' worth of formulas, one of low priority that is left out, one that cannot work.
TARGETS = [
    batch.Target("iron", 1, ratio="B1/B4"),
    batch.Target("clay", 2, ratio="(B1+B4)/(B2+B3)"),
    batch.Target("salt", 3, ratio="B2/B3"),
    batch.Target("broken", 1, ratio="B1/B9"),
]
_BATCH = f"""WITH {views.RASTER}, ix AS (SELECT *, {_safe('B1', 'B4')} AS i, {_safe('B1 + B4', 'B2 + B3')} AS c FROM px), t AS (SELECT avg(i) + 2 * stddev_pop(i) AS ti, avg(c) + 2 * stddev_pop(c) AS tc FROM ix)"""


@query("batch_results", f"""{_BATCH}, m AS (SELECT i, c, coalesce(i > ti, FALSE) AS mi, coalesce(c > tc, FALSE) AS mc, ti, tc FROM ix, t)
SELECT 'iron' AS mineral, 1 AS priority, round(max(ti), 6) AS threshold, count(CASE WHEN mi THEN 1 END) AS n_anomaly, round(count(CASE WHEN mi THEN 1 END) / greatest(count(i), 1)::DOUBLE, 6) AS anomaly_ratio FROM m
UNION ALL SELECT 'clay', 2, round(max(tc), 6), count(CASE WHEN mc THEN 1 END), round(count(CASE WHEN mc THEN 1 END) / greatest(count(c), 1)::DOUBLE, 6) FROM m
UNION ALL SELECT 'broken', 1, NULL, 0, 0.0::DOUBLE""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch.analyze(views.raster(spark, sf_dir), TARGETS, ["ratio"]).results
    return found.select("mineral", "priority", F.round("threshold", 6).alias("threshold"), "n_anomaly", F.round("anomaly_ratio", 6).alias("anomaly_ratio"))


@query("batch_scores", f"""{_BATCH} SELECT y, x, (CASE WHEN i > ti THEN 1.0 ELSE 0 END + CASE WHEN c > tc THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM ix, t WHERE i > ti OR c > tc""")
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.analyze(views.raster(spark, sf_dir), TARGETS, ["ratio"]).layers.where("score > 0").select("y", "x", "score")


@query("batch_library", f"""WITH {views.RASTER}, ix AS (SELECT *, {_safe('B1', 'B4')} AS i, {_safe('B1 + B4', 'B2 + B3')} AS c, {_safe('B2', 'B3')} AS s FROM px),
 t AS (SELECT avg(i) + 2 * stddev_pop(i) AS ti, avg(c) + 2 * stddev_pop(c) AS tc, avg(s) + 2 * stddev_pop(s) AS ts FROM ix)
SELECT y, x, round((CASE WHEN i > ti THEN 1.0 ELSE 0 END + CASE WHEN c > tc THEN 0.5 ELSE 0 END + CASE WHEN s > ts THEN 0.25 ELSE 0 END) / 2, 6)::DOUBLE AS score FROM ix, t""")
def batch_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All targets, also of low priority, over the number of methods asked for."""
    return batch.analyze(views.raster(spark, sf_dir), TARGETS, ["ratio", "pca"], mode="library").layers.select("y", "x", F.round("score", 6).alias("score"))


@query("batch_with_prior", f"""{_BATCH}, m AS (SELECT median(B4) AS s FROM px)
SELECT y, x, round((CASE WHEN i > ti THEN 1.0 ELSE 0 END + CASE WHEN c > tc THEN 0.5 ELSE 0 END) * (1 - 0.15 + 0.15 * exp(-B4 / (s + 1e-9))), 6)::DOUBLE AS score FROM ix, t, m""")
def batch_with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir)
    near = evidence.proximity(F.col("B4"), stats.quantiles(px, F.col("B4"), [0.5])[0])
    return batch.analyze(px, TARGETS, ["ratio"], near=near).layers.select("y", "x", F.round("score", 6).alias("score"))


@query("batch_associations", f"""{_BATCH}, a AS (SELECT 'iron' AS mineral, B4 AS d FROM ix, t WHERE i > ti UNION ALL SELECT 'clay', B4 FROM ix, t WHERE c > tc)
SELECT mineral, count(d) AS n_near, round(median(d), 6) AS median_dist_m, round(avg((d <= 30)::INT), 6) AS frac_within_buffer FROM a GROUP BY mineral UNION ALL SELECT 'broken', NULL, NULL, NULL""")
def batch_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch.associations(batch.analyze(views.raster(spark, sf_dir), TARGETS, ["ratio"]), F.col("B4"), 30.0)
    return found.select("mineral", "n_near", F.round("median_dist_m", 6).alias("median_dist_m"), F.round("frac_within_buffer", 6).alias("frac_within_buffer"))


@query("alteration_single", f"""WITH {views.RASTER}, ix AS (SELECT {_safe('B4', 'B2')} AS v FROM px), t AS (SELECT avg(v) + 1.5 * stddev_pop(v) AS thr FROM ix)
SELECT 'iron_oxide' AS mineral, round(max(thr), 6) AS threshold, count(CASE WHEN v > thr THEN 1 END) AS n_anomaly, round(count(CASE WHEN v > thr THEN 1 END) / greatest(count(v), 1)::DOUBLE, 6) AS anomaly_ratio FROM ix, t""")
def alteration_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch.alteration(views.raster(spark, sf_dir), "Sentinel2_L2", "iron_oxide").results
    return found.select("mineral", F.round("threshold", 6).alias("threshold"), "n_anomaly", F.round("anomaly_ratio", 6).alias("anomaly_ratio"))


@query("sensor_totals", f"WITH {views.SAMPLES}, s AS (SELECT l_returnflag, count(*) AS roi, count(CASE WHEN B1 > 40 THEN 1 END) AS high FROM px GROUP BY l_returnflag) SELECT max(roi) AS roi_pixels, sum(high)::BIGINT AS high_pixels FROM s")
def sensor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = views.samples(spark, sf_dir).groupBy(F.col("l_returnflag").alias("sensor")).agg(F.count("*").alias("roi_pixels"), F.count_if(F.col("B1") > 40).alias("high_pixels"))
    return batch.sensor_totals(by)


@query("stretch_positive", f"""WITH {views.RASTER}, s AS (SELECT y, x, B1 - 40 AS a, B4 AS b FROM px), q AS (SELECT quantile_cont(CASE WHEN a > 0 THEN a END, 0.02) al, quantile_cont(CASE WHEN a > 0 THEN a END, 0.98) ah, quantile_cont(b, 0.02) bl, quantile_cont(b, 0.98) bh FROM s)
SELECT y, x, round(greatest(least((a - al) / greatest(ah - al, 1e-6), 1.0), 0.0), 6)::DOUBLE AS red, round(greatest(least((b - bl) / greatest(bh - bl, 1e-6), 1.0), 0.0), 6)::DOUBLE AS green FROM s, q""")
def stretch_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir).select("y", "x", (F.col("B1") - 40).alias("a"), "B4")
    own = stats.stretched(px, {"red": F.col("a"), "green": F.col("B4")})
    return px.select("y", "x", *[F.round(c, 6).alias(n) for n, c in own.items()])


@query("soft_over_threshold", f"""{_V}, t AS (SELECT avg(v) + 2 * stddev_pop(v) AS thr FROM ix), m AS (SELECT quantile_cont(CASE WHEN v > thr THEN v END, 0.95) AS top, max(v) AS most FROM ix, t)
SELECT y, x, round(coalesce(greatest(least((v - thr) / greatest(coalesce(top, most) - thr, 1e-6), 1.0), 0.0), 0.0), 6)::DOUBLE AS soft FROM ix, t, m""")
def soft_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _index(spark, sf_dir)
    return ix.select("y", "x", F.round(stats.soft_over(ix, F.col("v"), stats.threshold(ix, F.col("v"))), 6).alias("soft"))


#: A polygon of cells.
CELLS = [[(10, 0), (80, 4), (60, 9), (10, 8)]]


def _cells_sql() -> str:
    ring = CELLS[0]
    edges = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    crossed = [f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < {x2 - x1} * (y - {y1})::DOUBLE / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges if y1 != y2]
    drawn = []
    for (x1, y1), (x2, y2) in edges:
        if abs(x2 - x1) >= abs(y2 - y1):
            drawn.append(f"x BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND abs(y - ({y1} + (x - {x1}) * ({(y2 - y1) / (x2 - x1)!r}::DOUBLE))) <= 0.5")
        else:
            drawn.append(f"y BETWEEN {min(y1, y2)} AND {max(y1, y2)} AND abs(x - ({x1} + (y - {y1}) * ({(x2 - x1) / (y2 - y1)!r}::DOUBLE))) <= 0.5")
    return f"(({' + '.join(crossed)}) % 2 = 1 OR {' OR '.join(f'({d})' for d in drawn)})"


@query("roi_cells_outline", f"WITH {views.RASTER} SELECT y, count(*) AS n_inside, min(x) AS first_x, max(x) AS last_x FROM px WHERE {_cells_sql()} GROUP BY y")
def roi_cells_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of cells whose outline is inside."""
    cells = views.raster(spark, sf_dir).where(grid.inside_cells(F.col("x").cast("double"), F.col("y").cast("double"), CELLS))
    return cells.groupBy("y").agg(F.count("*").alias("n_inside"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))


@query("prospectivity_summary", f"""WITH {views.RASTER}, g AS (SELECT CASE WHEN {_inside_sql()} THEN (0.3 * greatest(least((B2 - q.l) / (q.h - q.l), 1.0), 0.0) + 0.2 * (CASE WHEN B4 > 50 THEN 1.0 ELSE 0.0 END)) / 0.5 END AS score FROM px, (SELECT quantile_cont(B2, 0.02) AS l, quantile_cont(B2, 0.98) AS h FROM px) q),
 t AS (SELECT quantile_cont(score, 0.9) AS thr FROM g)
SELECT round(max(thr), 6) AS threshold, round(avg(score), 6) AS score_mean FROM g, t""")
def prospectivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers within a region: light, and whether the soil index is high."""
    layers = {"alteration": F.col("B2"), "structure": F.when(F.col("B4") > 50, 1.0).otherwise(0.0)}
    _, summary = evidence.prospectivity(views.raster(spark, sf_dir), layers, roi=_region())
    return summary.select(F.round("threshold", 6).alias("threshold"), F.round("score_mean", 6).alias("score_mean"))


@query("tiff_round_trip", f"WITH {views.RASTER} SELECT event_type AS scene, y, x, B1 AS value FROM px WHERE B1 IS NOT NULL")
def tiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's cells written as a GeoTIFF file of one band and read back."""
    cells = views.raster(spark, sf_dir).select(F.col("event_type").alias("scene"), "y", "x", F.col("B1").alias("value"))
    folder = f"{shared_folder(spark)}/tiff-{uuid.uuid4().hex}"
    height = (cells.agg(F.max("y")).first()[0] or 0) + 1
    rasters.write_tiff(cells, folder, height, views.WIDTH, "f8")
    return rasters.read_tiff(spark, folder).where("value IS NOT NULL").select("scene", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")
