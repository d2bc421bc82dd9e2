"""Queries on radar pairs and on grids: rates, coherence, clusters, crossings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import deformation, grid, spatial, stats
from regolith.plans import views
from regolith.plans.catalog import query

_RATES = f"""WITH {views.RADAR}, r AS (SELECT y, x, coherence, CASE WHEN coherence >= 0.3 THEN disp * 365.25 / (sec_date - ref_date) END AS rate FROM obs WHERE sec_date > ref_date),
 v AS (SELECT y, x, median(rate) AS velocity, count(rate) AS n_valid FROM r GROUP BY y, x)"""


def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deformation.velocity(deformation.rates(views.radar(spark, sf_dir)))


@query("velocity_trend", f"{_RATES} SELECT y, x, round(velocity, 4) AS velocity, n_valid FROM v")
def velocity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _velocity(spark, sf_dir).select("y", "x", F.round("velocity", 4).alias("velocity"), "n_valid")


@query("velocity_stats", f"""{_RATES} SELECT round(avg(velocity), 4) AS mean_velocity, round(median(velocity), 4) AS median_velocity, round(min(velocity), 4) AS subsidence_max, round(max(velocity), 4) AS uplift_max FROM v""")
def velocity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deformation.velocity_summary(_velocity(spark, sf_dir))
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


_NULLED = f"WITH {views.RADAR}, o AS (SELECT y, x, CASE WHEN pair % 97 <> 0 THEN coherence END AS coherence FROM obs)"


@query("coherence_median_strict", f"{_NULLED} SELECT y, x, round(CASE WHEN count(*) = count(coherence) THEN median(coherence) END, 6) AS coherence FROM o GROUP BY y, x")
def coherence_median_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = views.radar(spark, sf_dir).withColumn("coherence", F.when(F.col("pair") % 97 != 0, F.col("coherence")))
    return deformation.strict_median_coherence(gaps).select("y", "x", F.round("coherence", 6).alias("coherence"))


@query("coherence_stability", f"""WITH {views.RADAR}, c AS (SELECT greatest(least(coherence, 1), 0) AS c FROM obs)
SELECT round(avg(c), 6) AS mean, round(median(c), 6) AS median, round(count(CASE WHEN c < 0.3 THEN 1 END) / count(*)::DOUBLE, 6) AS low_coherence_ratio FROM c""")
def coherence_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deformation.stability(views.radar(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("coherence_decay", f"""WITH {views.RADAR}, p AS (SELECT pair, sec_date - ref_date AS baseline, avg(coherence + 0.0001 * (sec_date - ref_date) * -1) AS c FROM obs WHERE sec_date > ref_date GROUP BY ALL),
 f AS (SELECT regr_slope(ln(greatest(least(c, 1.0), 1e-6)), baseline) AS slope, count(*) AS samples FROM p WHERE c > 0)
SELECT round(CASE WHEN samples >= 3 AND slope < 0 THEN -1 / slope END, 3) AS tau_days, samples FROM f""")
def coherence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("sec_date", "ref_date")
    falling = views.radar(spark, sf_dir).where(days > 0).withColumn("baseline", days)
    pairs = falling.groupBy("pair", "baseline").agg(F.avg(F.col("coherence") - 0.0001 * F.col("baseline")).alias("coherence"))
    return deformation.decay(pairs).select(F.round("tau_days", 3).alias("tau_days"), "samples")


@query("deformation_fusion", f"""WITH {views.RASTER}, s AS (SELECT y, x, abs(B1 - 80) AS v, B4 AS m, B2 / 24 AS coh FROM px),
 q AS (SELECT quantile_cont(v, 0.02) vl, quantile_cont(v, 0.98) vh, quantile_cont(m, 0.02) ml, quantile_cont(m, 0.98) mh FROM s),
 f AS (SELECT y, x, CASE WHEN coh >= 0.3 THEN 0.5 * greatest(least((v - vl) / (vh - vl), 1), 0) + 0.5 * greatest(least((m - ml) / (mh - ml), 1), 0) ELSE 0 END AS score FROM s, q),
 t AS (SELECT quantile_cont(score, 0.95) AS thr FROM f)
SELECT y, x, round(score, 6)::DOUBLE AS score, score >= thr AS high FROM f, t""")
def deformation_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir).withColumns({"velocity": F.col("B1") - 80, "mineral": F.col("B4"), "coherence": F.col("B2") / 24})
    return deformation.analyze(px, "fusion_mineral").select("y", "x", F.round("score", 6).alias("score"), "high")


def _along(by: str, along: str, reach: int = 2) -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {along} RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"


_CLOSED = f"""WITH {views.RASTER}, m AS (SELECT y, x, B1, B2, B4, (B1 > 200)::INT AS c FROM px), d1 AS (SELECT * REPLACE (max(c) {_along('y', 'x')} AS c) FROM m), d2 AS (SELECT * REPLACE (max(c) {_along('x', 'y')} AS c) FROM d1),
 e1 AS (SELECT * REPLACE ((min(c) {_along('y', 'x')} = 1 AND count(*) {_along('y', 'x')} = 5)::INT AS c) FROM d2), closed AS (SELECT * REPLACE ((min(c) {_along('x', 'y')} = 1 AND count(*) {_along('x', 'y')} = 5)::INT AS c) FROM e1)"""


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.closing(views.raster(spark, sf_dir), deformation.active(F.col("B1"), least=200.0001))


@query("binary_closing", f"{_CLOSED} SELECT y, x, c AS closed FROM closed")
def binary_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir).select("y", "x", "closed")


#: Labels spread over cells that touch by a side; the least (y, x) of a component wins.
_LABELS = _CLOSED.replace("WITH px", "WITH RECURSIVE px", 1) + """, cells AS (SELECT y, x, y * 100000 + x AS id, B1, B2, B4 FROM closed WHERE c = 1),
 reach(id, top) AS (SELECT id, id FROM cells UNION SELECT c.id, r.top FROM reach r JOIN cells p ON p.id = r.id JOIN cells c ON abs(c.y - p.y) + abs(c.x - p.x) = 1 WHERE r.top < c.id),
 labels AS (SELECT id, min(top) AS top FROM reach GROUP BY id), marked AS (SELECT c.*, l.top // 100000 AS label_y, l.top % 100000 AS label_x FROM cells c JOIN labels l ON c.id = l.id)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = _closed(spark, sf_dir).where("closed = 1").select("scene", "y", "x")
    return grid.components(closed).select("scene", "y", "x", F.col("label.y").alias("label_y"), F.col("label.x0").alias("label_x"))


@query("connected_components", f"{_LABELS} SELECT y, x, label_y, label_x FROM marked")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("y", "x", "label_y", "label_x")


@query("cluster_filter", f"{_LABELS} SELECT label_y, label_x, count(*) AS pixels FROM marked GROUP BY label_y, label_x HAVING count(*) >= 30")
def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("label_y", "label_x").agg(F.count("*").alias("pixels")).where("pixels >= 30")


@query("attribute_clusters", f"""{_LABELS}, a AS (SELECT label_y, label_x, count(*) AS pixels, avg(B1 - 150) AS v, avg(B4 * 6) AS d, avg(B2) AS s FROM marked GROUP BY label_y, label_x)
SELECT label_y, label_x, pixels, round(v, 4) AS mean_velocity, CASE WHEN s >= 13 THEN 'landslide' WHEN d <= 300 THEN 'active_fault' WHEN v < 0 THEN 'subsidence' ELSE 'uplift_other' END AS kind FROM a""")
def attribute_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = views.raster(spark, sf_dir).select("y", "x", (F.col("B1") - 150).alias("v"), (F.col("B4") * 6).alias("d"), F.col("B2").alias("s"))
    clusters = _labelled(spark, sf_dir).join(layers, ["y", "x"]).withColumn("label", F.struct("label_y", "label_x"))
    found = grid.attribute(clusters, "v", "d", "s", steep=13.0)
    return found.select("label.label_y", "label.label_x", "pixels", F.round("mean_velocity", 4).alias("mean_velocity"), "kind")


#: A line for each customer through all of their orders, each vertex within 1.2 of the customer's site, so that only neighbours' lines
#: meet and the rows grow with the table. Sites stand in rows of so many, one unit apart.
SITES = 100
_CROSSED = f"""WITH pts AS (SELECT o_custkey AS line, o_orderkey AS seq, o_custkey % {SITES} + (o_totalprice * 100) % 997 * 1.2 / 997 AS lon, o_custkey // {SITES} + o_orderkey * 37 % 1009 * 1.2 / 1009 AS lat FROM orders),
 s AS (SELECT line, seq, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY line ORDER BY seq)),
 t AS (SELECT *, unnest(range(floor(least(x1, x2))::BIGINT, floor(greatest(x1, x2))::BIGINT + 1)) AS cx FROM s WHERE x2 IS NOT NULL),
 p AS (SELECT DISTINCT a.line AS line_a, a.seq AS seq_a, b.line AS line_b, b.seq AS seq_b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS d, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS tn,
       (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS un, a.x1, a.y1, a.x2, a.y2
       FROM t a JOIN t b ON a.cx = b.cx AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) WHERE (a.line, a.seq) < (b.line, b.seq)),
 c AS (SELECT line_a, seq_a, line_b, seq_b, round(x1 + tn / d * (x2 - x1), 6)::DOUBLE AS x, round(y1 + tn / d * (y2 - y1), 6)::DOUBLE AS y FROM p WHERE abs(d) >= 1e-12 AND tn / d BETWEEN 0 AND 1 AND un / d BETWEEN 0 AND 1)"""


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    site, key = F.col("o_custkey"), F.col("o_orderkey")
    points = views.read(spark, sf_dir, "orders").select(
        site.alias("line_id"), key.alias("seq"), (site % SITES + F.pmod(F.col("o_totalprice") * 100, F.lit(997)) * 1.2 / 997).alias("lon"), (F.floor(site / SITES) + key * 37 % 1009 * 1.2 / 1009).alias("lat")
    )
    return grid.crossings(grid.segments(points))


@query("segment_intersections", f"{_CROSSED} SELECT x, y, count(*) AS crossings FROM c GROUP BY x, y")
def segment_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct points where segments of any lines cross."""
    return grid.crossing_points(_crossed(spark, sf_dir), 6)


@query("segment_intersections_all", f"{_CROSSED} SELECT * FROM c")
def segment_intersections_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of segments that cross."""
    found = _crossed(spark, sf_dir)
    return found.select(
        F.col("seg_a.line").alias("line_a"), F.col("seg_a.seq").alias("seq_a"), F.col("seg_b.line").alias("line_b"), F.col("seg_b.seq").alias("seq_b"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


_COHERENCE = "CASE WHEN (y * 100 + x) % 97 <> 5 THEN B2 / 24 END"


def _lineaments_sql() -> str:
    """The whole chain in SQL: smoothing along rows and columns with the edge mirrored, means along lines with the edge repeated."""
    sigma, reach = 0.8, spatial.gaussian_reach(0.8)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    weights = ", ".join(f"({d}, {w / sum(raw)!r})" for d, w in zip(range(-reach, reach + 1), raw, strict=True))
    lines = ", ".join(f"({k}, {dy}, {dx}, {1 / len(own)!r})" for k, own in enumerate(spatial.line_offsets()) for dy, dx in own)

    def mirrored(i: str, n: str) -> str:
        return f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"

    return f"""WITH {views.RASTER}, c AS (SELECT y, x, {_COHERENCE} AS coh FROM px), n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM c),
 low AS MATERIALIZED (SELECT y, x, greatest(0.3 - least(greatest(coalesce(coh, 1.0), 0.0), 1.0), 0.0)::DOUBLE AS v FROM c), g(d, wt) AS (VALUES {weights}), o(k, dy, dx, wt) AS (VALUES {lines}),
 gx AS MATERIALIZED (SELECT l.y, l.x, sum(s.v * g.wt) AS v FROM low l CROSS JOIN n CROSS JOIN g JOIN low s ON s.y = l.y AND s.x = {mirrored('l.x + g.d', 'n.w')} GROUP BY l.y, l.x),
 gy AS MATERIALIZED (SELECT l.y, l.x, sum(s.v * g.wt) AS v FROM gx l CROSS JOIN n CROSS JOIN g JOIN gx s ON s.x = l.x AND s.y = {mirrored('l.y + g.d', 'n.h')} GROUP BY l.y, l.x),
 p AS MATERIALIZED (SELECT l.y, l.x, o.k, o.wt, least(greatest(l.y + o.dy, 0), n.h - 1) AS sy, least(greatest(l.x + o.dx, 0), n.w - 1) AS sx FROM c l CROSS JOIN n CROSS JOIN o),
 r AS (SELECT p.y, p.x, p.k, sum(s.v * p.wt) AS v FROM p JOIN gy s ON s.y = p.sy AND s.x = p.sx GROUP BY p.y, p.x, p.k),
 m AS (SELECT y, x, round(max(v), 12)::DOUBLE AS v FROM r GROUP BY y, x), f AS MATERIALIZED (SELECT m.y, m.x, CASE WHEN coh IS NOT NULL THEN v END AS v FROM m JOIN c ON m.y = c.y AND m.x = c.x),
 q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM f), st AS (SELECT y, x, CASE WHEN v IS NOT NULL THEN greatest(least((v - lo) / (hi - lo + 1e-9), 1.0), 0.0) END AS v FROM f, q),
 t AS (SELECT quantile_cont(v, 0.9) AS thr FROM st)
SELECT y, x, round(v, 6)::DOUBLE AS strength, coalesce(thr > 1e-4 AND v >= thr - 1e-9 AND v > 1e-4, FALSE) AS lineament FROM st, t"""


@query("coherence_lineaments", _lineaments_sql())
def coherence_lineaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of low coherence; some pixels have none."""
    return deformation.lineaments(views.raster(spark, sf_dir), F.expr(_COHERENCE)).select("y", "x", F.round("strength", 6).alias("strength"), "lineament")


_SUMS = ", avg(CASE WHEN B1 <= 200 THEN 0 WHEN B2 > 12 THEN 9 ELSE -9 END) AS v, avg(B4 * 6) AS d, avg(B2) AS s"


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    velocity = F.when(F.col("B1") <= 200, 0.0).when(F.col("B2") > 12, 9.0).otherwise(-9.0)
    return views.raster(spark, sf_dir).withColumns({"velocity": velocity, "coherence": F.lit(1.0), "distance": F.col("B4") * 6, "slope": F.col("B2")})


@query("velocity_clusters", f"""{_LABELS}, k AS (SELECT label_y, label_x FROM marked GROUP BY label_y, label_x HAVING count(*) >= 30), f AS (SELECT m.* FROM marked m JOIN k ON m.label_y = k.label_y AND m.label_x = k.label_x)
SELECT (SELECT count(*) FROM k) AS clusters, round(count(*) / (SELECT count(*) FROM px)::DOUBLE, 6) AS active_ratio, round(count(CASE WHEN B1 < 250 THEN 1 END) / greatest(count(*), 1)::DOUBLE, 6) AS subsidence_ratio FROM f""")
def velocity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.raster(spark, sf_dir).withColumn("fast", F.when(F.col("B1") > 200, F.lit(9.0)).otherwise(F.lit(0.0)))
    found, _ = deformation.clusters(px, F.col("fast"), least_pixels=30)
    speed = px.select("scene", "y", "x", (F.col("B1") - 250).alias("velocity"))
    down = found.drop("velocity").join(speed, ["scene", "y", "x"])
    every = px.agg(F.count("*").alias("every"))
    one = down.agg(F.countDistinct("label").alias("clusters"), F.count("*").alias("n"), F.count_if(F.col("velocity") < 0).alias("down")).crossJoin(every)
    return one.select("clusters", F.round(F.col("n") / F.col("every"), 6).alias("active_ratio"), F.round(F.col("down") / F.greatest("n", F.lit(1)), 6).alias("subsidence_ratio"))


@query("deformation_modes", f"""{_LABELS}, a AS (SELECT label_y, label_x{_SUMS} FROM marked GROUP BY label_y, label_x HAVING count(*) >= 20),
 k AS (SELECT CASE WHEN s >= 13 THEN 'landslide' WHEN d <= 300 THEN 'active_fault' WHEN v < 0 THEN 'subsidence' ELSE 'uplift_other' END AS kind FROM a)
SELECT n.kind, n.code, count(k.kind) AS clusters FROM (VALUES ('active_fault', 1), ('landslide', 2), ('subsidence', 3), ('uplift_other', 4)) n(kind, code) LEFT JOIN k ON k.kind = n.kind GROUP BY n.kind, n.code""")
def deformation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of moving clusters, by the structural mode of the analysis, counted with zeros."""
    found = deformation.analyze(_moving(spark, sf_dir), "structural_attribution", least_pixels=20, steep=13.0)
    return grid.kind_counts(found)


_STACK = f"""WITH {views.RADAR}, d AS (SELECT pair, y, x, ref_date, sec_date, avg(disp) AS disp, min(coherence) AS coherence FROM obs GROUP BY ALL),
 c AS (SELECT pair, y, x, CASE WHEN (y + x) % 7 <> 0 THEN coherence END AS coherence FROM d WHERE pair % 4 <> 0 AND x % 9 <> 0)"""


@query("radar_stack", f"""{_STACK}, j AS (SELECT d.y, d.x, d.disp * 365.25 / (d.sec_date - d.ref_date) AS rate, c.coherence, d.pair IN (SELECT pair FROM c) AS layered FROM d LEFT JOIN c ON d.pair = c.pair AND d.y = c.y AND d.x = c.x WHERE d.sec_date > d.ref_date),
 r AS (SELECT y, x, CASE WHEN NOT layered OR coalesce(coherence >= 0.3, FALSE) THEN rate END AS rate FROM j)
SELECT y, x, round(median(rate), 4) AS velocity, count(rate) AS n_valid FROM r GROUP BY y, x""")
def radar_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement of all pairs with the coherence of those that have a layer, which lacks some pixels and has gaps in others."""
    own = views.radar(spark, sf_dir).groupBy("pair", "y", "x", "ref_date", "sec_date").agg(F.avg("disp").alias("disp"), F.min("coherence").alias("coherence"))
    layer = own.where("pair % 4 <> 0 AND x % 9 <> 0").select("pair", "y", "x", F.when((F.col("y") + F.col("x")) % 7 != 0, F.col("coherence")).alias("coherence"))
    found = deformation.velocity(deformation.rates(deformation.stack(own.drop("coherence"), layer)))
    return found.select("y", "x", F.round("velocity", 4).alias("velocity"), "n_valid")
