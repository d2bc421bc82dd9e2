"""Queries that write the tables as the files of a project and read them back: bands, scenes, radar stacks, lines, knowledge, runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import deformation, unmixing
from regolith.operators.run_store import RunStore
from regolith.plans import views
from regolith.plans.catalog import query
from regolith.session import shared_folder
from regolith.sources import datasource, layouts, projects, rasters


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def texts_written(files: DataFrame) -> int:
    """Writes each row (path, content) as a file and returns their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                layouts.folder_made(own["path"].rsplit("/", 1)[0])
                out, finish = layouts.created(own["path"])
                out.write((own["content"] or "").encode())
                finish()
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _height(px: DataFrame) -> int:
    return (px.agg(F.max("y")).first()[0] or 0) + 1


_BANDS = {"B01": "B1", "B02": "B2", "B3N": "B3", "b04": "B4"}


@query("sensor_files", f"WITH {views.RASTER} SELECT y, x, B1 AS b1, B1 AS b01, B2 AS b2, B3 AS b3, B3 AS b3n, B4 AS b4 FROM px")
def sensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of single-band files, read as one sensor's scene, with the other names of its bands."""
    px, folder = views.raster(spark, sf_dir), _folder(spark, "sensor")
    cells = px.select("y", "x", F.inline(F.array(*[F.struct(F.lit(file).alias("scene"), F.col(band).alias("value")) for file, band in _BANDS.items()])))
    rasters.write_tiff(cells, folder, _height(px), views.WIDTH, "f8", transform=[30.0, 0.0, 0.0, 0.0, -30.0, 0.0])
    found, _ = rasters.read_sensor(spark, folder, "s")
    return found.where("B1 IS NOT NULL").select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(c).alias(c.lower()) for c in ("B1", "B01", "B2", "B3", "B3N", "B4")])


#: Pairs of a stack: of the first three every cell has a coherence layer, the last has none.
_PAIRS = "unnest([1, 2, 3, 4]) AS k"


@query("stack_files", f"""WITH {views.RASTER}, o AS (SELECT y, x, {_PAIRS}, B1, B2 FROM px), r AS (SELECT y, x, CASE WHEN k = 4 OR ((B2::INT * k) % 10) / 10.0 >= 0.3 THEN (B1 * k - B2 * 0.7310585786::DOUBLE) * 365.25 / (12 * k) END AS rate FROM o)
SELECT y, x, round(median(rate), 4) AS velocity, count(rate) AS n_valid FROM r GROUP BY y, x""")
def stack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stack of radar pairs from its folders: displacement, coherence of most pairs, dates."""
    px, folder = views.raster(spark, sf_dir), _folder(spark, "stack")
    pairs = px.select("y", "x", "B1", "B2", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("k"))
    name = F.concat(F.lit("p"), F.col("k"))
    meta = spark.range(1, 5).select(
        F.concat(F.lit(f"{folder}/p"), F.col("id"), F.lit("/metadata.json")).alias("path"),
        F.format_string('{"master_date": "2024-01-01", "slave_date": "%s", "temporal_baseline_days": %d}', F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 12).cast("int")), "yyyy-MM-dd"), F.col("id") * 12).alias("content"),
    )
    texts_written(meta)
    layers = {"los_displacement": F.col("B1") * F.col("k") - F.col("B2") * 0.7310585786, "coherence": (F.col("B2").cast("int") * F.col("k")) % 10 / 10.0}
    for layer, value in layers.items():
        own = pairs if layer == "los_displacement" else pairs.where("k < 4")
        rasters.write_tiff(own.select(F.concat(name, F.lit(f"/{layer}")).alias("scene"), "y", "x", value.alias("value")), folder, _height(px), views.WIDTH, "f8")
    found = deformation.velocity(deformation.rates(projects.read_stack(spark, folder)))
    inside = px.select("y", "x")
    return found.join(inside, ["y", "x"], "left_semi").select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("velocity", 4).alias("velocity"), "n_valid")


@query("scene_files", f"""WITH {views.RASTER} SELECT y, x, round(CASE WHEN B1 <> 0 THEN B1 * 0.5 + 1 END, 6) AS b1, round(CASE WHEN B2 <> 0 THEN B2 * 0.25 - 2 END, 6) AS b2, 0.42::DOUBLE AS w1, 2.2::DOUBLE AS w2 FROM px""")
def scene_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital numbers in files of their own bands and the scene's XML, as reflectance with wavelengths; the gains of another scene, which
    are too many, count for nothing."""
    px, folder = views.raster(spark, sf_dir), _folder(spark, "scene")
    bands = "".join(f"<bandID><wavelengthCenterOfBand>{w}</wavelengthCenterOfBand><GainOfBand>{g}</GainOfBand><OffsetOfBand>{o}</OffsetOfBand></bandID>" for w, g, o in ((420.0, 0.5, 1.0), (2200.0, 0.25, -2.0)))
    texts_written(spark.createDataFrame([(f"{folder}/meta.XML", f'<level_X xmlns="urn:x"><specific>{bands}</specific></level_X>'), (f"{folder}/other.XML", f'<level_X xmlns="urn:x"><specific>{bands}<extra><GainOfBand>9</GainOfBand></extra></specific></level_X>')], "path string, content string"))
    cells = px.select("y", "x", F.inline(F.array(*[F.struct(F.lit(f"image{k}").alias("scene"), F.col(f"B{k}").alias("value")) for k in (1, 2)])))
    rasters.write_tiff(cells, f"{folder}/tiff", _height(px), views.WIDTH, "f8")
    stacked = rasters.read_tiff(spark, f"{folder}/tiff").select(F.lit("s").alias("scene"), F.substring("scene", 6, 1).cast("int").alias("band"), "y", "x", "value")
    found, wavelengths = rasters.reflectance(stacked, rasters.band_metadata(spark, f"{folder}/meta.XML"), 2, 0.0)
    bare = rasters.band_metadata(spark, f"{folder}/other.XML").where("gain IS NOT NULL").count()
    wide = rasters.stacked(found.withColumn("band", F.concat(F.lit("b"), F.col("band"))), ["b1", "b2"])
    kept = wide.join(px.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), ["y", "x"], "left_semi")
    return kept.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"), F.lit(wavelengths[0] + bare).alias("w1"), F.lit(wavelengths[1]).alias("w2"))


#: Keys of customers whose lines share a file: a file for each line makes as many files as customers.
LINES = 1000


@query("line_files", """WITH p AS (SELECT o_custkey AS line, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, (o_orderkey % 3600) / 10.0 - 180 AS lon, (o_custkey % 1800) / 10.0 - 90 AS lat FROM orders)
SELECT line, count(*) AS n, round(sum(lon * (seq + 1)), 4)::DOUBLE AS lon_sum, round(max(lat), 4)::DOUBLE AS lat FROM p GROUP BY line""")
def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's line through their orders, as features of GeoJSON files, in each those of LINES customer keys."""
    orders, folder = views.read(spark, sf_dir, "orders"), _folder(spark, "lines")
    point = F.struct("o_orderkey", F.array((F.col("o_orderkey") % 3600) / 10.0 - 180, (F.col("o_custkey") % 1800) / 10.0 - 90).alias("p"))
    lines = orders.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(point)), lambda v: v.p).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("o_custkey").alias("line")).alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry")))
    file = F.coalesce(F.floor(F.col("o_custkey") / LINES), F.lit(-1))
    files = lines.select(file.alias("file"), feature.alias("feature")).groupBy("file").agg(F.array_join(F.collect_list("feature"), ", ").alias("features"))
    texts_written(files.select(F.concat(F.lit(f"{folder}/"), "file", F.lit(".geojson")).alias("path"), F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "features", F.lit("]}")).alias("content")))
    found = projects.read_lines(spark, folder, "line").withColumn("line", F.col("line").cast("long"))
    return found.groupBy("line").agg(F.count("*").alias("n"), F.round(F.sum(F.col("lon") * (F.col("seq") + 1)), 4).alias("lon_sum"), F.round(F.max("lat"), 4).alias("lat"))


@query("knowledge_files", """WITH p AS (SELECT 'C' || (p_size % 5) AS commodity, p_brand AS deposit, p_type FROM part), f AS (SELECT deposit, min(commodity) AS commodity FROM p GROUP BY deposit)
SELECT p.commodity, p.deposit, count(*) AS alterations, count(DISTINCT p_type) AS minerals FROM p JOIN f ON f.deposit = p.deposit AND f.commodity = p.commodity GROUP BY p.commodity, p.deposit""")
def knowledge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a knowledge base in a JSON file: sizes as commodities, brands as deposit types, of which the first entry counts, types as
    minerals."""
    part, folder = views.read(spark, sf_dir, "part").withColumn("commodity", F.concat(F.lit("C"), F.col("p_size") % 5)), _folder(spark, "knowledge")
    alteration = F.struct(F.col("p_partkey"), F.struct(F.col("p_type").alias("mineral"), (F.col("p_size") % 3 + 1).alias("priority")).alias("a"))
    types = part.groupBy("commodity", "p_brand").agg(F.transform(F.sort_array(F.collect_list(alteration)), lambda v: v.a).alias("alterations"))
    commodities = types.groupBy("commodity").agg(F.sort_array(F.collect_list(F.struct(F.col("p_brand").alias("type_name"), "alterations"))).alias("deposit_types"))
    whole = commodities.agg(F.sort_array(F.collect_list(F.struct("commodity", "deposit_types"))).alias("commodities"))
    texts_written(whole.select(F.lit(f"{folder}/base.json").alias("path"), F.to_json(F.struct("commodities")).alias("content")))
    found = projects.read_knowledge(spark, f"{folder}/base.json")
    return found.groupBy("commodity", "deposit").agg(F.count("*").alias("alterations"), F.countDistinct("mineral").alias("minerals"))


_SENSORS = {"ASTER": ["aster"], "Landsat8": ["landsat8", "landsat 8"], "Sentinel2": ["sentinel2", "sentinel 2"]}


@query("project_folders", """WITH s AS (SELECT 'P' || n_nationkey AS project, CASE n_nationkey % 3 WHEN 0 THEN 'ASTER' WHEN 1 THEN 'Landsat8' ELSE 'Sentinel2' END AS sensor, n_nationkey % 4 + 1 AS bands, n_nationkey % 5 AS pairs FROM nation)
SELECT project, bands + 1 + pairs AS files, sensor, bands, pairs FROM s""")
def project_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects of a share by their folders: files, the sensor that each has, with its bands, and its radar pairs."""
    nation, folder = views.read(spark, sf_dir, "nation"), _folder(spark, "projects")
    key, project = F.col("n_nationkey"), F.concat(F.lit("P"), F.col("n_nationkey"))
    sensor = F.element_at(F.array(F.lit("ASTER_L2"), F.lit("Landsat 8"), F.lit("sentinel2-L2A")), (key % 3 + 1).cast("int"))
    band = nation.select(project.alias("p"), sensor.alias("s"), F.explode(F.sequence(F.lit(1), key % 4 + 1)).alias("b")).select(F.concat("p", F.lit("/"), "s", F.lit("/B0"), "b", F.lit(".tif")).alias("name"))
    pair = nation.where("n_nationkey % 5 > 0").select(project.alias("p"), F.explode(F.sequence(F.lit(1), key % 5)).alias("k")).select(F.concat("p", F.lit("/sentinel1_insar/pair"), "k", F.lit("/metadata.json")).alias("name"))
    other = nation.select(F.concat(project, F.lit("/site.kml")).alias("name"))
    hidden = nation.select(F.concat(F.lit(".P"), key, F.lit("/x.txt")).alias("name"))
    texts_written(band.unionByName(pair).unionByName(other).unionByName(hidden).select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), F.lit("{}").alias("content")))
    listed, sensors, areas = projects.list_projects(spark, folder), projects.sensor_folders(spark, folder, _SENSORS), projects.areas_with_stacks(spark, folder)
    joined = listed.join(sensors, "project").join(areas.withColumnRenamed("area", "project"), "project", "left")
    return joined.select("project", "files", "sensor", "bands", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("projects_meant", """WITH p AS (SELECT n_nationkey AS id, n_name AS project, n_nationkey * 10 AS west FROM nation), w AS (SELECT c_custkey AS k, c_custkey % 4 AS way, c_nationkey AS n FROM customer), m AS (SELECT k, way, n, id, project, west FROM w JOIN p ON n = id)
SELECT k::VARCHAR AS name, CASE way WHEN 3 THEN project END AS project, CASE way WHEN 3 THEN 'spatial' ELSE 'none' END AS how FROM m WHERE way IN (0, 3)
UNION ALL SELECT DISTINCT lower(project) || '_x' || way, NULL, 'none' FROM m WHERE way = 1 UNION ALL SELECT DISTINCT replace(lower(project), ' ', '_'), project, 'normalized' FROM m WHERE way = 2""")
def projects_meant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which project a name or a box means: by the normalised name, by the box that it overlaps most, or none."""
    nation, customer = views.read(spark, sf_dir, "nation"), views.read(spark, sf_dir, "customer")
    west = F.col("n_nationkey") * 10.0
    named = nation.select((F.col("n_nationkey") + 10**9).alias("id"), F.col("n_name").alias("project"), west.alias("west"), F.lit(0.0).alias("south"), (west + 9).alias("east"), F.lit(5.0).alias("north"))
    met = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    way = F.col("c_custkey") % 4
    name = F.when(way.isin(0, 3), F.col("c_custkey").cast("string")).when(way == 1, F.concat(F.lower("n_name"), F.lit("_x1"))).otherwise(F.regexp_replace(F.lower("n_name"), " ", "_"))
    sides = {"west": west + 2, "south": F.lit(1.0), "east": west + 11, "north": F.lit(2.0)}
    wanted = met.select(name.alias("name"), *[F.when(way == 3, c).alias(s) for s, c in sides.items()]).distinct()
    return projects.resolve_projects(wanted, named).select("name", "project", "how")


@query("raster_window", f"WITH {views.RASTER} SELECT event_type AS scene, y, x, B1 AS value FROM px WHERE B1 IS NOT NULL AND y >= 3 AND x BETWEEN 20 AND 59 AND event_type <> 'click'")
def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of rasters written and read by the data source, whose filters choose the blocks."""
    px, folder = views.raster(datasource.register(spark), sf_dir), _folder(spark, "window")
    cells = px.select(F.col("event_type").alias("scene"), "y", "x", F.col("B1").alias("value"))
    datasource.arranged(cells).write.format("raster").mode("append").option("height", _height(px)).option("width", views.WIDTH).option("dtype", "f8").save(folder)
    found = spark.read.format("raster").load(folder).where("y >= 3 AND x BETWEEN 20 AND 59 AND scene <> 'click' AND value IS NOT NULL")
    return found.select("scene", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")


@query("published_runs", """WITH r AS (SELECT o_orderpriority AS deposit, o_orderstatus AS sensor, count(*) AS n_pixels, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS n_anomaly, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
SELECT deposit, sensor, n_pixels, n_anomaly, total::DOUBLE AS total FROM r""")
def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each priority of orders, published, of two of each retained one; the layers of what is visible, by their runs' ids."""
    store, orders = RunStore(spark, _folder(spark, "runs")), views.read(spark, sf_dir, "orders")
    item = [F.col("o_orderstatus").alias("sensor"), F.lit("gold").alias("mineral"), F.lit("ratio").alias("method")]
    for deposit in [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]:
        own = orders.where(F.col("o_orderpriority") == deposit)
        layers = own.select(*item, F.col("o_custkey").alias("y"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("index_value"), (F.col("o_totalprice") > 200000).alias("is_anomaly"))
        results = layers.groupBy("sensor", "mineral", "method").agg(F.count_if("is_anomaly").alias("high_pixels"))
        store.publish({"run_id": f"p/{deposit}_1", "created_at": "2024-01-01", "project": "p", "deposit": deposit}, results, layers.limit(0))
        store.publish({"run_id": f"p/{deposit}_2", "created_at": "2024-01-02", "project": "p", "deposit": deposit}, results, layers, keep=1)
    found = []
    for r in store.visible().select("run_id", "deposit").collect():
        own = store.load(r.run_id)
        found.append(own.layers.groupBy("sensor").agg(F.count("*").alias("n_pixels"), F.count_if("is_anomaly").alias("n_anomaly"), F.round(F.sum("index_value"), 2).alias("total")).withColumn("deposit", F.lit(r.deposit)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("deposit", "sensor", "n_pixels", "n_anomaly", "total")


@query("unmixed_by_many", "SELECT count(*) AS n_unmixed, 0::BIGINT AS n_wrong FROM embeddings")
def unmixed_by_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra unmixed into twelve members; wrong are those that break a condition of the best non-negative mixture."""
    spectra = views.spectra(spark, sf_dir)
    members = np.abs(np.array([r.spectrum for r in spectra.orderBy("vec_id").limit(12).collect()]).T)
    bands, names = [f"s{k}" for k in range(64)], [f"m{k}" for k in range(members.shape[1])]
    wide = spectra.select("vec_id", *[F.col("spectrum")[k].alias(b) for k, b in enumerate(bands)])
    found = unmixing.unmix(wide, bands, members, names, keys=["vec_id"], sum_to_one=False)
    both = found.select("vec_id", F.array(*names).alias("shares")).join(spectra, "vec_id").select("shares", "spectrum")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shares, x = (np.array(c.to_pylist(), float) for c in batch.columns)
                gain = (x - shares @ members.T) @ members
                wrong = ((shares < 0) | (gain > 1e-6) | ((shares > 0) & (np.abs(gain) > 1e-6))).any(1)
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "wrong": [int(wrong.sum())]})

    return both.mapInArrow(run, "n long, wrong long").agg(F.sum("n").alias("n_unmixed"), F.sum("wrong").alias("n_wrong"))
