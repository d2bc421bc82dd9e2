"""Projects, radar pairs, knowledge bases and line features from files, and a synthetic scene."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.text import band_name, directory_name
from regolith.operators import deformation
from regolith.operators.grid import overlaps
from regolith.operators.spatial import resample
from regolith.sources import rasters

ALTERATION = (
    "struct<mineral:string,zone:string,priority:int,anomaly_type:string,sensor_ratio:map<string,string>,"
    "crosta_pca:struct<sensor:string,input_bands:array<string>,landsat8_bands:array<string>,pc_criterion:struct<positive_bands:array<string>,negative_bands:array<string>>>,"
    "enmap_feature:struct<feature_um:double,shoulder_um:array<double>,sign:int>>"
)


TYPE = (
    "struct<type_name:string,type_en:string,tectonic_setting:string,alteration_zoning:string,ore_elements:array<string>,host_rocks:array<string>,"
    f"alterations:array<{ALTERATION}>>"
)


def _entries(spark: SparkSession, path: str, extra: str | None) -> DataFrame:
    """c_pos and entry of each commodity of a knowledge base, then of those of an extra one, if there is any."""
    commodity = f"array<struct<commodity:string,commodity_en:string,category:string,deposit_types:array<{TYPE}>>>"

    def read(place: str, first: int) -> DataFrame:
        whole = spark.read.option("wholetext", "true").text(place)
        found = whole.select(F.from_json(F.coalesce(F.get_json_object("value", "$.commodities"), F.col("value")), commodity).alias("all"))
        return found.select(F.posexplode("all").alias("c_pos", "c")).withColumn("c_pos", F.col("c_pos") + first)

    own = read(path, 0)
    return own if extra is None else own.unionByName(read(extra, 100_000))


def read_types(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    """c_pos, commodity, commodity_en, category and t_pos, type_name, type_en, tectonic_setting, alteration_zoning, ore_elements,
    host_rocks of each deposit type; a commodity without types has a row with null ones."""
    own = _entries(spark, path, extra).select("c_pos", "c.commodity", "c.commodity_en", "c.category", F.posexplode_outer("c.deposit_types").alias("t_pos", "t"))
    return own.select(*[c for c in own.columns if c != "t"], "t.type_name", "t.type_en", "t.tectonic_setting", "t.alteration_zoning", "t.ore_elements", "t.host_rocks")


def read_knowledge(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    """pos, commodity, deposit, alteration position and fields of a JSON knowledge base: an array or a `commodities` list of
    commodities, each with deposit_types, each with alterations. The first entry of a deposit type counts. extra: a second file whose
    commodities (oil and gas, say) come behind those of the first."""
    types = _entries(spark, path, extra).select("c_pos", F.col("c.commodity").alias("commodity"), F.posexplode("c.deposit_types").alias("t_pos", "t"))
    first = types.groupBy(F.col("t.type_name").alias("deposit")).agg(F.min_by(F.struct("commodity", "t", "c_pos", "t_pos"), F.struct("c_pos", "t_pos")).alias("x"))
    rows = first.select("deposit", "x.commodity", (F.col("x.c_pos").cast("long") * 10000 + F.col("x.t_pos")).alias("pos"), F.posexplode("x.t.alterations").alias("a_pos", "a"))
    criterion = F.coalesce(F.size("a.crosta_pca.pc_criterion.positive_bands"), F.lit(0)) + F.coalesce(F.size("a.crosta_pca.pc_criterion.negative_bands"), F.lit(0))
    return rows.select(
        "pos", "a_pos", "commodity", "deposit", "a.*", F.col("a.crosta_pca.sensor").alias("pca_sensor"), F.col("a.crosta_pca.input_bands").alias("input_bands"),
        F.col("a.crosta_pca.landsat8_bands").alias("landsat_bands"), (criterion > 0).alias("has_criterion"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pair_id (folder), ref_date, sec_date and baseline of the metadata.json of each radar pair under a folder; the baseline is null where
    the file has none, so the pair is left out of a decay fit (operators.deformation.decay) but not of the rates."""
    meta = spark.read.schema("master_date string, slave_date string, temporal_baseline_days int").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(path)
    named = meta.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metadata\.json$", 1).alias("pair_id"), F.to_date("master_date").alias("ref_date"), F.to_date("slave_date").alias("sec_date"), "temporal_baseline_days")
    return named.select("pair_id", "ref_date", "sec_date", F.col("temporal_baseline_days").alias("baseline"))


def _on_grid(cells: DataFrame, profiles: DataFrame, height: int, width: int) -> DataFrame:
    """Cells (scene, y, x, value) of rasters (scene, height, width), those of other sizes interpolated on a grid of this one, first and
    last cells falling together."""
    fits = (F.col("height") == height) & (F.col("width") == width)
    same = cells.join(profiles.where(fits).select("scene"), "scene", "left_semi")
    places = profiles.where(~fits).select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    scaled = [F.col(at) * ((F.col(size) - 1) / max(1, own - 1)) for at, size, own in (("y", "height", height), ("x", "width", width))]
    placed = places.select("scene", "y", "x", scaled[0].alias("row"), scaled[1].alias("column"))
    return same.unionByName(resample(cells, placed, F.col("row"), F.col("column")).select("scene", "y", "x", "value"))


def read_stack(spark: SparkSession, path: str) -> DataFrame | None:
    """The radar pairs of an area's folder as operators.deformation.stack gives them (pair, ref_date, sec_date, baseline, y, x, disp,
    coherence, layered): pairs with a metadata.json and los_displacement.tif, with coherence.tif or without, on the grid of the first
    pair by name. None where there is no pair. Interpolation leaves unknown neighbours out."""
    pairs = read_pairs(spark, path)
    layers, sizes = {}, {}
    for name in ("los_displacement", "coherence"):
        sizes[name] = rasters.tiff_profiles(spark, path, f"{name}.tif").select("scene", "height", "width")
        layers[name] = rasters.read_tiff(spark, path, f"{name}.tif").where("band = 1").select("scene", "y", "x", "value")
    first = sizes["los_displacement"].join(pairs.select(F.col("pair_id").alias("scene")), "scene").agg(F.min(F.struct("scene", "height", "width"))).first()[0]
    if first is None:
        return None
    own = {n: _on_grid(layers[n], sizes[n], first.height, first.width).withColumnRenamed("scene", "pair") for n in layers}
    moved = pairs.withColumnRenamed("pair_id", "pair").join(own["los_displacement"].withColumnRenamed("value", "disp"), "pair")
    return deformation.stack(moved, own["coherence"].withColumnRenamed("value", "coherence"))


def read_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """line_id (file, feature, part), seq, lon, lat of the LineStrings and MultiLineStrings in GeoJSON feature collections. name: a property
    of the features that is a column of texts too."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.get_json_object("value", "$.features").alias("json"))
    features = whole.select("file", F.posexplode(F.from_json("json", "array<struct<geometry:string,properties:string>>")).alias("feature", "f")).select("file", "feature", F.col("f.geometry").alias("g"), F.col("f.properties").alias("properties"))
    kind, raw = F.get_json_object("g", "$.type"), F.get_json_object("g", "$.coordinates")
    parts = F.when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(raw, "array<array<array<double>>>"))
    named = {} if name is None else {name: F.get_json_object("properties", f"$.{name}")}
    lines = features.select("file", "feature", *[c.alias(n) for n, c in named.items()], F.posexplode(parts).alias("part", "points"))
    return lines.select(F.concat_ws("/", "file", "feature", "part").alias("line_id"), *named, F.posexplode("points").alias("seq", "p")).select("line_id", *named, "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def calibrated(digital: Column, gains: Column, offsets: Column, nodata: float) -> Column:
    """A spectrum of digital numbers as reflectance; nodata and unknown values are null."""
    return F.zip_with(F.transform(digital, lambda v: F.when(v != nodata, v.cast("double"))), F.zip_with(gains, offsets, lambda g, o: F.struct(g.alias("g"), o.alias("o"))), lambda v, k: v * k.g + k.o)


def list_projects(spark: SparkSession, path: str) -> DataFrame:
    """project (folder under path) and files of each that has any, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    top = re.escape(path.rstrip("/").rpartition("/")[2])
    name = F.regexp_extract("path", f"/{top}/([^/]+)/", 1)
    return files.select(name.alias("project")).where("project <> '' AND project NOT LIKE '.%'").groupBy("project").agg(F.count("*").alias("files")).orderBy("project")


#: Fixed: what stands out in each kind of synthetic scene: first and last but one row and column of a square, and its bands' numbers.
#: Mixed: plants, water, buildings; forest: plants; urban: buildings and roads everywhere.
SCENES = {
    "plain": [],
    "mixed": [(50, 100, {"B5": 4500, "B4": 1000}), (120, 160, {"B3": 3000, "B5": 500}), (200, 240, {"B4": 3500, "B5": 2000})],
    "forest": [(50, 200, {"B5": 5000, "B4": 800, "B3": 1500})],
    "urban": [(0, 1 << 30, {"B6": 2500, "B5": 1500, "B4": 2800})],
}


def synthetic_scene(spark: SparkSession, bands: int = 7, height: int = 256, width: int = 256, seed: int = 42, kind: str = "plain") -> DataFrame:
    """scene, y, x and bands of digital numbers from 100 to 3000 with, in a plain scene, a bright rectangle, in the others the squares of
    SCENES; a hash makes them the same on any cluster."""
    if kind not in SCENES:
        raise ValueError(f"unknown kind of scene: {kind}")
    cells = spark.range(height * width).select(F.lit("synthetic").alias("scene"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), "id")
    inside = F.col("y").between(height // 4, height // 2) & F.col("x").between(width // 4, width // 2)
    noise = [(100 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2900))).cast("double") for k in range(1, bands + 1)]
    made = {f"B{k}": F.when(inside & F.lit(k % 2 == 0), 2800.0).otherwise(v) if kind == "plain" else v for k, v in enumerate(noise, 1)}
    for first, stop, values in SCENES[kind]:
        square = F.col("y").between(first, stop - 1) & F.col("x").between(first, stop - 1)
        made |= {band: F.when(square, float(value)).otherwise(made[band]) for band, value in values.items() if band in made}
    return cells.select("scene", "y", "x", *[c.alias(band) for band, c in made.items()])


def sensor_folders(spark: SparkSession, path: str, prefixes: dict[str, list[str]]) -> DataFrame:
    """project, sensor, folder and bands of each sensor that a project has a folder for: one whose name begins with one of the sensor's
    prefixes (normalised names). Of several the folder with most single-band files counts, of equals the first by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    top = re.escape(path.rstrip("/").rpartition("/")[2])
    parts = files.select(F.regexp_extract("path", f"/{top}/([^/]+)/([^/]+)/", 1).alias("project"), F.regexp_extract("path", f"/{top}/([^/]+)/([^/]+)/", 2).alias("folder"), F.regexp_extract("path", r"(?i)([^/]+)\.tiff?$", 1).alias("stem"))
    counted = parts.where("project <> '' AND folder <> ''").groupBy("project", "folder").agg(F.count(band_name(F.col("stem"))).alias("bands"))
    named = counted.withColumn("sensor", F.explode(F.array(*[F.lit(s) for s in prefixes])))
    own = directory_name(F.col("folder"))
    fits = F.lit(False)
    for sensor, starts in prefixes.items():
        for start in starts:
            fits |= (F.col("sensor") == sensor) & own.startswith(start)
    best = named.where(fits).groupBy("project", "sensor").agg(F.min_by(F.struct("folder", "bands"), F.struct(-F.col("bands"), "folder")).alias("b"))
    return best.select("project", "sensor", "b.folder", "b.bands")


def areas_with_stacks(spark: SparkSession, path: str) -> DataFrame:
    """area and pairs of each area's folder under path that has radar pairs (folders with a metadata.json), by name."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").load(path).select("path")
    area = F.regexp_extract("path", r"/([^/]+)/sentinel1_insar/[^/]+/metadata\.json$", 1)
    return meta.select(area.alias("area")).where("area <> ''").groupBy("area").agg(F.count("*").alias("pairs")).orderBy("area")


def resolve_projects(wanted: DataFrame, projects: DataFrame) -> DataFrame:
    """wanted (name, and west, south, east, north or nulls) with the project that it means and how that was found: the same id, the
    same name, the same normalised name, else the one whose box it overlaps most; null and none where there is none. projects
    (id, project, and a box or nulls); of equals the first by id."""
    own = projects.select("id", "project")
    by = {"id": F.col("id").cast("string"), "exact": F.col("project"), "normalized": directory_name(F.col("project"))}
    keyed = own.select("id", "project", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(k).alias("how"), c.alias("key")) for r, (k, c) in enumerate(by.items())])).alias("k")).select("id", "project", "k.*")
    names = wanted.select("name").distinct().select("name", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), (directory_name(F.col("name")) if k == "normalized" else F.col("name")).alias("key")) for r, k in enumerate(by)])).alias("n")).select("name", "n.*")
    named = names.join(keyed, ["rank", "key"]).groupBy("name").agg(F.min_by(F.struct("project", "how"), F.struct("rank", "id")).alias("n"))
    sides = ["west", "south", "east", "north"]
    rest = overlaps(wanted.join(named, "name", "left_anti").where("west IS NOT NULL").select("name", *sides), projects.where("west IS NOT NULL").select("id", "project", *sides))
    area = (F.least("a_east", "b_east") - F.greatest("a_west", "b_west")) * (F.least("a_north", "b_north") - F.greatest("a_south", "b_south"))
    near = rest.where(area > 0).groupBy("name").agg(F.min_by(F.struct(F.col("project"), F.lit("spatial").alias("how")), F.struct(-area, F.col("id"))).alias("n"))
    return wanted.join(named.unionByName(near), "name", "left").select(*wanted.columns, F.col("n.project").alias("project"), F.coalesce("n.how", F.lit("none")).alias("how"))
