"""Raster and vector files as tables, and tables as raster files."""

from __future__ import annotations

import functools
import math
import operator
import re
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.text import band_name, kml_ring
from regolith.session import checkpointed
from regolith.sources.layouts import BLOCK_BYTES, created, envi_header, folder_made, opened, rows_of, tiff_head

_PIXEL = "scene string, band int, y int, x int, value double"
#: Cells, about, for each task that reads them, whatever bytes their files take: a step behind it may hold hundreds of bytes for each.
TASK_CELLS = 1 << 20
#: Names of TIFF files.
TIFF = r"(?i)\.tiff?$"


def _files(spark: SparkSession, path: str, pattern: str, name: str | None = None) -> DataFrame:
    """path, length, stem, scene (the file's name) and a null header of the files whose names fit, from their listing alone. name: only
    files of this name, in any folder below, whose own name is then the scene."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", str(name is not None).lower())
    file = F.regexp_extract("path", r"[^/]+$", 0)
    files = source.load(path).select("path", "length").where(file.rlike(pattern) if name is None else file == name)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    scene = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if name else F.regexp_extract(stem, r"[^/]+$", 0)
    return files.select("path", "length", stem.alias("stem"), scene.alias("scene"), F.lit(None).cast("string").alias("header"))


def _pixels(files: DataFrame) -> DataFrame:
    """The pixels of files (scene, path, header or null, length). Runs of blocks are planned by the files' heads and spread over the
    tasks, each of which reads its own ranges: no file is held whole, and a task has about TASK_CELLS however well files are compressed."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rasters = [opened(own["path"], own["header"])[0] for own in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"cells": pa.array([r.bands * r.height * r.width for r in rasters], pa.int64())})

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                raster, _ = opened(own["path"], own["header"])
                held = max(1, raster.bands * raster.height * raster.width / max(1, raster.blocks))
                step = max(1, int(min(2 * BLOCK_BYTES / np.dtype(raster.dtype).itemsize, TASK_CELLS) // held))
                first = list(range(0, raster.blocks, step))
                yield pa.RecordBatch.from_pylist([{**own, "first": k, "stop": min(k + step, raster.blocks)} for k in first], schema=pa.schema([*batch.schema, ("first", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        for batch in batches:
            for own in batch.to_pylist():
                if at[:2] != (own["path"], own["header"]):
                    at = (own["path"], own["header"], *opened(own["path"], own["header"]))
                for k in range(own["first"], own["stop"]):
                    yield from rows_of(own["scene"], *at[2].block(at[3], k))

    named = files.select("scene", "path", "header")
    cells = named.mapInArrow(weigh, "cells long").agg(F.sum("cells")).first()[0] or 0
    planned = named.mapInArrow(plan, "scene string, path string, header string, first long, stop long")
    # A number of its own, as the planner would merge partitions of so few bytes; by range, as hashes of so few runs fall together.
    return planned.repartitionByRange(max(1, -(-cells // TASK_CELLS)), "path", "first").mapInArrow(run, _PIXEL)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """scene (file name), band (from 1), y, x, value of .npy files, which hold two or three dimensions; never pickled objects."""
    return _pixels(_files(spark, path, r"\.npy$"))


def tiff_profiles(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """path, scene (see read_tiff), length and bands, height, width, dtype, nodata, transform (a, b, c, d, e, f as in
    operators.spatial.to_world), epsg and resolution (the width of a pixel) of .tif and .tiff files; null where a file does not say."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("bands", "height", "width", "dtype", "nodata", "transform", "epsg")
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int32())
        for batch in batches:
            rows = [{**own, **{n: getattr(opened(own["path"])[0], n) for n in names}} for own in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*batch.schema, *zip(names, types, strict=True)]))

    files = _files(spark, path, TIFF, name).select("path", "scene", "length")
    found = files.mapInArrow(run, "path string, scene string, length long, bands int, height int, width int, dtype string, nodata double, transform array<double>, epsg int")
    return found.withColumn("resolution", F.abs(F.col("transform")[0]))


def read_tiff(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """scene (the file's name), band (from 1), y, x, value of .tif and .tiff files (layouts.tiff says which); nodata stays as it is. name:
    only files of this name, in any folder below path, which is then the scene."""
    return _pixels(_files(spark, path, TIFF, name))


def read_sensor(spark: SparkSession, path: str, scene: str) -> tuple[DataFrame, list[str]]:
    """A folder of single-band images such as B04.tif as one scene: a row for each pixel with a column for each band of the most populous
    resolution, on the smallest common grid, and the bands' names in order. Values that are not finite are null. Other names of bands (see
    band_aliases) are columns too."""
    sized = band_files(spark, path).join(tiff_profiles(spark, path).select("path", "length", F.coalesce("resolution", F.lit(1.0)).alias("resolution")), "path").withColumn("scene", F.lit(scene))
    chosen = dominant_resolution(sized)
    rows = sorted(chosen.select("number", "suffix", "band", "stem").collect())
    names = list(dict.fromkeys(r.band for r in rows))
    others = band_aliases({r.band: r.stem for r in rows})
    cells = _pixels(chosen.select(F.col("band").alias("scene"), "path", F.lit(None).cast("string").alias("header"), "length"))
    own = cells.where("band = 1").select(F.lit(scene).alias("scene"), F.col("scene").alias("band"), "y", "x", "value")
    return stacked(own, names).withColumns({other: F.col(band) for other, band in others.items()}), names


def write_tiff(cells: DataFrame, folder: str, height: int, width: int, dtype: str = "f4", transform: Sequence[float] | None = None, epsg: int | None = None, nodata: float | None = None) -> int:
    """Writes the cells (scene, y, x, value) of each scene as a single-band deflate GeoTIFF <scene>.tif in a folder, and returns the
    number of files.

    Strips are compressed wherever their cells are, and one task for each scene puts them in one file, strip by strip. Of repeated
    cells the greatest value counts; cells that are absent or null, and null scenes' cells, are nodata (else not a number, or 0 in
    files of integers); cells beyond the grid fall away. A rerun task writes the same file anew.
    """
    folder_made(folder)
    kind = np.dtype(dtype).newbyteorder("<")
    rows = max(1, (1 << 20) // max(1, width))
    count = -(-height // rows)
    empty = nodata if nodata is not None else (np.nan if kind.kind == "f" else 0)

    def strip(own: pa.Table) -> pa.Table:
        y, x, value = (own.column(c).to_numpy() for c in ("y", "x", "value"))
        number = int(own.column("strip")[0].as_py())
        out = np.full((min(rows, height - number * rows), width), empty, kind)
        known = np.flatnonzero(~np.isnan(value))
        known = known[np.argsort(value[known], kind="stable")]
        out[y[known] - number * rows, x[known]] = value[known]
        return pa.table({"scene": own.column("scene").slice(0, 1), "strip": [number], "data": [zlib.compress(out.tobytes(), 6)]})

    inside = cells.where("scene IS NOT NULL").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    keyed = inside.select("scene", F.floor(F.col("y") / rows).cast("long").alias("strip"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    strips = checkpointed(keyed.groupBy("scene", "strip").applyInArrow(strip, "scene string, strip long, data binary"))
    # The sizes go with a scene's first strip alone.
    sizes = strips.groupBy("scene").agg(F.min("strip").alias("strip"), F.map_from_entries(F.collect_list(F.struct("strip", F.length("data")))).alias("sizes"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = {n: zlib.compress(np.full((n, width), empty, kind).tobytes(), 6) for n in {min(rows, height), height - (count - 1) * rows}}
        tall = [min(rows, height - k * rows) for k in range(count)]
        out, finish, scene, done = None, None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                for n in tall[done:]:
                    out.write(blank[n])
                finish()
                yield pa.RecordBatch.from_pydict({"scene": [scene]})

        for batch in batches:
            for own in batch.to_pylist():
                if own["scene"] != scene:
                    yield from close()
                    scene, done = own["scene"], 0
                    known = dict(own["sizes"])
                    out, finish = created(f"{folder}/{scene}.tif")
                    out.write(tiff_head(height, width, kind.str, rows, [known.get(k, len(blank[n])) for k, n in enumerate(tall)], transform, epsg, nodata))
                for n in tall[done : own["strip"]]:
                    out.write(blank[n])
                out.write(own["data"])
                done = own["strip"] + 1
        yield from close()

    whole = strips.join(sizes, ["scene", "strip"], "left").repartition("scene").sortWithinPartitions("scene", "strip")
    return whole.mapInArrow(write, "scene string").count()


def envi_wavelengths(header: dict[str, str]) -> list[float]:
    """Wavelengths in micrometres."""
    values = [float(v) for v in header.get("wavelength", "{}").strip("{} \n").split(",") if v.strip()]
    nanometres = header.get("wavelength units", "").lower().startswith("nano") or (values and max(values) > 100)
    return [v / 1000 if nanometres else v for v in values]


def read_envi(spark: SparkSession, path: str) -> DataFrame:
    """scene, band, y, x, value of ENVI cubes: each .hdr with the file of the same name beside it (.img, .dat, .bil, .bsq, .bip)."""
    heads = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hdr,HDR}").load(path)
    headers = heads.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.decode("content", "UTF-8").alias("header"))
    return _pixels(_files(spark, path, r"(?i)\.(img|dat|bil|bsq|bip)$").drop("header").join(headers, "stem"))


def band_files(spark: SparkSession, path: str) -> DataFrame:
    """path, band and its sort key of single-band image files such as B04.tif, in band order."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", r"(?i)([^/]+)\.tiff?$", 1).alias("stem"))
    bands = names.withColumn("band", band_name(F.col("stem"))).where("band IS NOT NULL")
    return bands.select("path", "stem", "band", F.regexp_extract("band", r"\d+", 0).cast("int").alias("number"), F.regexp_extract("band", r"\d+(.*)", 1).alias("suffix")).orderBy("number", "suffix")


def band_aliases(stems: Mapping[str, str]) -> dict[str, str]:
    """Other names of bands, given each band's file name without its ending: B01 for B1 where the file is called so, and B3 for B3N, the
    view from above, where no band has that name. A view to the back (B3B) has none."""
    out = {}
    for band, stem in stems.items():
        if band[1:].isdigit() and stem[:2].upper() == "B0":
            out[stem.upper()] = band
        if band.endswith("N") and (bare := band[:-1]) not in stems:
            out[bare] = band
    return out


def dominant_resolution(bands: DataFrame) -> DataFrame:
    """Of each scene the bands (scene, band, number, suffix, resolution) in the most populous resolution in whole units, of equals that
    with the first band."""
    sized = bands.withColumn("r", F.bround(F.abs("resolution"), 0))
    groups = sized.groupBy("scene", "r").agg(F.count("*").alias("n"), F.min(F.struct("number", "suffix")).alias("first"))
    best = groups.groupBy("scene").agg(F.min_by("r", F.struct(-F.col("n"), "first")).alias("r"))
    return sized.join(best, ["scene", "r"]).drop("r")


def stacked(pixels: DataFrame, bands: list[str], key: tuple[str, ...] = ("scene", "y", "x")) -> DataFrame:
    """A row for each pixel with a column for each band; pixels that a band lacks fall away (the smallest common grid)."""
    wide = pixels.groupBy(*key).pivot("band", bands).agg(F.first("value", ignorenulls=True).alias("v"), F.count(F.lit(1)).alias("n"))
    present = F.lit(True)
    for b in bands:
        present &= F.coalesce(F.col(f"{b}_n"), F.lit(0)) > 0
    return wide.where(present).select(*key, *[F.col(f"{b}_v").alias(b) for b in bands])


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """file and ring (closed, of (lon, lat)) of the first polygon in each KML file; null with fewer than three points."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{kml,ovkml}").load(path)
    first = F.get(F.xpath(text, F.lit("//*[local-name()='Polygon']//*[local-name()='coordinates']/text()")), F.lit(0))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), kml_ring(first).alias("ring"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """file, part, ring, seq, lon, lat of the polygons in GeoJSON files: a geometry, a feature, or a collection's first feature."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("json"))
    geometry = F.coalesce(F.get_json_object("json", "$.features[0].geometry"), F.get_json_object("json", "$.geometry"), F.col("json"))
    kind = F.get_json_object("geometry", "$.type")
    own = whole.select("file", geometry.alias("geometry"))
    single = F.array(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>"))
    many = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<array<double>>>>")
    parts = own.where(kind.isin("Polygon", "MultiPolygon")).select("file", F.posexplode(F.when(kind == "Polygon", single).otherwise(many)).alias("part", "rings"))
    rings = parts.select("file", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("file", "part", "ring", F.posexplode("points").alias("seq", "p")).select("file", "part", "ring", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def band_metadata(spark: SparkSession, path: str) -> DataFrame:
    """idx, wavelength_um, gain, offset, fwhm_um of each band from a scene's XML, in document order, in any namespace. Gains or
    offsets that are more than the wavelengths belong to something else and are ignored."""
    own = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("xml"))

    def values(tag: str):
        found = F.xpath("xml", F.lit(f"//*[local-name()='{tag}']/text()"))
        return F.filter(F.transform(found, lambda v: F.trim(v).try_cast("double")), lambda v: v.isNotNull())

    lists = own.select(values("wavelengthCenterOfBand").alias("w"), values("GainOfBand").alias("g"), values("OffsetOfBand").alias("o"), values("FWHMOfBand").alias("f"))
    own = {c: F.when(F.size(c) <= F.size("w"), F.get(c, F.col("idx"))) for c in "go"} | {"f": F.get("f", F.col("idx"))}
    return lists.select(F.posexplode("w").alias("idx", "nm"), "w", "g", "o", "f").select("idx", (F.col("nm") / 1000).alias("wavelength_um"), own["g"].alias("gain"), own["o"].alias("offset"), (own["f"] / 1000).alias("fwhm_um"))


def finite_wavelengths(wavelengths: Sequence[float | None], bands: int) -> list[float]:
    """The wavelengths of so many bands; ValueError if their number differs or one is not finite."""
    if len(wavelengths) != bands or any(w is None or not math.isfinite(w) for w in wavelengths):
        raise ValueError(f"{bands} bands need as many finite wavelengths, not {len(wavelengths)}")
    return [float(w) for w in wavelengths]


def reflectance(pixels: DataFrame, metadata: DataFrame, bands: int, nodata: float | None = None) -> tuple[DataFrame, list[float]]:
    """Digital numbers (scene, band, y, x, value) of a scene with so many bands as reflectance, and its wavelengths in micrometres.
    metadata: as band_metadata gives it, a row for each band. nodata becomes null; gains and offsets count only if every band has
    one. ValueError without a finite wavelength for every band."""
    rows = metadata.orderBy("idx").limit(bands + 1).collect()
    wavelengths = finite_wavelengths([r.wavelength_um for r in rows], bands)
    value = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    for name, apply in (("gain", operator.mul), ("offset", operator.add)):
        own = [r[name] for r in rows]
        if all(v is not None for v in own):
            value = apply(value, F.element_at(F.array(*[F.lit(float(v)) for v in own]), F.col("band")))
    return pixels.withColumn("value", value), wavelengths


def joined_cubes(first: DataFrame, second: DataFrame, bands: tuple[int, int], wavelengths: tuple[Sequence[float], Sequence[float]]) -> tuple[DataFrame, list[float]]:
    """Two cubes of one scene (scene, band, y, x, value), visible and shortwave, as one: the second's bands come behind the first's. With
    the wavelengths of both, which must be finite. Scenes keep the first one's name."""
    own = [*finite_wavelengths(wavelengths[0], bands[0]), *finite_wavelengths(wavelengths[1], bands[1])]
    return first.unionByName(second.withColumn("band", F.col("band") + bands[0])), own


def read_scene(spark: SparkSession, image: str, metadata: str) -> tuple[DataFrame, list[float]]:
    """A scene of digital numbers (a TIFF file) as reflectance by its XML metadata, and its wavelengths in micrometres (see reflectance);
    the file says which value is nodata."""
    profile = tiff_profiles(spark, image).first()
    if profile is None:
        raise FileNotFoundError(image)
    return reflectance(read_tiff(spark, image), band_metadata(spark, metadata), profile.bands, profile.nodata)


def read_cubes(spark: SparkSession, headers: Sequence[str], scene: str) -> tuple[DataFrame, list[float]]:
    """ENVI cubes of one scene, visible first, as one cube (scene, band, y, x, value) on their smallest common grid, and its wavelengths
    in micrometres. headers: the .hdr files; what a header names as its ignored value becomes null."""
    parts, wavelengths, sizes = [], [], []
    for path in headers:
        own = envi_header(spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8")).first()[0])
        cells = read_envi(spark, re.sub(r"\.[^./]+$", ".*", path))
        ignored = own.get("data ignore value")
        parts.append(cells if ignored is None else cells.withColumn("value", F.when(F.col("value") != float(ignored), F.col("value"))))
        wavelengths += finite_wavelengths(envi_wavelengths(own), int(own["bands"]))
        sizes.append([int(own[k]) for k in ("bands", "lines", "samples")])
    if not parts:
        raise FileNotFoundError("no cube")
    inside = (F.col("y") < min(s[1] for s in sizes)) & (F.col("x") < min(s[2] for s in sizes))
    before = [sum(s[0] for s in sizes[:k]) for k in range(len(sizes))]
    moved = [p.where(inside).select(F.lit(scene).alias("scene"), (F.col("band") + n).alias("band"), "y", "x", "value") for p, n in zip(parts, before, strict=True)]
    return functools.reduce(DataFrame.unionByName, moved), wavelengths
