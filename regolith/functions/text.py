"""String expressions for band names, formulas, file names, ROI files and map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_ratio(text: Column) -> Column:
    """A ratio formula without notes in full-width parentheses and without blanks; null if it names no band."""
    bare = F.regexp_replace(F.regexp_replace(text, "（[^（）]*）", ""), r"\s+", "")
    return F.when(bare.rlike(r"B\d+"), bare)


def safe_name(text: Column) -> Column:
    """Letters, digits, _ and - stay, other runs become _, which goes at the ends; x if nothing is left."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit("x"))


def band_name(text: Column) -> Column:
    """B01 and b8a as B1 and B8A; null for what is no band."""
    number, suffix = (F.regexp_extract(text, r"(?i)^B(?:and)?0*(\d+)([A-Z]*)$", k) for k in (1, 2))
    return F.when(number != "", F.concat(F.lit("B"), number, F.upper(suffix)))


def directory_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s_\-]+", " "))


def normalized_sensor(text: Column) -> Column:
    """The catalogue's sensor for a wire name, null if unknown."""
    bare = F.regexp_replace(text, "_L2", "")
    known = F.create_map(*[F.lit(x) for pair in (("Landsat8/9", "Landsat8"), *((s, s) for s in ("Landsat8", "Sentinel2", "ASTER", "EnMAP", "PRISMA"))) for x in pair])
    return F.try_element_at(known, bare)


def kml_ring(text: Column) -> Column:
    """The closed ring of a KML coordinate text as an array of (lon, lat); null with fewer than three points."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.split(p, ","))
    points = F.filter(
        F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lon"), F.get(p, F.lit(1)).try_cast("double").alias("lat"))),
        lambda p: p.lon.isNotNull() & p.lat.isNotNull(),
    )
    closed = F.when(points[0] == F.element_at(points, -1), points).otherwise(F.concat(points, F.array(points[0])))
    return F.when(F.size(points) >= 3, closed)


def tile_x(lon: Column, zoom: Column) -> Column:
    return (lon + 180) / 360 * F.pow(F.lit(2.0), zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)


def tile_lon(x: Column, zoom: Column) -> Column:
    """The longitude of a place on the tiles, the inverse of tile_x."""
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_lat(y: Column, zoom: Column) -> Column:
    """The latitude of a place on the tiles, the inverse of tile_y."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


#: Fixed: tiles that one map may take.
MOST_TILES = 64


def few_tiles(west: Column, south: Column, east: Column, north: Column, zoom: Column, most: int = MOST_TILES) -> Column:
    """Whether a box takes no more tiles than a map may."""
    wide, high = F.floor(tile_x(east, zoom)) - F.floor(tile_x(west, zoom)) + 1, F.floor(tile_y(south, zoom)) - F.floor(tile_y(north, zoom)) + 1
    return wide * high <= most


def code_list(text: Column) -> Column:
    """The codes of a text that blanks part, in upper case; none of null."""
    return F.filter(F.split(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda c: c != "")


def run_id(project: Column, deposit: Column, at: Column) -> Column:
    """The name of a run in the store: project/deposit_yyyyMMdd-HHmmss, with safe names."""
    return F.concat(safe_name(project), F.lit("/"), safe_name(deposit), F.lit("_"), F.date_format(at, "yyyyMMdd-HHmmss"))


def tile_zoom(west: Column, south: Column, east: Column, north: Column, target: int = 16) -> Column:
    """The first zoom of 2 to 19 at which the box covers the target number of tiles, else 18."""

    def tiles(z: Column) -> Column:
        wide, high = (F.greatest(F.ceil(last) - F.floor(first), F.lit(1)) for last, first in ((tile_x(east, z), tile_x(west, z)), (tile_y(south, z), tile_y(north, z))))
        return wide * high

    return F.coalesce(F.get(F.filter(F.sequence(F.lit(2), F.lit(19)), lambda z: tiles(z) >= target), F.lit(0)), F.lit(18))
