"""Grids and boxes: resampling, smoothing, affine coordinates, bounding boxes, coverage, line features."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions import coordinates, projections
from regolith.functions.bands import finite

Affine = Sequence[float]  # a, b, c, d, e, f: x = a * column + b * row + c, y = d * column + e * row + f


def to_world(transform: Affine, column: Column, row: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = transform[:6]
    return a * column + b * row + c, d * column + e * row + f


def to_pixel(transform: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = transform[:6]
    det = a * e - b * d
    return ((x - c) * e - (y - f) * b) / det, ((y - f) * a - (x - c) * d) / det


#: Rows and columns of a block of source pixels that a task holds.
WINDOW = 256
#: How far beyond its own cell each method looks.
HALO = {"nearest": 1, "bilinear": 1, "cubic": 2}


def _bilinear(window: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The mean of the four neighbours by nearness; unknown ones (nan) are left out, and all four unknown give nan."""
    y, x = np.floor(row).astype(int), np.floor(column).astype(int)
    down, right = row - y, column - x
    total, known = np.zeros(len(row)), np.zeros(len(row))
    for i, wy in enumerate((1 - down, down)):
        for j, wx in enumerate((1 - right, right)):
            v, w = window[y + i, x + j], wy * wx
            seen = ~np.isnan(v) & (w > 0)
            total[seen] += (v * w)[seen]
            known[seen] += w[seen]
    return np.where(known > 0, total / np.where(known > 0, known, 1), np.nan)


def _cubic(window: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Cubic convolution (-1/2) of the 16 neighbours; bilinear where one of them that counts is unknown."""
    y, x = np.floor(row).astype(int), np.floor(column).astype(int)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        return [((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t]

    out, whole = np.zeros(len(row)), np.ones(len(row), bool)
    for i, wy in enumerate(weights(row - y)):
        for j, wx in enumerate(weights(column - x)):
            v, w = window[y + i - 1, x + j - 1], wy * wx
            counts = w != 0
            whole &= ~counts | ~np.isnan(v)
            out += np.where(counts, np.nan_to_num(v) * w, 0)
    return np.where(whole, out, _bilinear(window, row, column))


def _nearest(window: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    return window[np.floor(row + 0.5).astype(int), np.floor(column + 0.5).astype(int)]


def resample_layers(pixels: DataFrame, target: DataFrame, row: Column, column: Column, layers: Sequence[str], method: str = "bilinear", of: Column | None = None, window: int = WINDOW) -> DataFrame:
    """The target's rows with a column for each layer: row and column give each one's place in the source grid.

    pixels: scene, layer, y, x, value. of: the source's scene that a target's row is looked up in, its own `scene` by default. method:
    nearest, bilinear or cubic. Rows beyond the source, of an unknown place, or with no known neighbour have nulls; weights of unknown
    neighbours are left out (null, NaN and infinite values are unknown).

    Source pixels go to their block of window * window pixels, those near its sides to the next ones too; each row of the target goes to
    the block that its place is in. So either side is shuffled once, whatever the number of layers, and a task holds a block.
    """
    if method not in HALO:
        raise ValueError(f"unknown method: {method}")
    look, halo, names, columns = {"nearest": _nearest, "bilinear": _bilinear, "cubic": _cubic}[method], HALO[method], list(layers), target.columns
    near = [F.explode(F.sequence(F.floor((F.col(c) - halo) / window), F.floor((F.col(c) + halo) / window))).alias(f"_b{c}") for c in ("y", "x")]
    source = pixels.where(F.col("layer").isin(names)).select(F.col("scene").alias("_of"), "layer", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), finite(F.col("value").cast("double")).alias("value")).where("value IS NOT NULL")
    source = source.select("*", near[0]).select("*", near[1])
    placed = target.withColumns({"_r": finite(row.cast("double")), "_c": finite(column.cast("double")), "_of": F.col("scene") if of is None else of})
    known = placed.where("_r IS NOT NULL AND _c IS NOT NULL AND abs(_r) < 1e15 AND abs(_c) < 1e15").withColumns({"_by": F.floor(F.col("_r") / window), "_bx": F.floor(F.col("_c") / window)})
    schema = T.StructType([*target.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table, block: pa.Table) -> pa.Table:
        top, left = key[1].as_py() * window - halo, key[2].as_py() * window - halo
        r, c = cells.column("_r").to_numpy() - top, cells.column("_c").to_numpy() - left
        y, x, v, which = (block.column(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "value", "layer"))
        out = cells.select(columns)
        for name in names:
            # One more row and column than the halo needs, for places right at the block's end.
            values = np.full((window + 2 * halo + 1, window + 2 * halo + 1), np.nan)
            own = which == name
            values[y[own] - top, x[own] - left] = v[own]
            found = look(values, r, c)
            out = out.append_column(name, pa.array(found, mask=np.isnan(found)))
        return out

    keys = ("_of", "_by", "_bx")
    found = known.groupBy(*keys).cogroup(source.groupBy(*keys)).applyInArrow(run, schema)
    lost = placed.where("_r IS NULL OR _c IS NULL OR abs(_r) >= 1e15 OR abs(_c) >= 1e15")
    return found.unionByName(lost.select(*target.columns, *[F.lit(None).cast("double").alias(n) for n in names]))


def resample(pixels: DataFrame, target: DataFrame, row: Column, column: Column, value: str = "value", method: str = "bilinear") -> DataFrame:
    """The target's rows with `value` of the source grid (scene, y, x), see resample_layers."""
    own = pixels.select("scene", F.lit(value).alias("layer"), "y", "x", F.col(value).alias("value"))
    return resample_layers(own, target, row, column, [value], method)


System = int | projections.Projection


def _degrees(system: System, x: Column, y: Column) -> tuple[Column, Column]:
    return coordinates.to_lonlat(system, x, y) if isinstance(system, int) else projections.inverse_columns(system, x, y)


def _places(system: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    return coordinates.from_lonlat(system, lon, lat) if isinstance(system, int) else projections.forward_columns(system, lon, lat)


def warped(pixels: DataFrame, source: Affine, source_system: System, target: DataFrame, grid: Affine, system: System, value: str = "value", method: str = "bilinear") -> DataFrame:
    """The target's cells (scene, y, x and more, with `value`) with the pixels (scene, y, x) of a raster in another grid and coordinate
    system: the middle of each cell is looked up among the middles of the pixels. A system is an EPSG code that functions.coordinates
    knows, or a functions.projections.Projection. As resample says, cells beyond the source are null. Use nearest for masks, bilinear or
    cubic for what is continuous."""
    def columns(pair: tuple[Column, Column], names: tuple[str, str]) -> dict[str, Column]:
        return dict(zip(names, pair, strict=True))

    placed = target.withColumns(columns(to_world(grid, F.col("x") + 0.5, F.col("y") + 0.5), ("_x1", "_y1")))
    if system != source_system:
        placed = placed.withColumns(columns(_degrees(system, F.col("_x1"), F.col("_y1")), ("_lon", "_lat")))
        placed = placed.withColumns(columns(_places(source_system, F.col("_lon"), F.col("_lat")), ("_x1", "_y1")))
    column, row = to_pixel(source, F.col("_x1"), F.col("_y1"))
    return resample(pixels, placed, row - 0.5, column - 0.5, value, method).select(*target.columns, value)


def lonlat_boxes(profiles: DataFrame, parts: int = 22) -> DataFrame:
    """profiles (height, width, transform, epsg) with west, south, east, north in degrees: of so many points on each side, as a straight
    side of a projected raster is none in degrees. Null without a transform or in an unknown coordinate system."""
    wide, high = F.col("width") / parts, F.col("height") / parts
    at = F.sequence(F.lit(0), F.lit(parts))
    sides = (
        F.transform(at, lambda k: F.struct((k * wide).alias("c"), F.lit(0.0).alias("r"))),
        F.transform(at, lambda k: F.struct((k * wide).alias("c"), F.col("height").cast("double").alias("r"))),
        F.transform(at, lambda k: F.struct(F.lit(0.0).alias("c"), (k * high).alias("r"))),
        F.transform(at, lambda k: F.struct(F.col("width").cast("double").alias("c"), (k * high).alias("r"))),
    )
    affine = [F.col("transform")[k] for k in range(6)]

    def place(p: Column) -> Column:
        lon, lat = coordinates.to_lonlat(F.col("epsg"), *to_world(affine, p.c, p.r))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    placed = profiles.withColumn("_p", F.transform(F.concat(*sides), place))
    boxes = {"west": F.array_min("_p.lon"), "south": F.array_min("_p.lat"), "east": F.array_max("_p.lon"), "north": F.array_max("_p.lat")}
    return placed.withColumns(boxes).drop("_p")


def zoom_place(index: Column, size_in: Column | int, size_out: Column | int) -> Column:
    """Where a cell of a zoomed axis lies on the source's axis; first and last cells fall together, and an axis of one cell is the first."""
    size_in, size_out = (F.lit(s) if isinstance(s, int) else s for s in (size_in, size_out))
    return F.when(size_out > 1, index * ((size_in - 1) / (size_out - 1))).otherwise(F.lit(0.0))


#: Rows and columns of a tile.
TILE = 256


def tiled(pixels: DataFrame, value: Column, halo: int, function: Callable[[np.ndarray], np.ndarray], name: str = "value", tile: int = TILE) -> DataFrame:
    """scene, y, x and `name`: what `function` makes of each pixel's surroundings, up to `halo` cells away.

    Each pixel goes to its own tile and, near a side, to the tiles beyond it; a task holds one tile with its halo as an array, nan
    where the value is null. pixels: a row for every cell of each scene's grid, so that a tile's array ends where the scene does,
    and the function itself says how to go on beyond.
    """
    kinds = {c: pixels.schema[c].dataType for c in ("scene", "y", "x")}
    near = [F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))).alias(f"_t{c}") for c in ("y", "x")]
    placed = pixels.select("scene", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), value.cast("double").alias("v"))
    placed = placed.select("*", near[0]).select("*", near[1])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row, column = key[1].as_py(), key[2].as_py()
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        own = (y // tile == row) & (x // tile == column)
        if own.any():
            whole = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
            whole[y - y.min(), x - x.min()] = v
            made = function(whole)[(y - y.min())[own], (x - x.min())[own]]
        else:
            made = np.zeros(0)
        return pa.table({"scene": table.column("scene").filter(pa.array(own)), "y": y[own], "x": x[own], name: pa.array(made, mask=np.isnan(made))})

    out = placed.groupBy("scene", "_ty", "_tx").applyInArrow(run, f"scene {kinds['scene'].simpleString()}, y long, x long, {name} double")
    return out.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], name)


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed by a Gaussian of 4 sigma reach, the edge mirrored (d c b a | a b c d | d c b a); nan counts as 0."""
    reach = gaussian_reach(sigma)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    out = np.nan_to_num(values)
    for axis in (0, 1):
        wide = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        size = out.shape[axis]
        out = sum(w * wide.take(range(k, k + size), axis) for k, w in enumerate(weights / weights.sum()))
    return out


def gaussian_reach(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def line_offsets(length: int = 9, directions: int = 6) -> list[list[tuple[int, int]]]:
    """For each direction the cells (down, right) of a line of an odd length through the middle."""
    reach = max(3, length | 1) // 2
    angles = [np.pi * k / directions for k in range(directions)]
    return [sorted({(int(round(reach + t * np.sin(a))) - reach, int(round(reach + t * np.cos(a))) - reach) for t in range(-reach, reach + 1)}) for a in angles]


def line_means(values: np.ndarray, length: int = 9, directions: int = 6) -> np.ndarray:
    """The largest mean along lines of several directions through each cell, edges repeated; nan counts as 0."""
    reach = max(3, length | 1) // 2
    height, width = values.shape
    wide = np.pad(np.nan_to_num(values), reach, mode="edge")
    means = [sum(wide[reach + dy : reach + dy + height, reach + dx : reach + dx + width] for dy, dx in own) / len(own) for own in line_offsets(length, directions)]
    return np.max(means, axis=0)


def smoothed(pixels: DataFrame, value: str, sigma: float) -> DataFrame:
    """scene, y, x, value: smoothed by a Gaussian, see gaussian(), in tiles."""
    return tiled(pixels, F.col(value), gaussian_reach(sigma), functools.partial(gaussian, sigma=sigma), value)


def bounding_boxes(vertices: DataFrame, key: str = "roi_id") -> DataFrame:
    """key, west, south, east, north of vertices (lon, lat)."""
    return vertices.groupBy(key).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def coverage(scenes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """scenes (with a box each) and usable: whether they touch the region. Only metadata is read, so scans can be pruned by it."""
    apart = (F.col("east") < west) | (F.col("west") > east) | (F.col("north") < south) | (F.col("south") > north)
    return scenes.withColumn("usable", F.coalesce(~apart, F.lit(False)))


def layers_on_grid(products: DataFrame, pixels: DataFrame, target: DataFrame, box: tuple[float, float, float, float], names: Sequence[str] = ("distance", "density", "hillshade", "slope"), method: str = "bilinear") -> DataFrame | None:
    """The target's cells (scene, y, x and world coordinates lon, lat) with the layers of the first product (product, pos, a box, its
    transform) that touches the box, as columns `names`, null where the product lacks them; None without such a product.

    pixels: product, layer, y, x, value. Where products have an epsg code (see functions.coordinates), the target's lon and lat are
    degrees; without one both share a coordinate system. All layers are looked up together.
    """
    first = coverage(products, *box).where("usable").orderBy("pos").first()
    if first is None:
        return None
    code = first["epsg"] if "epsg" in products.columns else None
    world = coordinates.from_lonlat(code, F.col("lon"), F.col("lat")) if code is not None else (F.col("lon"), F.col("lat"))
    column, row = to_pixel(first["transform"], *world)
    own = pixels.where(F.col("product") == first["product"]).select(F.lit("").alias("scene"), "layer", "y", "x", "value")
    return resample_layers(own, target, row, column, names, method, of=F.lit(""))
