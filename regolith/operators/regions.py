"""Regions as a table: an index of polygons by cells, and the pixels that are in them.

A region's rings are rows (scene, region, part, ring, seq, x, y) in pixel coordinates. Parts and rings of one region count together by
the even-odd rule, so inner rings are holes and parts of a multipolygon are parts of one region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions import coordinates
from regolith.operators import grid, spatial

#: Side of an index cell in pixels. A cell has a bit for each of its rows, so at most 62.
CELL = 32
#: How far beyond an edge its cells reach, so that outlines of half a cell and rounding are within.
PAD = 1.0


def edges_of(vertices: DataFrame) -> DataFrame:
    """scene, region, x1, y1, x2, y2 of the edges of all rings, the one that closes a ring included; rings need not repeat their first
    vertex. Vertices without coordinates are left out."""
    known = vertices.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    own = Window.partitionBy("scene", "region", "part", "ring").orderBy("seq")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = known.select(
        "scene", "region", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"),
        F.coalesce(F.lead("x").over(own), F.first("x").over(whole)).cast("double").alias("x2"), F.coalesce(F.lead("y").over(own), F.first("y").over(whole)).cast("double").alias("y2"),
    )
    return ends.where("x1 <> x2 OR y1 <> y2")


def index(vertices: DataFrame, at: float = 0.0, cell: int = CELL) -> DataFrame:
    """scene, cy, cx and regions (array of region, bits, edges): which regions may hold pixels of a cell, and what decides it.

    at: what is added to a pixel's x and y to get its place: 0.5 for the middles of pixels. An edge is in the cells along it, a few more
    than it is long. A region's cells between its edges' cells are listed without edges. bits has for each row of the cell whether an
    odd number of edges lies to the right of the cell there (the ray's parity at the cell's border); edges are those that cross the
    cell, which alone are tried for each pixel. Whether a pixel is inside is thus decided by the same comparisons as if the ray met all
    edges. Rows of a region's band of cells meet in one task, never a whole region.
    """
    e = edges_of(vertices)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = e.withColumn("cy", F.explode(F.sequence(F.floor((low - PAD) / cell), F.floor((high + PAD) / cell))))
    slope = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))

    def at_row(y: Column) -> Column:
        return F.coalesce(F.col("x1") + (y - F.col("y1")) * slope, F.col("x1"))

    top, bottom = F.greatest(low, F.least(high, F.col("cy") * cell - PAD)), F.least(high, F.greatest(low, (F.col("cy") + 1) * cell + PAD))
    flat = F.col("y1") == F.col("y2")
    a, b = F.when(flat, F.col("x1")).otherwise(at_row(top)), F.when(flat, F.col("x2")).otherwise(at_row(bottom))
    # Rows whose place is from the edge's lower end up to, not with, its upper end.
    first, stop = (F.least(F.greatest(F.ceil(y - at - F.col("cy") * cell), F.lit(0)), F.lit(cell)).cast("int") for y in (low, high))
    one = F.lit(1).cast("long")
    bits = F.call_function("shiftleft", one, stop) - F.call_function("shiftleft", one, first)
    placed = banded.withColumns({"lo": F.floor((F.least(a, b) - PAD) / cell), "hi": F.floor((F.greatest(a, b) + PAD) / cell), "bits": bits})
    celled = placed.withColumn("cx", F.explode(F.sequence("lo", "hi")))
    crossed = celled.groupBy("scene", "region", "cy", "cx").agg(
        F.bit_xor(F.when(F.col("cx") == F.col("lo"), F.col("bits")).otherwise(0)).alias("own"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")
    )
    right = Window.partitionBy("scene", "region", "cy").orderBy(F.desc("cx"))
    beyond = F.coalesce(F.bit_xor("own").over(right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = crossed.withColumns({"bits": beyond, "before": F.lead("cx").over(right)})
    left = F.col("bits").bitwiseXOR(F.col("own"))
    inner = known.where((left != 0) & (F.col("before") < F.col("cx") - 1)).select("scene", "region", "cy", F.explode(F.sequence(F.col("before") + 1, F.col("cx") - 1)).alias("cx"), left.alias("bits"))
    none = F.array().cast(crossed.schema["edges"].dataType)
    both = known.select("scene", "region", "cy", "cx", "bits", "edges").unionByName(inner.withColumn("edges", none))
    return both.groupBy("scene", "cy", "cx").agg(F.collect_list(F.struct("region", "bits", "edges")).alias("regions"))


def regions_at(pixels: DataFrame, indexed: DataFrame, at: float = 0.0, cell: int = CELL, outline: bool = False) -> DataFrame:
    """pixels (scene, y, x and more) with `regions`: the regions that each is in, ascending, an empty array for none.

    at and cell: as for index(). outline: whether the drawn outline of a polygon of cells is inside too (see grid.inside_cells).
    Pixels meet their cell's entry by an equi-join, so a row of pixels has one row after it."""
    x, y = F.col("x").cast("double") + at, F.col("y").cast("double") + at
    row = (F.col("y") - F.col("_cy") * cell).cast("int")

    def crosses(e: Column) -> Column:
        return ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)

    def holds(r: Column) -> Column:
        odd = F.call_function("shiftright", r.bits, row).bitwiseAND(F.lit(1).cast("long")) == 1
        found = odd != (F.size(F.filter(r.edges, crosses)) % 2 == 1)
        return found | F.exists(r.edges, lambda e: grid.near_edge(x, y, e.x1, e.y1, e.x2, e.y2)) if outline else found

    cells = indexed.select("scene", F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), F.col("regions").alias("_regions"))
    placed = pixels.withColumns({"_cy": F.floor(F.col("y") / cell), "_cx": F.floor(F.col("x") / cell)})
    met = placed.join(cells, ["scene", "_cy", "_cx"], "left")
    found = F.array_sort(F.transform(F.filter("_regions", holds), lambda r: r.region))
    own = F.when(F.col("_regions").isNull(), F.array().cast(f"array<{_kind(indexed)}>")).otherwise(found)
    return met.withColumn("regions", own).select(*pixels.columns, "regions")


def _kind(indexed: DataFrame) -> str:
    return indexed.schema["regions"].dataType.elementType["region"].dataType.simpleString()


#: Columns that a tile of a row of pixels has; a tile's pixels are the bits of a number, so at most 62.
TILE = 32


def spans(vertices: DataFrame, at: float = 0.0) -> DataFrame:
    """scene, region, y, lo, hi: the runs of columns, both ends included, that each region holds in each row of pixels.

    at: as for index(). Each edge crosses each of its rows once, by the comparison that a ray from a pixel makes; between the first and the
    second crossing of a row, the third and the fourth and so on is inside. So a region is worked out once, however many pixels it has,
    and rows of one region meet in as many tasks as there are. Pixels at negative rows have regions too."""
    e = edges_of(vertices)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = e.withColumn("y", F.explode(F.when(F.ceil(high - at) > F.ceil(low - at), F.sequence(F.ceil(low - at), F.ceil(high - at) - 1)).otherwise(F.array().cast("array<long>"))))
    place = F.col("y").cast("double") + at
    met = rows.where((F.col("y1") > place) != (F.col("y2") > place))
    cut = (F.col("x2") - F.col("x1")) * (place - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    found = met.select("scene", "region", "y", F.ceil(cut - at).alias("cut")).groupBy("scene", "region", "y").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    each = found.select("scene", "region", "y", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2, F.lit(2))).alias("_k"))
    return each.select("scene", "region", "y", F.col("cuts")[F.col("_k")].alias("lo"), (F.col("cuts")[F.col("_k") + 1] - 1).alias("hi")).where("lo <= hi")


def _tiled(found: DataFrame) -> DataFrame:
    return found.withColumn("_t", F.explode(F.sequence(F.floor(F.col("lo") / TILE), F.floor(F.col("hi") / TILE))))


def pairs_at(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """pixels (scene, y, x and more) with `region`: a row for each of the regions' spans() that holds a pixel. Spans meet the pixels of
    their tiles, and only a tile's few pixels are compared; they are never sent whole to all tasks, whatever their size seemed before."""
    placed = pixels.withColumn("_t", F.floor(F.col("x") / TILE))
    return _tiled(found).hint("merge").join(placed, ["scene", "y", "_t"]).where("x BETWEEN lo AND hi").select(*pixels.columns, "region")


def covered(pixels: DataFrame, found: DataFrame, name: str = "covered") -> DataFrame:
    """pixels with whether any region's spans() hold them. Spans become bits of their tiles, which are put together before they move, so
    what meets the pixels does not grow with the regions."""
    one, start = F.lit(1).cast("long"), F.col("_t") * TILE
    first, stop = (F.col("lo") - start), (F.col("hi") - start + 1)
    ends = F.call_function("shiftleft", one, F.least(stop, F.lit(TILE)).cast("int")) - F.call_function("shiftleft", one, F.greatest(first, F.lit(0)).cast("int"))
    tiles = _tiled(found).groupBy("scene", "y", "_t").agg(F.bit_or(ends).alias("_bits"))
    met = pixels.withColumn("_t", F.floor(F.col("x") / TILE)).join(tiles.hint("merge"), ["scene", "y", "_t"], "left")
    bit = F.call_function("shiftright", F.col("_bits"), (F.col("x") - F.col("_t") * TILE).cast("int")).bitwiseAND(one) == 1
    return met.withColumn(name, F.coalesce(bit, F.lit(False))).select(*pixels.columns, name)


def in_pixels(vertices: DataFrame, profiles: DataFrame) -> DataFrame:
    """Vertices in degrees (scene, region, part, ring, seq, lon, lat) as vertices in the pixels of their scene's raster.

    profiles: scene, transform (array of a, b, c, d, e, f) and epsg. Each vertex is put into the raster's coordinate system, as edges
    between them are straight there. Scenes without a transform, or in an unknown system, have no vertices."""
    own = vertices.join(profiles.select("scene", "transform", "epsg").where("transform IS NOT NULL"), "scene")
    world = own.withColumns(dict(zip(("_wx", "_wy"), coordinates.from_lonlat(F.col("epsg"), F.col("lon"), F.col("lat")), strict=True)))
    column, row = spatial.to_pixel([F.col("transform")[k] for k in range(6)], F.col("_wx"), F.col("_wy"))
    return world.withColumns({"x": column, "y": row}).where("x IS NOT NULL AND y IS NOT NULL").select("scene", "region", "part", "ring", "seq", "x", "y")


def meeting(vertices: DataFrame, boxes: DataFrame) -> DataFrame:
    """vertices (region, part, ring, seq, lon, lat) with the `scene` of each raster whose box (scene, west, south, east, north in degrees)
    their region's box meets."""
    own = vertices.groupBy("region").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    pairs = grid.overlaps(own, boxes.select("scene", "west", "south", "east", "north")).select("region", "scene")
    return vertices.join(pairs, "region").select("scene", "region", "part", "ring", "seq", "lon", "lat")


def region_mask(pixels: DataFrame, profiles: DataFrame, drawn: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """pixels with `roi`, whether each is in its scene's region, in this order: by the polygons in degrees (`drawn`: as in_pixels takes
    them), pixels by their middles, where the scene has a transform and a known system; else by the polygons in pixels (`cells`: as
    index() takes them), whose outline is inside; else every pixel is."""
    geo = in_pixels(drawn, profiles) if drawn is not None else None
    out, conditions = pixels, []
    for name, vertices in (("_geo", geo), ("_cells", cells)):
        if vertices is None:
            continue
        has = vertices.select("scene").distinct().withColumn(f"{name}_has", F.lit(True))
        out = out.join(F.broadcast(has), "scene", "left")
        if vertices is geo:
            out = covered(out, spans(geo, 0.5), name)
        else:
            out = regions_at(out, index(vertices), outline=True).withColumn(name, F.size("regions") > 0).drop("regions")
        conditions.append((F.coalesce(F.col(f"{name}_has"), F.lit(False)), F.col(name)))
    roi = F.lit(True)
    for has, inside in reversed(conditions):
        roi = F.when(has, inside).otherwise(roi)
    return out.withColumn("roi", roi).select(*pixels.columns, "roi")
