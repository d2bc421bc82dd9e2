"""Neighbourhoods on a pixel grid: closing, connected components, clusters, polygons, line crossings."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from regolith.functions.bands import finite
from regolith.operators import spatial
from regolith.session import checkpointed


def _counts(on: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    """How many of the cells around each, so far along each axis, are on; by running sums, whatever the reach."""
    out = on.astype(np.int64)
    for axis, r in enumerate(reach):
        size = out.shape[axis]
        ends = np.cumsum(np.concatenate([np.zeros_like(out.take([0], axis)), out], axis), axis)
        at = np.arange(size)
        out = ends.take(np.minimum(at + r + 1, size), axis) - ends.take(np.maximum(at - r, 0), axis)
    return out


def closing(pixels: DataFrame, mask: Column, size: int | tuple[int, int] = 5) -> DataFrame:
    """scene, y, x, closed (int): binary closing with a square of ones, or a rectangle of (rows, columns), of odd sides. Cells outside the
    grid are off, and are not grown into. pixels: a row for every cell of each scene's grid.

    Each tile gets what surrounds it in one shuffle, and grows and shrinks it as a bitmap, so a task holds a tile, never a scene."""
    down, right = (size, size) if isinstance(size, int) else size
    reach = (down // 2, right // 2)
    whole = (2 * reach[0] + 1) * (2 * reach[1] + 1)

    def close(values: np.ndarray) -> np.ndarray:
        there = ~np.isnan(values)
        grown = there & (_counts(values > 0, reach) > 0)
        return np.where(there, _counts(grown, reach) == whole, np.nan)

    found = spatial.tiled(pixels, F.coalesce(mask, F.lit(False)).cast("int"), 2 * max(reach), close, "closed")
    return found.withColumn("closed", F.col("closed").cast("int"))


def _tile_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of a tile's cells the number of the cell, the first in scan order, that its component in the tile has: cells make runs,
    runs that touch are joined, and trees of runs are flattened until all edges are within one."""
    order = np.lexsort((x, y))
    height, width = int(np.ptp(y)) + 1, int(np.ptp(x)) + 1
    runs = np.full((height, width), -1, np.int64)
    sy, sx = y[order] - y.min(), x[order] - x.min()
    new = np.ones(len(order), bool)
    new[1:] = (sy[1:] != sy[:-1]) | (sx[1:] > sx[:-1] + 1)
    run = np.cumsum(new) - 1
    runs[sy, sx] = run
    touch = (runs[:-1] >= 0) & (runs[1:] >= 0)
    a, b = runs[:-1][touch], runs[1:][touch]
    parent = np.arange(int(run[-1]) + 1)
    while True:
        pa_, pb_ = parent[a], parent[b]
        apart = pa_ != pb_
        if not apart.any():
            break
        a, b, pa_, pb_ = a[apart], b[apart], pa_[apart], pb_[apart]
        np.minimum.at(parent, np.maximum(pa_, pb_), np.minimum(pa_, pb_))
        while (parent != parent[parent]).any():
            parent = parent[parent]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[parent[run]]]
    return out


def _settled(edges: DataFrame, most_rounds: int) -> DataFrame:
    """scene, node, label of the nodes of edges (scene, a, b; both ways): the least node that each can reach.

    Each round hooks every node to the neighbour that is least by a hash, if that is less than its own, follows the hooks two steps on, and
    contracts the graph: what is left are edges between what the nodes are hooked to. By a hash chains of hooks are short whatever the
    shape is, so a few in ten nodes remain, rounds grow with the logarithm of their number, and the tables, which are checkpointed, as
    lineage would double otherwise, get ever smaller."""
    nodes = {side: F.struct(F.xxhash64(side).alias("h"), F.col(side).alias("node")).alias(side) for side in "ab"}
    edges, hooks = edges.select("scene", *nodes.values()), []
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        up = edges.groupBy("scene", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        for _step in range(2):
            up = up.join(up.select("scene", F.col("node").alias("up"), F.col("up").alias("top")), ["scene", "up"]).select("scene", "node", F.col("top").alias("up"))
        up = checkpointed(up)
        hooks.append(up)
        ends = [up.select("scene", F.col("node").alias(side), F.col("up").alias(f"up_{side}")) for side in "ab"]
        edges = checkpointed(edges.join(ends[0], ["scene", "a"]).join(ends[1], ["scene", "b"]).where("up_a <> up_b").select("scene", F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct())
    else:
        raise RuntimeError("labels did not settle")
    if not hooks:
        return edges.select("scene", F.col("a.node").alias("node"), F.col("a.node").alias("label"))
    labels = hooks[0].withColumnRenamed("up", "label")
    for up in hooks[1:]:
        labels = labels.join(up.withColumnRenamed("node", "label"), ["scene", "label"], "left").select("scene", "node", F.coalesce("up", "label").alias("label"))
    labels = checkpointed(labels.select("scene", "node.node", F.col("label.node").alias("top")))
    least = labels.groupBy("scene", "top").agg(F.min("node").alias("label"))
    return labels.join(least, ["scene", "top"]).select("scene", "node", "label")


def components(cells: DataFrame, most_rounds: int = 60, tile: int = 512) -> DataFrame:
    """scene, y, x, label: cells (scene, y, x) connected by their sides; the label is the component's first (y, x0) in scan order.

    Each tile is labelled by itself, in one shuffle. Only where labels meet across the borders of tiles are they joined to each other,
    a graph of labels at borders that is far smaller than the cells, and rounds are few for a component that spans many tiles.
    """
    kinds = {c: cells.schema[c].dataType for c in ("scene", "y", "x")}
    placed = cells.select("scene", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        first = _tile_labels(y, x)
        return table.append_column("ly", pa.array(y[first])).append_column("lx", pa.array(x[first]))

    keyed = placed.groupBy("scene", F.floor(F.col("y") / tile), F.floor(F.col("x") / tile))
    found = checkpointed(keyed.applyInArrow(run, f"scene {kinds['scene'].simpleString()}, y long, x long, ly long, lx long"))
    node = F.struct(F.col("ly").alias("y"), F.col("lx").alias("x0"))
    meets = []
    for along, across in (("x", "y"), ("y", "x")):
        last = found.where(F.pmod(F.col(along), F.lit(tile)) == tile - 1).select("scene", across, (F.col(along) + 1).alias(along), node.alias("a"))
        first = found.where(F.pmod(F.col(along), F.lit(tile)) == 0).select("scene", across, along, node.alias("b"))
        meets.append(last.join(first, ["scene", "y", "x"]).select("scene", "a", "b"))
    joined = meets[0].unionByName(meets[1]).distinct()
    edges = checkpointed(joined.unionByName(joined.select("scene", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _settled(edges, most_rounds).select("scene", F.col("node.y").alias("ly"), F.col("node.x0").alias("lx"), F.col("label").alias("joined"))
    out = found.join(labels, ["scene", "ly", "lx"], "left")
    label = F.coalesce("joined", node).cast(f"struct<y: {kinds['y'].simpleString()}, x0: {kinds['x'].simpleString()}>")
    return out.select("scene", F.col("y").cast(kinds["y"]).alias("y"), F.col("x").cast(kinds["x"]).alias("x"), label.alias("label"))


#: Fixed: codes of the kinds of clusters.
KINDS = {"active_fault": 1, "landslide": 2, "subsidence": 3, "uplift_other": 4}


def attribute(clusters: DataFrame, velocity: str, distance: str | None = None, slope: str | None = None, fault: float = 300.0, steep: float = 15.0) -> DataFrame:
    """scene, label, pixels, means, kind and code of each cluster: landslide on steep ground, active_fault near a fault, else
    subsidence or uplift_other by the sign of the mean velocity."""
    means = {"mean_velocity": velocity, "mean_distance": distance, "mean_slope": slope}
    out = clusters.groupBy("scene", "label").agg(F.count("*").alias("pixels"), *[(F.avg(c) if c else F.lit(None).cast("double")).alias(n) for n, c in means.items()])
    kind = F.when(F.col("mean_slope") >= steep, "landslide").when(F.col("mean_distance") <= fault, "active_fault").when(F.col("mean_velocity") < 0, "subsidence").otherwise("uplift_other")
    return out.withColumn("kind", kind).withColumn("code", F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("kind")))


def kind_counts(attributed: DataFrame) -> DataFrame:
    """kind, code and clusters of every kind, 0 for those that no cluster has."""
    return attributed.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(code).alias("code"), F.col(k).alias("clusters")) for k, code in KINDS.items()]))
    )


def inside(x: Column, y: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Whether a point is in a polygon by the even-odd rule, so that inner rings are holes. Edges are literals of the plan: a
    region of interest is small."""
    crossings = [
        ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        for ring in rings
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True)
        if y1 != y2
    ]
    return sum((c.cast("int") for c in crossings), F.lit(0)) % 2 == 1


def near_edge(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a cell is on the drawn line between two places: along its longer axis, at most half a cell off it."""
    wide = F.abs(x2 - x1) >= F.abs(y2 - y1)

    def along(a: Column, b: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
        slope = F.when(a2 != a1, (b2 - b1) / (a2 - a1)).otherwise(0.0)
        return a.between(F.least(a1, a2), F.greatest(a1, a2)) & (F.abs(b - (b1 + (a - a1) * slope)) <= 0.5)

    return F.when(wide, along(x, y, x1, y1, x2, y2)).otherwise(along(y, x, y1, x1, y2, x2))


def on_outline(x: Column, y: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Whether a cell is on the drawn outline of a polygon of cells: along the longer axis of an edge, at most half a cell off it."""
    out = F.lit(False)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            along, across, a1, b1, a2, b2 = (x, y, x1, y1, x2, y2) if abs(x2 - x1) >= abs(y2 - y1) else (y, x, y1, x1, y2, x2)
            slope = (b2 - b1) / (a2 - a1) if a2 != a1 else 0.0
            out |= along.between(min(a1, a2), max(a1, a2)) & (F.abs(across - (b1 + (along - a1) * slope)) <= 0.5)
    return out


def inside_cells(x: Column, y: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Whether a cell is in a polygon given in cells, its outline included."""
    return inside(x, y, rings) | on_outline(x, y, rings)


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The area that two boxes (west, south, east, north) share; 0 where they only touch."""
    wide = F.least(a["east"], b["east"]) - F.greatest(a["west"], b["west"])
    high = F.least(a["north"], b["north"]) - F.greatest(a["south"], b["south"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def segments(vertices: DataFrame, line: str = "line_id", order: str = "seq") -> DataFrame:
    """seg (line, number), x1, y1, x2, y2 from the consecutive vertices (lon, lat) of lines."""
    w = Window.partitionBy(line).orderBy(order)
    pairs = vertices.select(F.struct(F.col(line).alias("line"), F.col(order).alias("seq")).alias("seg"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(w).alias("x2"), F.lead("lat").over(w).alias("y2"))
    return pairs.where("x2 IS NOT NULL")


def levels_of(*tables: DataFrame) -> list[int]:
    """The levels (column _level) of tables of placed shapes, ascending: a power of two is a level, so there are few."""
    own = functools.reduce(DataFrame.unionByName, [t.select("_level").distinct() for t in tables]).distinct()
    return sorted(r[0] for r in own.collect() if r[0] is not None)


def _level(size: Column, share: float) -> Column:
    """The level whose cells (2 ** level wide) are at least `share` of a shape's size; null for a shape without size."""
    return F.when(size > 0, F.ceil(F.log2(size * F.lit(share))).cast("int"))


#: A segment lies in about so many cells of its own level; a box in four at most.
ALONG = 4
#: Cells of a batch, at most.
ROWS = 100_000


def _cells_along(segments: DataFrame, level: Column) -> DataFrame:
    """The segments (x1, y1, x2, y2) with each cell (_l, _cx, _cy) of a level that they touch, a millionth of a cell around them included:
    columns of cells first, then in each the cells that the segment passes there."""
    own = segments.withColumn("_l", level)

    def counted(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each number from first to last of each row its row and itself."""
        n = (last - first + 1).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        return row, first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = 1e-6
        for batch in batches:
            width = np.exp2(batch.column("_l").to_numpy().astype(float))
            x1, y1, x2, y2 = (batch.column(c).to_numpy().astype(float) / width for c in ("x1", "y1", "x2", "y2"))
            low, high = np.minimum(x1, x2), np.maximum(x1, x2)
            row, cx = counted(np.floor(low - pad), np.floor(high + pad))
            x1, y1, x2, y2, low, high = (c[row] for c in (x1, y1, x2, y2, low, high))
            with np.errstate(all="ignore"):
                slope = (y2 - y1) / (x2 - x1)
            ends = [np.where(x1 != x2, y1 + (x - x1) * slope, y) for x, y in ((np.maximum(low, np.minimum(high, cx - pad)), y1), (np.minimum(high, np.maximum(low, cx + 1 + pad)), y2))]
            column, cy = counted(np.floor(np.minimum(*ends) - pad), np.floor(np.maximum(*ends) + pad))
            for k in range(0, len(column), ROWS):
                some = column[k : k + ROWS]
                cells = [pa.array(c.astype(np.int64)) for c in (cx[some], cy[k : k + ROWS])]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row[some])).columns, *cells], names=[*batch.schema.names, "_cx", "_cy"])

    return own.mapInArrow(run, StructType([*own.schema.fields, StructField("_cx", LongType()), StructField("_cy", LongType())]))


def _cell() -> list:
    """The columns of a cell, behind a hash of them by which sorts tell cells apart at once, as there are few levels."""
    return [F.xxhash64("_l", "_cx", "_cy").alias("_key"), "_l", "_cx", "_cy"]


def _met(homes: DataFrame, visits: DataFrame) -> DataFrame:
    """Shapes in the same cell (see _cell). Exploded tables are never sent whole to all tasks, whatever their size seemed before."""
    return homes.join(visits.hint("merge"), ["_key", "_l", "_cx", "_cy"])


def _crossed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of segments, of which `first` tells whether h is the smaller one, those that cross, and where: in numpy, as the planner puts
    a condition of many terms into the join term by term."""
    for batch in batches:
        own = {n: batch.column(n) for n in batch.schema.names}
        first = own["first"].to_numpy(zero_copy_only=False)
        h, v = ([own[f"{t}_{c}"].to_numpy() for c in ("x1", "y1", "x2", "y2")] for t in "hv")
        ax1, ay1, ax2, ay2 = (np.where(first, p, q) for p, q in zip(h, v, strict=True))
        bx1, by1, bx2, by2 = (np.where(first, q, p) for p, q in zip(h, v, strict=True))
        d = (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1)
        with np.errstate(all="ignore"):
            t = ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / d
            u = ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / d
            at = np.flatnonzero((np.abs(d) >= 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        ax1, ay1, ax2, ay2, t = (c[at] for c in (ax1, ay1, ax2, ay2, t))
        kept = [own[n].take(pa.array(at)) for n in ("first", "h_seg", "v_seg")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ax1 + t * (ax2 - ax1)), pa.array(ay1 + t * (ay2 - ay1))], names=["first", "h_seg", "v_seg", "x", "y"])


#: Visitors of one cell that one task compares with the cell's own boxes.
BLOCK = 1000


def _met_in_blocks(homes: DataFrame, visits: DataFrame) -> DataFrame:
    """As _met, for cells with any number of visitors: those of a cell are dealt over blocks of about BLOCK, each of which meets the boxes
    that are at home there, so that one cell's pairs are spread over tasks."""
    cell = ["_l", "_cx", "_cy"]
    blocks = visits.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    dealt = visits.join(blocks.hint("merge"), cell).withColumn("_block", F.pmod(F.xxhash64(*visits.columns), "_n")).drop("_n")
    each = homes.join(blocks.hint("merge"), cell).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    # A number of partitions that is asked for stays: few bytes make many pairs, so small partitions are not to be put together.
    parts, keys = int(homes.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*cell, "_block"]
    return each.repartition(parts, *keys).join(dealt.repartition(parts, *keys).hint("merge"), keys).drop("_block")


def crossings(lines: DataFrame) -> DataFrame:
    """seg_a, seg_b, x, y of each pair of segments (seg, x1, y1, x2, y2) that cross, a shared end included; parallel ones are left out.

    Segments of any lengths meet in cells of several levels: each is at home in the cells along it of a level by its own size, about
    ALONG of them, and visits the cells that it touches of each higher level that is in use. A pair meets at the higher of its two
    levels, so a long segment meets only short ones near it, and cells are as small as what is in them. Segments with a coordinate that
    is unknown or infinite are left out.
    """
    sides = ("x1", "y1", "x2", "y2")
    known = lines.select("seg", *[finite(F.col(c).cast("double")).alias(c) for c in sides]).dropna(subset=list(sides))
    size = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    placed = known.withColumn("_level", _level(size, 1 / ALONG)).where("_level IS NOT NULL")
    levels = levels_of(placed)
    if not levels:
        levels = [0]
    ends = {t: [F.col(c).alias(f"{t}_{c}") for c in ("seg", *sides)] for t in "hv"}
    homes = _cells_along(placed, F.col("_level")).select(*_cell(), *ends["h"])
    above = placed.withColumn("_l", F.explode(F.filter(F.lit(levels), lambda l: l >= F.col("_level"))))
    visits = _cells_along(above, F.col("_l")).select(*_cell(), "_level", *ends["v"])
    both = _met(homes, visits).where((F.col("_level") < F.col("_l")) | (F.col("h_seg") < F.col("v_seg")))
    pair = both.select((F.col("h_seg") < F.col("v_seg")).alias("first"), *[f"{t}_{c}" for t in "hv" for c in ("seg", *sides)])
    seg = lines.schema["seg"].dataType.simpleString()
    met = pair.mapInArrow(_crossed, f"first boolean, h_seg {seg}, v_seg {seg}, x double, y double")
    return met.select(F.when(F.col("first"), F.col("h_seg")).otherwise(F.col("v_seg")).alias("seg_a"), F.when(F.col("first"), F.col("v_seg")).otherwise(F.col("h_seg")).alias("seg_b"), "x", "y").distinct()


def crossing_points(found: DataFrame, digits: int = 9) -> DataFrame:
    """x, y and crossings (how many pairs of segments) of the distinct points of crossings(); points that agree to so many digits are
    one."""
    near = found.groupBy(F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))
    return near.agg(F.count("*").alias("crossings"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """a joined to b where their boxes (west, south, east, north) touch, of any sizes.

    Boxes meet in cells of several levels: each is at home in at most four cells of a level by its own size, and visits the cells that it
    touches of each higher level that is in use. A pair meets at the higher of its two levels and counts only in the cell of the corner
    where both begin, so no pair comes twice, and boxes are compared with near ones alone. Columns of a and b must differ but for the
    sides, of which a's and b's come as a_west, b_west, ...; boxes with an unknown or infinite side, or whose sides are the wrong way
    round, touch nothing.
    """
    sides = ("west", "south", "east", "north")

    def placed(boxes: DataFrame, prefix: str) -> DataFrame:
        own = boxes.withColumnsRenamed({s: f"{prefix}_{s}" for s in sides}).withColumns({f"_{prefix}_{s}": finite(F.col(f"{prefix}_{s}").cast("double")) for s in sides})
        own = own.where(f"_{prefix}_west <= _{prefix}_east AND _{prefix}_south <= _{prefix}_north").drop(*[f"_{prefix}_{s}" for s in sides])
        return own.withColumn("_level", _level(F.greatest(F.col(f"{prefix}_east") - F.col(f"{prefix}_west"), F.col(f"{prefix}_north") - F.col(f"{prefix}_south")).cast("double"), 1.0))

    def in_cells(boxes: DataFrame, prefix: str) -> DataFrame:
        for side, low, high in (("_cx", "west", "east"), ("_cy", "south", "north")):
            width = F.pow(F.lit(2.0), F.col("_l"))
            boxes = boxes.withColumn(side, F.explode(F.sequence(F.floor(F.col(f"{prefix}_{low}") / width), F.floor(F.col(f"{prefix}_{high}") / width))))
        return boxes

    left, right = placed(a, "a"), placed(b, "b")
    levels = levels_of(left, right) or [0]
    # Boxes without a size are at home in the smallest cells in use.
    left, right = (t.withColumn("_level", F.coalesce("_level", F.lit(levels[0]))) for t in (left, right))

    def homes(boxes: DataFrame, prefix: str) -> DataFrame:
        return in_cells(boxes.withColumn("_l", F.col("_level")), prefix).drop("_level")

    def visits(boxes: DataFrame, prefix: str, same: bool) -> DataFrame:
        higher = F.filter(F.lit(levels), lambda l: (l >= F.col("_level")) if same else (l > F.col("_level")))
        return in_cells(boxes.withColumn("_l", F.explode(higher)), prefix).drop("_level")

    met = _met_in_blocks(homes(left, "a"), visits(right, "b", True)).unionByName(_met_in_blocks(homes(right, "b"), visits(left, "a", False)))
    touch = "a_east >= b_west AND a_west <= b_east AND a_north >= b_south AND a_south <= b_north"
    width = F.pow(F.lit(2.0), F.col("_l"))
    first = (F.floor(F.greatest("a_west", "b_west") / width) == F.col("_cx")) & (F.floor(F.greatest("a_south", "b_south") / width) == F.col("_cy"))
    return met.where(touch).where(first).drop("_l", "_cx", "_cy")
