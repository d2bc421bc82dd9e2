"""Rasters as a Spark data source: spark.read.format("raster") and df.write.format("raster").

register(spark) makes the name known. Reading gives scene (the file's name), band (from 1), y, x and value of .npy, .tif and .tiff files
(an ENVI cube needs its header, see sources.rasters). A file's blocks are dealt out to partitions by its size alone; a block is read only
where the bands and the box that are asked for meet it. They are asked for by the options `bands` ("1,3"), `rows` and `columns` ("10:20",
from and before), and by filters on scene, band, y and x, for which register() turns spark.sql.python.filterPushdown.enabled on.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from regolith.sources import layouts

SCHEMA = "scene string, band int, y int, x int, value double"
NAMES = r"(?i)\.(npy|tiff?)$"
#: Bytes of a file, about, for each partition.
PART_BYTES = 1 << 25
#: Rows of an Arrow batch.
ROWS = 1 << 16
_FAR = 1 << 40


@dataclass
class Asked:
    """Spans (from, before) of bands, rows and columns that are asked for, and single bands where some are named."""

    spans: list[tuple[int, int]] = field(default_factory=lambda: [(0, _FAR)] * 3)
    bands: frozenset[int] | None = None
    scenes: frozenset[str] | None = None

    def narrow(self, axis: int, low: int = -_FAR, high: int = _FAR) -> None:
        a, b = self.spans[axis]
        self.spans[axis] = max(a, low), min(b, high)

    def meets(self, extent: tuple[tuple[int, int], ...]) -> bool:
        near = all(a < d and c < b for (a, b), (c, d) in zip(self.spans, extent, strict=True))
        return near and (self.bands is None or any(extent[0][0] <= b < extent[0][1] for b in self.bands))


@dataclass
class Part(InputPartition):
    """One of `of` runs of a file's blocks."""

    path: str
    number: int
    of: int


def _scene(path: str) -> str:
    return re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.asked = options["path"], Asked()
        if options.get("bands"):
            self.asked.bands = frozenset(int(b) - 1 for b in options["bands"].split(","))
        for axis, name in ((1, "rows"), (2, "columns")):
            if options.get(name):
                low, _, high = options[name].partition(":")
                self.asked.narrow(axis, int(low or 0), int(high) if high else _FAR)

    def pushFilters(self, filters) -> Iterable:
        """Bounds on band, y and x choose blocks; all filters come back, since a block holds more than what is asked for."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "scene" and isinstance(f, (EqualTo, In)):
                named = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.asked.scenes = named if self.asked.scenes is None else self.asked.scenes & named
            axis, less = {"band": (0, 1), "y": (1, 0), "x": (2, 0)}.get(name, (None, 0))
            if axis is not None and isinstance(f, In) and all(isinstance(v, int) for v in f.value) and f.value:
                self.asked.narrow(axis, min(f.value) - less, max(f.value) - less + 1)
            elif axis is not None and isinstance(getattr(f, "value", None), int):
                at = f.value - less
                bounds = {EqualTo: (at, at + 1), GreaterThan: (at + 1, _FAR), GreaterThanOrEqual: (at, _FAR), LessThan: (-_FAR, at), LessThanOrEqual: (-_FAR, at + 1)}
                if type(f) in bounds:
                    self.asked.narrow(axis, *bounds[type(f)])
            yield f

    def partitions(self) -> list[Part]:
        """Parts by the files' sizes; no file is opened."""
        files = [(path, size) for path, size in layouts.listed(self.path) if re.search(NAMES, path) and (self.asked.scenes is None or _scene(path) in self.asked.scenes)]
        found = [(path, -(-max(1, size) // PART_BYTES)) for path, size in files]
        return [Part(path, k, of) for path, of in found for k in range(of)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.of:
            return
        raster, read = layouts.opened(part.path)
        scene = _scene(part.path)
        for k in range(part.number * raster.blocks // part.of, (part.number + 1) * raster.blocks // part.of):
            if self.asked.meets(raster.extent(k)):
                yield from self._rows(scene, raster, *raster.block(read, k))

    def _rows(self, scene: str, raster, cube: np.ndarray, *origin: int) -> Iterator[pa.RecordBatch]:
        """The part of a block that is asked for, in batches; values that are not finite are null."""
        cut = [(max(a - o, 0), max(min(b - o, n), 0)) for (a, b), o, n in zip(self.asked.spans, origin, cube.shape, strict=True)]
        for b in range(*cut[0]):
            if self.asked.bands is not None and origin[0] + b not in self.asked.bands:
                continue
            own = cube[b, slice(*cut[1]), slice(*cut[2])].astype(float)
            if not own.size:
                continue
            step = max(1, ROWS // own.shape[1])
            for first in range(0, len(own), step):
                some = own[first : first + step]
                y, x = np.indices(some.shape, np.int32)
                value, n = some.ravel(), some.size
                columns = [pa.array([scene]).take(pa.array(np.zeros(n, np.int32))), np.full(n, origin[0] + b + 1, np.int32), (y.ravel() + origin[1] + cut[1][0] + first).astype(np.int32), (x.ravel() + origin[2] + cut[2][0]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(value, mask=~np.isfinite(value))], names=["scene", "band", "y", "x", "value"])


@dataclass
class Written(WriterCommitMessage):
    """Finished files of a task: where they are, and where they go."""

    files: list[tuple[str, str]]


class RasterWriter(DataSourceArrowWriter):
    """Single-band GeoTIFF files, strip by strip, in a staging folder that commit empties into the target and abort removes."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.height, self.width = int(options["height"]), int(options["width"])
        self.kind = np.dtype(options.get("dtype", "f4")).newbyteorder("<")
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.transform = tuple(float(v) for v in options["transform"].split(",")) if options.get("transform") else None
        self.epsg = int(options["epsg"]) if options.get("epsg") else None
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        self.rows = max(1, (1 << 20) // max(1, self.width))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        layouts.folder_made(self.staging)
        files, scene, strips, number, open_ = [], None, None, 0, None
        for batch in iterator:
            codes = batch.column(batch.schema.get_field_index("scene")).to_pylist()
            y, x = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("y", "x"))
            value = batch.column(batch.schema.get_field_index("value")).to_numpy(zero_copy_only=False).astype(float)
            starts = [0, *[k for k in range(1, len(codes)) if codes[k] != codes[k - 1] or y[k] // self.rows != y[k - 1] // self.rows], len(codes)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                if codes[a] != scene:
                    if scene is not None:
                        files.append(self._closed(scene, strips, number, open_))
                    scene, strips, number, open_ = codes[a], self._opened(), 0, None
                strip = int(y[a]) // self.rows
                if strip < number:
                    raise ValueError(f"the cells of {scene} are not in the order of their rows: write what arranged() gives")
                while number < strip:
                    self._put(strips, number, open_)
                    number, open_ = number + 1, None
                open_ = self._blank(number) if open_ is None else open_
                inside = (y[a:b] >= 0) & (y[a:b] < self.height) & (x[a:b] >= 0) & (x[a:b] < self.width) & ~np.isnan(value[a:b])
                open_[y[a:b][inside] - strip * self.rows, x[a:b][inside]] = value[a:b][inside]
        if scene is not None:
            files.append(self._closed(scene, strips, number, open_))
        return Written(files)

    def _opened(self) -> tuple[str, object, object, list[int]]:
        path = f"{self.staging}/{uuid.uuid4().hex}"
        return path, *layouts.created(f"{path}.strips"), []

    def _blank(self, number: int) -> np.ndarray:
        empty = self.nodata if self.nodata is not None else np.nan if self.kind.kind == "f" else 0
        return np.full((max(0, min(self.rows, self.height - number * self.rows)), self.width), empty, self.kind)

    def _put(self, strips, number: int, cells: np.ndarray | None) -> None:
        data = zlib.compress((self._blank(number) if cells is None else cells).tobytes(), 6)
        strips[1].write(data)
        strips[3].append(len(data))

    def _closed(self, scene: str, strips, number: int, open_: np.ndarray | None) -> tuple[str, str]:
        """The head, whose places need all sizes, and the strips behind it."""
        path, _, finish, sizes = strips
        while number * self.rows < self.height:
            self._put(strips, number, open_)
            number, open_ = number + 1, None
        finish()
        out, done = layouts.created(f"{path}.tif")
        out.write(layouts.tiff_head(self.height, self.width, self.kind.str, self.rows, sizes, self.transform, self.epsg, self.nodata))
        read = layouts.reader(f"{path}.strips")
        for at in range(0, sum(sizes), 1 << 22):
            out.write(read(at, min(1 << 22, sum(sizes) - at)))
        done()
        layouts.removed(f"{path}.strips")
        return f"{path}.tif", f"{self.path}/{scene}.tif"

    def commit(self, messages: list[Written | None]) -> None:
        """Files get their names at the end; a scene from two tasks is an error, as neither has all of it."""
        files = [pair for m in messages if m is not None for pair in m.files]
        names = [target for _, target in files]
        if twice := {n for n in names if names.count(n) > 1}:
            self.abort(messages)
            raise ValueError(f"written by several tasks: {sorted(twice)[:3]}; write what arranged() gives")
        if self.overwrite:
            for path, _ in layouts.listed(self.path):
                if re.search(NAMES, path):
                    layouts.removed(path)
        for source, target in files:
            layouts.moved(source, target)
        layouts.removed(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        layouts.removed(self.staging)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """The session, in which "raster" is a format for reading and writing, and filters reach Python sources."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def arranged(cells: DataFrame) -> DataFrame:
    """Cells (scene, y, x, value) as the writer takes them: each scene in one task, in the order of its rows, its last column the source's
    own schema. A scene streams through its task, which holds a strip of it. Null scenes' cells fall away."""
    own = cells.where("scene IS NOT NULL").select("scene", F.lit(1).alias("band"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    return own.repartition("scene").sortWithinPartitions("scene", "y", "x", "value")
