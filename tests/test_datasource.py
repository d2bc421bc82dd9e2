"""Rasters as a Spark data source: blocks, filters, round trips, aborted writes."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from regolith.sources import datasource, layouts, rasters

CELLS = "scene string, y int, x int, value double"


@pytest.fixture(scope="module")
def source(spark):
    return datasource.register(spark)


def counted(monkeypatch):
    """The blocks that are read from now on."""
    seen = []

    def opened(path, header=None, opened=layouts.opened):
        raster, read = opened(path, header)
        return layouts.Raster(**{**vars(raster), "block": lambda r, k: seen.append(k) or raster.block(r, k)}), read

    monkeypatch.setattr(layouts, "opened", opened)
    return seen


def test_a_window_reads_its_own_blocks_alone(tmp_path, monkeypatch):
    cube = np.arange(4 * 60 * 50, dtype="f8").reshape(4, 60, 50)
    np.save(tmp_path / "a.npy", cube)
    monkeypatch.setattr(layouts, "BLOCK_BYTES", 50 * 8 * 10)  # ten rows of a band
    seen = counted(monkeypatch)
    whole = datasource.RasterReader({"path": str(tmp_path)})
    rows = [r for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()]
    assert len(seen) == 24 and {(r["band"] - 1, r["y"], r["x"]): r["value"] for r in rows} == {k: v for k, v in np.ndenumerate(cube)}
    seen.clear()
    some = datasource.RasterReader({"path": str(tmp_path), "bands": "2,4", "rows": "15:22", "columns": "3:5"})
    rows = [r for p in some.partitions() for b in some.read(p) for r in b.to_pylist()]
    assert len(seen) == 4  # two strips of each of two bands
    assert {(r["band"], r["y"], r["x"]): r["value"] for r in rows} == {(b, y, x): cube[b - 1, y, x] for b in (2, 4) for y in range(15, 22) for x in (3, 4)}
    seen.clear()
    pushed = datasource.RasterReader({"path": str(tmp_path)})
    filters = [EqualTo(("band",), 3), GreaterThanOrEqual(("y",), 50), LessThan(("x",), 7), In(("x",), (1, 5)), EqualTo(("scene",), "a")]
    np.save(tmp_path / "other.npy", cube)
    assert list(pushed.pushFilters(filters)) == filters and [p.path[-5:] for p in pushed.partitions()] == ["a.npy"]
    rows = [r for p in pushed.partitions() for b in pushed.read(p) for r in b.to_pylist()]
    assert len(seen) == 1 and {(r["band"], r["y"]) for r in rows} == {(3, y) for y in range(50, 60)} and {r["x"] for r in rows} == set(range(1, 6))


def test_parts_of_a_file_cover_it_once(tmp_path, monkeypatch):
    np.save(tmp_path / "a.npy", np.zeros((1, 100, 50)))
    monkeypatch.setattr(datasource, "PART_BYTES", 3000)
    monkeypatch.setattr(layouts, "BLOCK_BYTES", 2000)
    seen = counted(monkeypatch)
    own = datasource.RasterReader({"path": str(tmp_path)})
    parts = own.partitions()
    assert len(parts) > 10
    n = sum(b.num_rows for p in parts for b in own.read(p))
    assert n == 5000 and sorted(seen) == list(range(20))


def test_round_trip(source, tmp_path):
    cells = source.range(3 * 90 * 70).selectExpr("concat('s', id div 6300) AS scene", "id % 6300 div 70 AS y", "id % 70 AS x", "IF(id % 17 = 0, NULL, id * 0.5) AS value")
    out = datasource.arranged(cells).write.format("raster").mode("append").option("height", 90).option("width", 70).option("dtype", "f8").option("transform", "30,0,1000,0,-30,2000").option("epsg", 32633)
    out.save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["s0.tif", "s1.tif", "s2.tif"]
    found = source.read.format("raster").load(str(tmp_path))
    assert found.columns == ["scene", "band", "y", "x", "value"]
    wanted = cells.select("scene", F.lit(1).alias("band"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("value").cast("double"))
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    profile = rasters.tiff_profiles(source, str(tmp_path)).first()
    assert profile.transform == [30, 0, 1000, 0, -30, 2000] and profile.epsg == 32633
    window = source.read.format("raster").load(str(tmp_path)).where("scene = 's1' AND y BETWEEN 3 AND 5 AND x < 4")
    assert sorted((r.y, r.x) for r in window.collect()) == [(y, x) for y in (3, 4, 5) for x in range(4)]
    same = source.read.format("raster").option("rows", "3:6").option("columns", ":4").load(str(tmp_path)).where("scene = 's1'")
    assert sorted((r.y, r.x) for r in same.collect()) == [(y, x) for y in (3, 4, 5) for x in range(4)]
    datasource.arranged(cells.where("scene = 's2'")).write.format("raster").mode("overwrite").option("height", 90).option("width", 70).save(str(tmp_path))
    assert os.listdir(tmp_path) == ["s2.tif"]


def test_a_failed_write_leaves_nothing(source, tmp_path):
    cells = source.createDataFrame([(s, y, 0, 1.0) for s in ("a", "b", "c") for y in range(4)], CELLS)
    broken = datasource.arranged(cells).withColumn("value", F.when(F.col("scene") == "c", F.raise_error(F.lit("stopped here")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stopped here"):
        broken.write.format("raster").mode("append").option("height", 4).option("width", 2).save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    split = datasource.arranged(cells).repartition(4, "y")
    with pytest.raises(Exception, match="several tasks|order of their rows"):
        split.write.format("raster").mode("append").option("height", 4).option("width", 2).save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_empty_folders_and_odd_cells(source, tmp_path):
    assert source.read.format("raster").load(str(tmp_path)).count() == 0
    cells = source.createDataFrame([("a", 1, 1, math.nan), ("a", 0, 5, 2.0), ("a", -1, 0, 3.0), ("a", 1, 0, 4.0), ("a", 1, 0, 5.0), (None, 0, 0, 1.0)], CELLS)
    datasource.arranged(cells.where("y >= 0 OR scene IS NULL")).write.format("raster").mode("append").option("height", 2).option("width", 2).option("dtype", "i2").option("nodata", -1).save(str(tmp_path))
    found = {(r.y, r.x): r.value for r in source.read.format("raster").load(str(tmp_path)).collect()}
    assert found == {(0, 0): -1, (0, 1): -1, (1, 0): 5, (1, 1): -1}
