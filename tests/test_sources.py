"""Files of each kind, written here and read back, and the stream of pairs."""

import datetime
import json
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard

from pyspark.sql import functions as F

from regolith.operators import knowledge, spatial
from regolith.sources import layouts, projects, rasters
from regolith.streaming import coherence


def cube_of(df):
    rows = df.collect()
    return {(r.scene, r.band, r.y, r.x): r.value for r in rows}


def test_npy(spark, tmp_path):
    cube = np.arange(24, dtype="f4").reshape(2, 3, 4)
    cube[1, 2, 3] = np.nan
    np.save(tmp_path / "a.npy", cube)
    np.save(tmp_path / "b.npy", np.ones((2, 2), np.uint16))
    got = cube_of(rasters.read_npy(spark, str(tmp_path)))
    assert len(got) == 28 and got["a", 2, 2, 3] is None and got["a", 2, 0, 1] == 13 and got["b", 1, 1, 1] == 1
    np.save(tmp_path / "c.npy", np.array([{"x": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        rasters.read_npy(spark, str(tmp_path)).count()


@pytest.mark.parametrize(("order", "axes"), [("bsq", (0, 1, 2)), ("bil", (1, 0, 2)), ("bip", (1, 2, 0))])
def test_envi(spark, tmp_path, order, axes):
    cube = np.arange(24).reshape(2, 3, 4).astype(">i2")
    (tmp_path / "v.img").write_bytes(b"xx" + cube.transpose(axes).tobytes())
    (tmp_path / "v.hdr").write_text(f"ENVI\nsamples = 4\nlines = 3\nbands = 2\nheader offset = 2\ndata type = 2\ninterleave = {order}\nbyte order = 1\nwavelength units = Nanometers\nwavelength = {{\n 450.5,\n 2200.0}}\n")
    got = cube_of(rasters.read_envi(spark, str(tmp_path)))
    assert got == {("v", b + 1, y, x): float(cube[b, y, x]) for b in range(2) for y in range(3) for x in range(4)}
    assert rasters.envi_wavelengths(rasters.envi_header((tmp_path / "v.hdr").read_text())) == [0.4505, 2.2]


@pytest.mark.parametrize("cut", [64, 1 << 10, 1 << 22])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy_blocks(monkeypatch, tmp_path, cut, order):
    """Whatever the size of a block, the blocks together are the cube, each value once."""
    monkeypatch.setattr(layouts, "BLOCK_BYTES", cut)
    cube = np.random.default_rng(1).integers(0, 9999, (3, 17, 11)).astype("<i4")
    np.save(tmp_path / "a.npy", np.asarray(cube, order=order))
    assert (whole(str(tmp_path / "a.npy")) == cube).all()


def whole(path):
    raster, read = layouts.opened(path)
    out = np.full((raster.bands, raster.height, raster.width), np.nan)
    for k in range(raster.blocks):
        own, band, y, x = raster.block(read, k)
        place = out[band : band + own.shape[0], y : y + own.shape[1], x : x + own.shape[2]]
        assert np.isnan(place).all()
        place[:] = own
    return out


def tiff_bytes(cube, order="<", compression=1, predictor=1, planes=False, tile=None, rows=4, extra=()):
    """A TIFF file of a (bands, rows, columns) cube, written plainly, block by block."""
    bands, height, width = cube.shape
    kind = cube.dtype.newbyteorder(order)
    blocks = []
    for group in [cube[k : k + 1] for k in range(bands)] if planes else [cube]:
        for y in range(0, height, tile or rows):
            for x in range(0, width, tile or width):
                own = group[:, y : y + (tile or rows), x : x + (tile or width)].transpose(1, 2, 0)
                if tile:
                    own = np.pad(own, [(0, tile - own.shape[0]), (0, tile - own.shape[1]), (0, 0)])
                if predictor == 2:
                    own = np.concatenate([own[:, :1], np.diff(own, axis=1)], axis=1)
                data = own.astype(kind).tobytes()
                if predictor == 3:
                    lines = own.astype(own.dtype.newbyteorder(">")).reshape(own.shape[0], -1)
                    apart = lines.view(np.uint8).reshape(*lines.shape, -1).transpose(0, 2, 1).reshape(own.shape[0], -1, own.shape[2])
                    data = np.concatenate([apart[:, :1], np.diff(apart, axis=1)], axis=1).astype(np.uint8).tobytes()
                blocks.append({1: bytes, 8: zlib.compress, 5: lzw, 32773: packbits, 50000: zstandard.ZstdCompressor().compress}[compression](data))
    fields = {256: ("H", [width]), 257: ("H", [height]), 258: ("H", [kind.itemsize * 8] * bands), 259: ("H", [compression]), 277: ("H", [bands]), 284: ("H", [2 if planes else 1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands), **dict(extra)}
    fields |= {322: ("H", [tile]), 323: ("H", [tile])} if tile else {278: ("H", [rows])}
    places = np.cumsum([8, *map(len, blocks)])
    fields |= {324 if tile else 273: ("I", places[:-1].tolist()), 325 if tile else 279: ("I", [len(b) for b in blocks])}
    start = int(places[-1])
    beyond = start + 2 + 12 * len(fields) + 4
    entries, tail = b"", b""
    for tag, (code, values) in sorted(fields.items()):
        value = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(value) > 4:
            here, tail = struct.pack(order + "I", beyond + len(tail)), tail + value
        else:
            here = value.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, {"B": 1, "H": 3, "I": 4, "d": 12}[code], len(values)) + here
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, start) + b"".join(blocks) + struct.pack(order + "H", len(fields)) + entries + bytes(4) + tail


def lzw(data):
    """Codes with the encoder's own rule for widths: a code more once 511, 1023 or 2047 are taken; a clear code before 4095."""
    bits, table, word = "", {}, b""

    def fresh():
        return {bytes([i]): i for i in range(256)}

    table, used, width = fresh(), 258, 9
    bits = f"{256:09b}"
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        bits += f"{table[word]:0{width}b}"
        table[word + bytes([byte])] = used
        used += 1
        width = 9 + (used > 511) + (used > 1023) + (used > 2047)
        if used == 4094:
            bits += f"{256:0{width}b}"
            table, used, width = fresh(), 258, 9
        word = bytes([byte])
    if word:
        bits += f"{table[word]:0{width}b}"
        used += 1
        width = 9 + (used > 511) + (used > 1023) + (used > 2047)
    bits += f"{257:0{width}b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data):
    """Runs of 3 and more as such, the rest as it is."""
    out = b""
    for run in re.finditer(rb"(.)\1{2,127}|(?:(.)(?!\2\2)){1,128}", data, re.S):
        own = run.group()
        out += bytes([257 - len(own), own[0]]) if run.group(1) else bytes([len(own) - 1]) + own
    return out


@pytest.mark.parametrize("kind", ["u1", "i2", "u4", "f4", "f8"])
@pytest.mark.parametrize(("order", "compression", "predictor", "planes", "tile"), [("<", 1, 1, False, None), (">", 8, 2, True, None), ("<", 5, 2, False, None), (">", 32773, 1, False, 16), ("<", 50000, 3, False, 16), (">", 8, 3, True, 16), ("<", 8, 2, False, 16), (">", 5, 1, True, 16)])
def test_tiff_layouts(tmp_path, kind, order, compression, predictor, planes, tile):
    if (predictor == 3 and kind[0] != "f") or (predictor == 2 and kind[0] == "f"):
        predictor = 1
    cube = (np.random.default_rng(2).integers(0, 40, (3, 37, 21)) * 3).astype(kind)
    cube[:, 5:30, 3:15] = 7
    (tmp_path / "a.tif").write_bytes(tiff_bytes(cube, order, compression, predictor, planes, tile))
    assert (whole(str(tmp_path / "a.tif")) == cube).all()


def test_lzw_of_long_data(tmp_path):
    cube = np.random.default_rng(3).integers(0, 255, (1, 200, 200)).astype("u1")
    (tmp_path / "a.tif").write_bytes(tiff_bytes(cube, compression=5, rows=200))
    assert (whole(str(tmp_path / "a.tif")) == cube).all()


def test_tiff_profiles_and_sensor(spark, tmp_path):
    """Bands of the most populous resolution on their common grid; places of corners, of middles, and by a matrix."""
    cubes = {k: np.arange(12 + n, dtype="i2").reshape(1, 3, -1)[..., :4] * n if n % 3 == 0 else np.full((1, 3, 4), n, "i2") for n, k in enumerate(("B02", "B03", "B8A", "B10"), 2)}
    keys = (1, 1, 0, 2, 1025, 0, 1, 2, 3072, 0, 1, 32647)
    for n, (name, cube) in enumerate(cubes.items()):
        size = 60.0 if name == "B10" else 10.0
        places = [(33550, ("d", [size, size, 0.0])), (33922, ("d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]))]
        (tmp_path / f"{name}.tif").write_bytes(tiff_bytes(cube, "<>"[n % 2], 8, extra=[*places, (34735, ("H", keys)), (42113, ("B", list(b"-9999\0")))] if name == "B03" else places))
    (tmp_path / "m.tiff").write_bytes(tiff_bytes(cubes["B02"], extra=[(34264, ("d", [2.0, 0.5, 0, 7, 0.25, -2.0, 0, 8, 0, 0, 0, 0, 0, 0, 0, 1]))]))
    found = {r.scene: r for r in rasters.tiff_profiles(spark, str(tmp_path)).collect()}
    assert found["B02"].transform == [10, 0, 500, 0, -10, 900] and found["B02"].epsg is None and found["B02"].nodata is None and found["B10"].resolution == 60
    assert found["B03"].transform == [10, 0, 495, 0, -10, 905] and found["B03"].epsg == 32647 and found["B03"].nodata == -9999
    assert found["m"].transform == [2, 0.5, 7, 0.25, -2, 8] and (found["m"].bands, found["m"].height, found["m"].width, found["m"].dtype) == (1, 3, 4, "<i2")
    pixels, names = rasters.read_sensor(spark, str(tmp_path), "s")
    assert names == ["B2", "B3", "B8A"]
    rows = {(r.y, r.x): (r.B2, r.B3, r.B8A) for r in pixels.collect()}
    assert rows == {(y, x): tuple(float(cubes[k][0, y, x]) for k in ("B02", "B03", "B8A")) for y in range(3) for x in range(4)}


@pytest.mark.parametrize("dtype", ["f4", "i2"])
def test_write_tiff(spark, tmp_path, dtype):
    """Strips in several tasks, gaps, cells beyond the grid, repeated and null ones, scenes side by side."""
    cells = [("a", 0, 0, 5.0), ("a", 0, 0, 3.0), ("a", 599, 1999, 9.0), ("a", 600, 0, 1.0), ("a", 1, 1, None), (None, 0, 0, 1.0), ("b", 530, 7, -2.0)]
    df = spark.createDataFrame(cells, "scene string, y int, x int, value double").repartition(3)
    assert rasters.write_tiff(df, str(tmp_path), 600, 2000, dtype, (10.0, 0.0, 500.0, 0.0, -10.0, 900.0), 32647, -1.0) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif"]
    wanted = {k: np.full((1, 600, 2000), -1.0) for k in "ab"}
    wanted["a"][0, 0, 0], wanted["a"][0, 599, 1999], wanted["b"][0, 530, 7] = 5, 9, -2
    for k in "ab":
        assert (whole(str(tmp_path / f"{k}.tif")) == wanted[k]).all()
    found = rasters.tiff_profiles(spark, str(tmp_path)).orderBy("scene").first()
    assert found.transform == [10, 0, 500, 0, -10, 900] and found.epsg == 32647 and found.nodata == -1 and found.dtype == f"<{dtype}"
    got = rasters.read_tiff(spark, str(tmp_path))
    assert got.where("value <> -1").count() == 3 and got.count() == 2 * 600 * 2000


def test_tasks_have_few_cells_however_small_the_files(spark, tmp_path):
    """Two files of nothing but ones, which compress to some KB, are read by as many tasks as their cells need."""
    height, width = 3000, 1000
    cells = spark.range(height * width).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("scene"), F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"), F.lit(1.0).alias("value"))
    rasters.write_tiff(cells, str(tmp_path), height, width, "f8")
    found = rasters.read_tiff(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 2 * height * width
    assert max(r.n for r in found) <= 2 * rasters.TASK_CELLS and len(found) >= 4


def test_read_stack(spark, tmp_path):
    """A pair of the first one's size, one of another size, one without coherence, one without metadata, one without displacement."""
    def pair(name, disp=None, coherence=None, meta=True):
        folder = tmp_path / "area" / "sentinel1_insar" / name
        folder.mkdir(parents=True)
        if meta:
            (folder / "metadata.json").write_text(json.dumps({"master_date": name[:10], "slave_date": name[11:21], "temporal_baseline_days": 12}))
        for file, cube in (("los_displacement", disp), ("coherence", coherence)):
            if cube is not None:
                (folder / f"{file}.tif").write_bytes(tiff_bytes(np.asarray(cube, "f4")[None], compression=8))

    big = np.arange(15.0).reshape(3, 5)
    big[1, 1] = np.nan
    pair("2024-01-01_2024-01-13", big, np.full((3, 5), 0.5))
    pair("2024-01-13_2024-01-25", [[0, 8], [4, 12]], [[0.1, 0.9], [0.1, 0.9]])
    pair("2024-01-25_2024-02-06", big)
    pair("2023-01-01_2023-01-13", big, meta=False)
    pair("2023-02-01_2023-02-13", coherence=big)
    found = projects.read_stack(spark, str(tmp_path / "area"))
    rows = {(r.pair, r.y, r.x): r for r in found.collect()}
    assert len(rows) == 45 and {k[0] for k in rows} == {"2024-01-01_2024-01-13", "2024-01-13_2024-01-25", "2024-01-25_2024-02-06"}
    assert rows["2024-01-01_2024-01-13", 1, 1].disp is None and rows["2024-01-01_2024-01-13", 2, 4].disp == 14
    mid = rows["2024-01-13_2024-01-25", 1, 2]
    assert mid.disp == 6 and mid.coherence == pytest.approx(0.5) and mid.layered and mid.baseline == 12 and mid.sec_date == datetime.date(2024, 1, 25)
    assert rows["2024-01-25_2024-02-06", 0, 1].coherence is None and not rows["2024-01-25_2024-02-06", 0, 1].layered
    (tmp_path / "none").mkdir()
    assert projects.read_stack(spark, str(tmp_path / "none")) is None


def test_read_scene(spark, tmp_path):
    cube = np.arange(24, dtype="i2").reshape(2, 3, 4)
    (tmp_path / "s.tif").write_bytes(tiff_bytes(cube, compression=8, extra=[(42113, ("B", list(b"5\0")))]))
    tags = "".join(f"<{t}>{v}</{t}>" for t, own in (("wavelengthCenterOfBand", (420, 2200)), ("GainOfBand", (2, 3)), ("OffsetOfBand", (1,))) for v in own)
    (tmp_path / "m.xml").write_text(f"<r>{tags}</r>")
    cells, wavelengths = rasters.read_scene(spark, str(tmp_path / "s.tif"), str(tmp_path / "m.xml"))
    got = cube_of(cells)
    assert wavelengths == [0.42, 2.2] and got["s", 1, 1, 1] is None and got["s", 1, 0, 3] == 6 and got["s", 2, 2, 3] == 69


def test_read_cubes(spark, tmp_path):
    """Two cubes of different sizes: the common grid, the second's bands behind the first's, ignored values null."""
    for name, (bands, lines, samples), waves in (("vnir", (2, 3, 4), "450, 900"), ("swir", (1, 2, 5), "2200")):
        (tmp_path / f"{name}.bsq").write_bytes(np.arange(bands * lines * samples).astype("<f4").tobytes())
        (tmp_path / f"{name}.hdr").write_text(f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {bands}\ndata type = 4\ninterleave = bsq\nbyte order = 0\ndata ignore value = 6\nwavelength = {{{waves}}}\n")
    cells, wavelengths = rasters.read_cubes(spark, [str(tmp_path / "vnir.hdr"), str(tmp_path / "swir.hdr")], "p")
    got = cube_of(cells)
    assert wavelengths == [0.45, 0.9, 2.2] and len(got) == 24
    assert got["p", 1, 1, 2] is None and got["p", 2, 1, 3] == 19 and got["p", 3, 1, 3] == 8 and got["p", 3, 1, 1] is None


def test_tiff_head_of_large_files():
    head = layouts.tiff_head(3000, 10, "f4", 1000, [1 << 31] * 3)
    raster = layouts.tiff(lambda at, n: head[at : at + n])
    assert (raster.height, raster.width, raster.blocks) == (3000, 10, 3) and head[2] == 43


def test_band_files(spark, tmp_path):
    for name in ("B10.tif", "B02.TIF", "band8a.tiff", "B8.tif", "QA.tif", "B01.tif"):
        (tmp_path / name).write_bytes(b"II*")
    assert [r.band for r in rasters.band_files(spark, str(tmp_path)).collect()] == ["B1", "B2", "B8", "B8A", "B10"]


def test_kml(spark, tmp_path):
    head = '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>'
    tail = "</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>"
    (tmp_path / "a.kml").write_text("﻿" + head + "\n1,2,0 3,4 x,y 5,6,7\n" + tail, encoding="utf-8")
    (tmp_path / "b.kml").write_text(head + "1,2 3,4" + tail)
    got = {r.file: r.ring and [(p.lon, p.lat) for p in r.ring] for r in rasters.read_kml(spark, str(tmp_path)).collect()}
    assert got == {"a.kml": [(1, 2), (3, 4), (5, 6), (1, 2)], "b.kml": None}


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, ring[::-1]]}}, {"geometry": None}]}))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "MultiPolygon", "coordinates": [[ring], [ring]]}))
    rows = rasters.read_geojson(spark, str(tmp_path)).collect()
    assert {(r.file, r.part, r.ring) for r in rows} == {("a.geojson", 0, 0), ("a.geojson", 0, 1), ("b.geojson", 0, 0), ("b.geojson", 1, 0)}
    assert [(r.lon, r.lat) for r in sorted((r for r in rows if r.file == "a.geojson" and r.ring == 0), key=lambda r: r.seq)] == [tuple(p) for p in ring]


def test_band_metadata(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<a:r xmlns:a="urn:x"><a:b><a:wavelengthCenterOfBand>420.5</a:wavelengthCenterOfBand><a:GainOfBand>2</a:GainOfBand><a:FWHMOfBand>6.5</a:FWHMOfBand></a:b><b><wavelengthCenterOfBand> 990 </wavelengthCenterOfBand><wavelengthCenterOfBand>none</wavelengthCenterOfBand><GainOfBand>3</GainOfBand></b></a:r>')
    assert [tuple(r) for r in rasters.band_metadata(spark, str(tmp_path / "m.xml")).collect()] == [(0, 0.4205, 2.0, None, 0.0065), (1, 0.99, 3.0, None, None)]


def test_stream_of_pairs(spark, tmp_path):
    rows = []
    for day in range(1, 7):
        rows += [(datetime.datetime(2024, 1, day, 5), f"p{day}", 12 * day, float(np.exp(-12 * day / 90)) + e) for e in (-0.01, 0.01)]
    rows.append((datetime.datetime(2024, 1, 20), "end", 1, 0.5))
    schema = "arrived timestamp, pair_id string, baseline int, coherence double"
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = coherence.fit_stream(stream, str(tmp_path / "pairs"), str(tmp_path / "fit"), str(tmp_path / "state"))
    started.processAllAvailable()
    started.stop()
    fit = spark.read.parquet(str(tmp_path / "fit")).first()
    assert fit.samples == 6 and fit.tau_days == pytest.approx(90, rel=0.02)


def test_knowledge(spark, tmp_path):
    own = {"mineral": "clay", "priority": 1, "sensor_ratio": {"ASTER": "B5/B6（low）"}, "crosta_pca": {"sensor": "ASTER", "input_bands": ["B1", "B4"], "landsat8_bands": ["B2"], "pc_criterion": {"positive_bands": ["B4"]}}}
    base = [{"commodity": "gold", "deposit_types": [{"type_name": "vein", "alterations": [own, {"mineral": "iron", "sensor_ratio": {}}]}]}, {"commodity": "late", "deposit_types": [{"type_name": "vein", "alterations": []}, {"type_name": "skarn", "alterations": [own]}]}]
    (tmp_path / "kb.json").write_text(json.dumps({"commodities": base}))
    rows = projects.read_knowledge(spark, str(tmp_path / "kb.json"))
    assert sorted((r.commodity, r.deposit, r.a_pos, r.mineral) for r in rows.collect()) == [("gold", "vein", 0, "clay"), ("gold", "vein", 1, "iron"), ("late", "skarn", 0, "clay")]
    found = knowledge.targets(rows.where("deposit = 'vein'"), F.lit("ASTER")).collect()
    assert [(r.mineral, r.ratio_expr, r.pca_bands) for r in found] == [("clay", "B5/B6", ["B1", "B4"])]
    assert [r.pca_bands for r in knowledge.targets(rows, F.lit("Landsat8")).collect()] == [["B2"], ["B2"]] and knowledge.targets(rows, F.lit("Sentinel2")).count() == 0


def test_pairs_lines_projects(spark, tmp_path):
    for name, meta in (("p1", {"master_date": "2024-01-01", "slave_date": "2024-01-13", "temporal_baseline_days": 12}), ("p2", {"master_date": "2024-01-01", "slave_date": "2024-02-01"})):
        (tmp_path / "aoi" / name).mkdir(parents=True)
        (tmp_path / "aoi" / name / "metadata.json").write_text(json.dumps(meta, indent=1))
    assert sorted((r.pair_id, r.baseline) for r in projects.read_pairs(spark, str(tmp_path / "aoi")).collect()) == [("p1", 12), ("p2", None)]
    assert [tuple(r) for r in projects.list_projects(spark, str(tmp_path / "aoi")).collect()] == [("p1", 1), ("p2", 1)]
    features = [{"geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}, {"geometry": None}, {"geometry": {"type": "MultiLineString", "coordinates": [[[5, 5], [6, 6]], [[7, 7], [8, 8]]]}}, {"geometry": {"type": "Point", "coordinates": [1, 1]}}]
    (tmp_path / "l.geojson").write_text(json.dumps({"features": features}))
    rows = projects.read_lines(spark, str(tmp_path / "l.geojson")).collect()
    assert sorted((r.line_id, r.seq, r.lon) for r in rows) == [("l.geojson/0/0", 0, 0), ("l.geojson/0/0", 1, 2), ("l.geojson/2/0", 0, 5), ("l.geojson/2/0", 1, 6), ("l.geojson/2/1", 0, 7), ("l.geojson/2/1", 1, 8)]


def test_calibration_and_synthetic_scene(spark):
    row = spark.createDataFrame([([1, -9, 3], [2.0, 2.0, 2.0], [0.5, 0.5, 0.5])], "d array<int>, g array<double>, o array<double>")
    assert row.select(projects.calibrated(row.d, row.g, row.o, -9)).first()[0] == [2.5, None, 6.5]
    scene = projects.synthetic_scene(spark, 3, 20, 30)
    assert scene.count() == 600 and scene.agg(F.min("B1"), F.max("B3")).first()[0] >= 100 and scene.where("y = 7 AND x = 10").first().B2 == 2800
    assert scene.orderBy("y", "x").collect() == projects.synthetic_scene(spark, 3, 20, 30).orderBy("y", "x").collect()


def test_types_and_extra_commodities(spark, tmp_path):
    base = [{"commodity": "gold", "commodity_en": "Gold", "deposit_types": [{"type_name": "vein", "type_en": "Vein", "ore_elements": ["Au"]}]}, {"commodity": "empty"}, {"commodity": "gold", "deposit_types": [{"type_name": "late"}]}]
    more = [{"commodity": "oil", "category": "energy", "deposit_types": [{"type_name": "seep", "alterations": [{"mineral": "clay", "sensor_ratio": {"ASTER": "B5/B6"}}]}, {"type_name": "vein"}]}]
    (tmp_path / "kb.json").write_text(json.dumps({"commodities": base}))
    (tmp_path / "oil.json").write_text(json.dumps(more))
    types = projects.read_types(spark, str(tmp_path / "kb.json"), str(tmp_path / "oil.json"))
    assert [(r.commodity, r.commodity_en, r.category) for r in knowledge.commodities(types).collect()] == [("gold", "Gold", ""), ("empty", "", ""), ("gold", "", ""), ("oil", "", "energy")]
    assert [r.type_name for r in knowledge.deposit_types(types, "gold").collect()] == ["vein"]
    assert knowledge.deposit_types(types, "empty").count() == 0 and knowledge.deposit_types(types, "none").count() == 0
    meta = {r.type_name: (r.commodity, r.type_en, r.ore_elements, r.host_rocks) for r in knowledge.deposit_meta(types).collect()}
    assert meta["vein"] == ("gold", "Vein", ["Au"], []) and set(meta) == {"vein", "late", "seep"}
    assert [(r.deposit, r.mineral) for r in projects.read_knowledge(spark, str(tmp_path / "kb.json"), str(tmp_path / "oil.json")).collect()] == [("seep", "clay")]


def test_sensor_folders_and_areas(spark, tmp_path):
    root = tmp_path / "delivery"
    for name in ("p1/Sentinel-2_a/B02.tif", "p1/Sentinel-2_b/B02.tif", "p1/Sentinel-2_b/B03.tif", "p1/Landsat 8/B4.tif", "p1/notes/readme.txt", "p2/aster l1t/B1.tif"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"II*")
    found = projects.sensor_folders(spark, str(root), {"Sentinel2": ["sentinel 2"], "Landsat8": ["landsat 8"], "ASTER": ["aster"]})
    assert {(r.project, r.sensor, r.folder, r.bands) for r in found.collect()} == {("p1", "Sentinel2", "Sentinel-2_b", 2), ("p1", "Landsat8", "Landsat 8", 1), ("p2", "ASTER", "aster l1t", 1)}
    for name in ("aoi1/sentinel1_insar/a_b", "aoi1/sentinel1_insar/b_c", "aoi2/sentinel1_insar/a_b", "aoi3/other/a_b"):
        (tmp_path / "stacks" / name).mkdir(parents=True)
        (tmp_path / "stacks" / name / "metadata.json").write_text("{}")
    assert [tuple(r) for r in projects.areas_with_stacks(spark, str(tmp_path / "stacks")).collect()] == [("aoi1", 2), ("aoi2", 1)]


def test_projects_are_resolved_by_rank(spark):
    box = "west double, south double, east double, north double"
    known = spark.createDataFrame([("7", "North Ridge", 0.0, 0.0, 2.0, 2.0), ("8", "north_ridge", 5.0, 5.0, 9.0, 9.0), ("9", "south", 1.0, 1.0, 4.0, 4.0)], f"id string, project string, {box}")
    wanted = spark.createDataFrame([("8", None, None, None, None), ("North Ridge", None, None, None, None), ("NORTH-RIDGE", None, None, None, None), ("renamed", 1.5, 1.5, 5.5, 5.5), ("gone", 50.0, 50.0, 51.0, 51.0), ("nothing", None, None, None, None)], f"name string, {box}")
    assert {r.name: (r.project, r.how) for r in projects.resolve_projects(wanted, known).collect()} == {
        "8": ("north_ridge", "id"), "North Ridge": ("North Ridge", "exact"), "NORTH-RIDGE": ("North Ridge", "normalized"), "renamed": ("south", "spatial"), "gone": (None, "none"), "nothing": (None, "none"),
    }


def test_reflectance_and_joined_cubes(spark):
    px = spark.createDataFrame([("s", 1, 0, 0, 100.0), ("s", 2, 0, 0, -9.0)], "scene string, band int, y int, x int, value double")
    meta = "idx int, wavelength_um double, gain double, offset double"
    own, w = rasters.reflectance(px, spark.createDataFrame([(0, 0.4, 0.01, 1.0), (1, 0.5, 0.02, None)], meta), 2, -9.0)
    assert w == [0.4, 0.5] and {r.band: r.value for r in own.collect()} == {1: 1.0, 2: None}
    for rows, bands in (([(0, 0.4, 1.0, 0.0)], 2), ([(0, 0.4, 1.0, 0.0), (1, None, 1.0, 0.0)], 2), ([(0, 0.4, 1.0, 0.0), (1, float("nan"), 1.0, 0.0)], 2)):
        with pytest.raises(ValueError):
            rasters.reflectance(px, spark.createDataFrame(rows, meta), bands)
    both, w = rasters.joined_cubes(px, px, (2, 2), ([0.4, 0.5], [1.4, 1.5]))
    assert w == [0.4, 0.5, 1.4, 1.5] and sorted(r.band for r in both.collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        rasters.joined_cubes(px, px, (2, 2), ([0.4, 0.5], [1.4, float("inf")]))


def test_layers_of_the_first_product_on_a_grid(spark):
    products = spark.createDataFrame([("far", 0, 50.0, 50.0, 60.0, 60.0, [1.0, 0.0, 50.0, 0.0, -1.0, 60.0]), ("near", 1, 0.0, 0.0, 4.0, 4.0, [1.0, 0.0, 0.0, 0.0, -1.0, 4.0]), ("late", 2, 0.0, 0.0, 4.0, 4.0, [1.0, 0.0, 0.0, 0.0, -1.0, 4.0])], "product string, pos int, west double, south double, east double, north double, transform array<double>")
    px = spark.createDataFrame([(p, layer, y, x, float(10 * y + x) + k) for p in ("near", "late") for k, layer in enumerate(("distance", "slope")) for y in range(4) for x in range(4)], "product string, layer string, y int, x int, value double")
    target = spark.createDataFrame([("s", 0, 0, 1.0, 2.0), ("s", 0, 1, 1.5, 2.5), ("s", 0, 2, 99.0, 2.0)], "scene string, y int, x int, lon double, lat double")
    found = {r.x: (r.distance, r.density, r.slope) for r in spatial.layers_on_grid(products, px, target, (1.0, 1.0, 2.0, 3.0)).collect()}
    assert found == {0: (21.0, None, 22.0), 1: (16.5, None, 17.5), 2: (None, None, None)}
    assert spatial.layers_on_grid(products, px, target, (-9.0, -9.0, -8.0, -8.0)) is None


def test_other_names_of_bands(spark, tmp_path):
    assert rasters.band_aliases({"B1": "B01", "B2": "b02", "B3N": "B3N", "B8A": "B08A", "B10": "B10"}) == {"B01": "B1", "B02": "B2", "B3": "B3N"}
    assert rasters.band_aliases({"B3": "B3", "B3N": "B3N", "B3B": "B3B"}) == {}
    for name, value in (("B01", 1.0), ("B3N", 3.0), ("B3B", 4.0)):
        cells = spark.createDataFrame([(name, y, x, value) for y in range(2) for x in range(2)], "scene string, y int, x int, value double")
        rasters.write_tiff(cells, str(tmp_path), 2, 2, "f8")
    pixels, names = rasters.read_sensor(spark, str(tmp_path), "s")
    assert names == ["B1", "B3B", "B3N"] and {tuple(r) for r in pixels.select("B1", "B01", "B3", "B3N", "B3B").collect()} == {(1.0, 1.0, 3.0, 3.0, 4.0)}


def test_resolutions_in_whole_units(spark):
    bands = spark.createDataFrame([("s", 1, "", 10.0), ("s", 2, "", 29.99), ("s", 3, "", 30.01), ("s", 4, "", 15.0)], "scene string, number int, suffix string, resolution double")
    assert sorted(r.number for r in rasters.dominant_resolution(bands).collect()) == [2, 3]


def test_a_pair_without_a_baseline_is_left_out_of_the_decay(spark):
    from regolith.operators import deformation

    pairs = spark.createDataFrame([(12, 0.9), (24, 0.8), (36, 0.7), (None, 0.1)], "baseline int, coherence double")
    assert deformation.decay(pairs).first() == deformation.decay(pairs.where("baseline IS NOT NULL")).first()


def test_kinds_of_synthetic_scenes(spark):
    def at(scene, y, x):
        return scene.where((scene.y == y) & (scene.x == x)).first()

    mixed, forest, urban = (projects.synthetic_scene(spark, kind=k) for k in ("mixed", "forest", "urban"))
    plants, water, town = at(mixed, 60, 99), at(mixed, 120, 159), at(mixed, 239, 200)
    assert (plants.B5, plants.B4) == (4500, 1000) and (water.B3, water.B5) == (3000, 500) and (town.B4, town.B5) == (3500, 2000)
    assert (at(forest, 199, 50).B5, at(forest, 199, 50).B3) == (5000, 1500) and at(forest, 200, 50).B5 < 3000
    assert urban.select("B6", "B5", "B4").distinct().collect() == [(2500.0, 1500.0, 2800.0)]
    assert projects.synthetic_scene(spark, 3, 60, 60, kind="mixed").columns == ["scene", "y", "x", "B1", "B2", "B3"]
    with pytest.raises(ValueError, match="unknown kind"):
        projects.synthetic_scene(spark, kind="sea")


def test_evidence_that_no_product_has_is_left_out(spark):
    from regolith.operators import evidence

    target = spark.range(100).selectExpr("'s' AS scene", "id div 10 AS y", "id % 10 AS x", "(id % 10) * 1.0D AS lon", "(id div 10) * 1.0D AS lat", "id * 1.0D AS a")
    products = spark.createDataFrame([("p", 0, 0.0, 0.0, 9.0, 9.0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "product string, pos int, west double, south double, east double, north double, transform array<double>")
    cells = spark.range(100).selectExpr("'p' AS product", "'deformation' AS layer", "id div 10 AS y", "id % 10 AS x", "(99 - id) * 1.0D AS value")
    layers = {"alteration": F.col("a")}
    alone, own = evidence.prospectivity(target, layers)
    for box, other in (((50.0, 50.0, 60.0, 60.0), None), ((0.0, 0.0, 5.0, 5.0), 0.15)):
        scored, summary = evidence.prospectivity_at(target, layers, box, structure=(products, cells), deformed=(products, cells))
        if other is None:
            assert summary.first() == own.first() and scored.orderBy("y", "x").select("score").collect() == alone.orderBy("y", "x").select("score").collect()
        else:
            # Deformation counts against alteration by its weight, and the structural layer, which the product lacks, for nothing.
            low, high = np.quantile(np.arange(100.0), [0.02, 0.98])
            up = np.clip((np.arange(100) - low) / (high - low), 0, 1)
            wanted = (0.3 * up + other * up[::-1]) / (0.3 + other)
            assert np.allclose([r.score for r in scored.orderBy("y", "x").collect()], wanted)


def test_lines_share_files(spark, tmp_path):
    """The lines of 2,500 customers make three files, each line under its own key."""
    from pathlib import Path

    from regolith.plans import catalog
    from regolith.session import shared_folder

    spark.range(5000).selectExpr("id AS o_orderkey", "id % 2500 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.glob("lines-*"))
    found = {r.line: r.n for r in catalog.QUERIES["line_files"](spark, str(tmp_path)).collect()}
    assert found == dict.fromkeys(range(2500), 2)
    (folder,) = set(shared.glob("lines-*")) - before
    assert len(list(folder.glob("*.geojson"))) == 3


def test_lines_have_a_property_as_name(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}
    features = [{"type": "Feature", "properties": {"name": "f"}, "geometry": line}, {"type": "Feature", "geometry": line}]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert {(r.line_id, r.name, r.seq) for r in projects.read_lines(spark, str(tmp_path), "name").collect()} == {(f"x.geojson/{k}/0", n, i) for k, n in enumerate(("f", None)) for i in (0, 1)}
