"""How raster files are laid out, so that a task can read its own blocks of a file and no other bytes."""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs

Read = Callable[[int, int], bytes]
#: Decoded bytes of a block of an .npy or ENVI file, about.
BLOCK_BYTES = 1 << 22
#: Fixed: ENVI's data types as numpy's.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
#: Fixed: ENVI's interleaves as the order of band, row and column.
ENVI_AXES = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}
#: Fixed: TIFF's field types as numpy's; rationals are pairs.
TIFF_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4", 11: "f4", 12: "f8", 16: "u8", 17: "i8", 18: "u8"}
#: Fixed: TIFF's sample formats as numpy's kinds.
SAMPLE_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Raster:
    """A raster of bands, rows and columns in blocks. block(read, k) gives the k-th one as a (bands, rows, columns) cube with the band,
    row and column of its first value; extent(k) says where that is before anything is read: first and behind last band, row and column;
    transform: x and y of a corner are a * column + b * row + c and d * column + e * row + f."""

    bands: int
    height: int
    width: int
    dtype: str
    blocks: int
    block: Callable[[Read, int], tuple[np.ndarray, int, int, int]]
    nodata: float | None = None
    transform: tuple[float, ...] | None = None
    epsg: int | None = None
    extent: Callable[[int], tuple[tuple[int, int], tuple[int, int], tuple[int, int]]] | None = None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the name in it of a file as Spark names it: local ones, and those that Arrow opens (hdfs, s3, gs, abfs)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest if colon else path)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest, safe="/:@"))


def reader(path: str) -> Read:
    """Reads ranges of a file."""
    store, name = _store(path)
    file = store.open_input_file(name)
    return lambda offset, length: file.read_at(length, offset)


def folder_made(path: str) -> None:
    store, name = _store(path)
    store.create_dir(name, recursive=True)


def listed(path: str) -> list[tuple[str, int]]:
    """The files in a folder, or a file itself, with their sizes, by name."""
    store, name = _store(path)
    if store.get_file_info(name).type == fs.FileType.File:
        return [(path, store.get_file_info(name).size)]
    scheme, colon, _ = path.partition(":")
    lead = "" if not colon else "file://" if scheme == "file" else f"{scheme}://"
    found = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted((lead + f.path, f.size) for f in found if f.type == fs.FileType.File)


def moved(source: str, target: str) -> None:
    store, name = _store(source)
    place = _store(target)[1]
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(place).type == fs.FileType.File:
        store.delete_file(place)
    store.move(name, place)


def removed(path: str) -> None:
    """Removes a folder or a file, if it is there."""
    store, name = _store(path)
    kind = store.get_file_info(name).type
    if kind == fs.FileType.Directory:
        store.delete_dir(name)
    elif kind == fs.FileType.File:
        store.delete_file(name)


def created(path: str) -> tuple[pa.NativeFile, Callable[[], None]]:
    """A new file, and what closes it and puts it at the path in place of any that is there; an attempt that ends before leaves the
    path alone."""
    store, name = _store(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    file = store.open_output_stream(part)

    def finish() -> None:
        file.close()
        if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(name).type == fs.FileType.File:
            store.delete_file(name)
        store.move(part, name)

    return file, finish


def _plain(kind: np.dtype, stored: tuple[int, int, int], axes: Sequence[int], offset: int, **more) -> Raster:
    """A file of values one after another: `stored` is its shape, axes name band (0), row (1) and column (2) in the file's order."""
    outer, middle, inner = stored
    line = max(1, inner * kind.itemsize)
    step = min(max(1, middle), max(1, BLOCK_BYTES // line))
    group = max(1, BLOCK_BYTES // (line * max(1, middle))) if step >= middle else 1
    parts = -(-middle // step)
    back = np.argsort(axes)

    def block(read: Read, k: int) -> tuple[np.ndarray, int, int, int]:
        first, begin = k // parts * group, k % parts * step
        shape = (min(group, outer - first), min(step, middle - begin), inner)
        data = read(offset + (first * middle + begin) * inner * kind.itemsize, int(np.prod(shape)) * kind.itemsize)
        origin = (first, begin, 0)
        return np.frombuffer(data, kind).reshape(shape).transpose(back), *(origin[a] for a in back)

    def extent(k: int) -> tuple[tuple[int, int], ...]:
        first, begin = k // parts * group, k % parts * step
        spans = ((first, min(first + group, outer)), (begin, min(begin + step, middle)), (0, inner))
        return tuple(spans[a] for a in back)

    size = [stored[a] for a in back]
    return Raster(*size, kind.str, -(-outer // group) * parts if inner else 0, block, extent=extent, **more)


def npy(read: Read) -> Raster:
    """An .npy file of two or three dimensions, never of pickled objects."""
    head = io.BytesIO(read(0, 1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if kind.hasobject:
        raise ValueError("arrays of Python objects (allow_pickle) are not read")
    if len(shape) not in (2, 3):
        raise ValueError(f"a raster has two or three dimensions, not {len(shape)}")
    shape = (1, *shape)[-3:]
    return _plain(kind, shape[::-1] if fortran else shape, (2, 1, 0) if fortran else (0, 1, 2), head.tell())


def envi_header(text: str) -> dict[str, str]:
    """The entries of an ENVI header; braces may span lines."""
    return {k.strip().lower(): v.strip() for k, v in re.findall(r"(?m)^([^=\n;]+)=\s*(\{[^}]*\}|[^\n]*)", text)}


def envi(header: str) -> Raster:
    """An ENVI cube by its header's text."""
    own = envi_header(header)
    size = [int(own[k]) for k in ("bands", "lines", "samples")]
    kind = np.dtype((">" if own.get("byte order") == "1" else "<") + ENVI_TYPES[int(own["data type"])])
    axes = ENVI_AXES[own.get("interleave", "bsq").lower()]
    ignored = own.get("data ignore value")
    return _plain(kind, tuple(size[a] for a in axes), axes, int(own.get("header offset", 0)), nodata=float(ignored) if ignored else None)


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, 256 clears the table and 257 ends; widths change one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    single = [bytes([i]) for i in range(256)]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [*single, b"", b""], 9, b""
            continue
        if not table:
            table = [*single, b"", b""]
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def _unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: Fixed: TIFF's compressions.
EXPANDERS: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpackbits, 50000: _unzstd}


def _directory(read: Read) -> tuple[str, dict[int, np.ndarray]]:
    """The byte order and the fields of a TIFF file's first image; BigTIFF too."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    entry, word, small = (20, "Q", 8) if big else (12, "I", 4)
    lead = 8 if big else 2
    count = struct.unpack(order + ("Q" if big else "H"), read(at, lead))[0]
    listed, fields = read(at + lead, count * entry), {}
    for k in range(count):
        own = listed[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", own[:4])
        if kind not in TIFF_TYPES:
            continue
        n = struct.unpack(order + word, own[4 : 4 + small])[0] * (2 if kind in (5, 10) else 1)
        dtype = np.dtype(order + TIFF_TYPES[kind])
        value = own[4 + small :]
        data = value if n * dtype.itemsize <= small else read(struct.unpack(order + word, value)[0], n * dtype.itemsize)
        fields[tag] = np.frombuffer(data, dtype, n)
    return order, fields


def _place(fields: dict[int, np.ndarray]) -> tuple[tuple[float, ...] | None, int | None]:
    """The affine transform and the EPSG code of GeoTIFF fields."""
    keys = {int(k[0]): int(k[3]) for k in fields[34735].reshape(-1, 4)[1:] if k[1] == 0} if 34735 in fields else {}
    transform = None
    if 34264 in fields:
        transform = tuple(fields[34264].astype(float)[[0, 1, 3, 4, 5, 7]].tolist())
    elif 33550 in fields and 33922 in fields:
        (sx, sy), (i, j, _, x, y) = fields[33550][:2].tolist(), fields[33922][:5].tolist()
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    if transform and keys.get(1025) == 2:
        # Places are of the middle of a pixel.
        a, b, c, d, e, f = transform
        transform = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
    code = keys.get(3072, keys.get(2048))
    return transform, code if code and code < 32767 else None


def tiff(read: Read) -> Raster:
    """The first image of a TIFF or GeoTIFF file: strips or tiles of whole bytes, not compressed or by deflate, LZW, PackBits or zstd."""
    order, fields = _directory(read)

    def one(tag: int, default: int) -> int:
        return int(fields[tag][0]) if tag in fields else default

    width, height, bands, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    compression, predictor, planes = one(259, 1), one(317, 1), one(284, 1) == 2
    if bits % 8 or (258 in fields and len(set(fields[258].tolist())) > 1) or compression not in EXPANDERS or predictor not in (1, 2, 3) or one(339, 1) not in SAMPLE_KINDS:
        raise ValueError(f"not read: {bits} bits, compression {compression}, predictor {predictor}, sample format {one(339, 1)}")
    kind = np.dtype(f"{order}{SAMPLE_KINDS[one(339, 1)]}{bits // 8}")
    tiled = 324 in fields
    w, h = (one(322, width), one(323, height)) if tiled else (width, min(height, one(278, height)))
    offsets, sizes = (fields[324], fields[325]) if tiled else (fields[273], fields[279])
    across, down = -(-width // max(1, w)), -(-height // max(1, h))
    depth = 1 if planes else bands

    def block(read: Read, k: int) -> tuple[np.ndarray, int, int, int]:
        band, at = divmod(k, across * down)
        y, x = at // across * h, at % across * w
        rows = h if tiled else min(h, height - y)
        shape = (rows, w, depth)
        if not sizes[k]:
            # A block that was left out of the file.
            values = np.full(shape, 0 if nodata is None else nodata).astype(kind)
        else:
            data = EXPANDERS[compression](read(int(offsets[k]), int(sizes[k])))
            if predictor == 3:
                # Bytes are sorted by significance, and each is kept as the difference to the one `depth` before.
                apart = np.frombuffer(data, np.uint8, rows * w * depth * kind.itemsize).reshape(rows, -1, depth)
                parts = np.add.accumulate(apart, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, w * depth)
                values = np.ascontiguousarray(parts.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
            else:
                values = np.frombuffer(data, kind, rows * w * depth).reshape(shape)
                if predictor == 2:
                    values = np.add.accumulate(values, axis=1, dtype=kind.newbyteorder("="))
        return values[: height - y, : width - x].transpose(2, 0, 1), band, y, x

    def extent(k: int) -> tuple[tuple[int, int], ...]:
        band, at = divmod(k, across * down)
        y, x = at // across * h, at % across * w
        return (band, band + depth), (y, min(y + h, height)), (x, min(x + w, width))

    text = fields[42113].tobytes().split(b"\0")[0].decode().strip() if 42113 in fields else ""
    nodata = float(text) if text else None
    transform, epsg = _place(fields)
    return Raster(bands, height, width, kind.str, across * down * (bands if planes else 1), block, nodata, transform, epsg, extent)


def opened(path: str, header: str | None = None) -> tuple[Raster, Read]:
    """A file's layout, by its name's ending or its ENVI header, and what reads its ranges."""
    read = reader(path)
    if header is not None:
        return envi(header), read
    return (npy if path.lower().endswith(".npy") else tiff)(read), read


def tiff_head(height: int, width: int, dtype: str, rows: int, sizes: Sequence[int], transform: Sequence[float] | None = None, epsg: int | None = None, nodata: float | None = None) -> bytes:
    """What comes before the strips (of so many rows, compressed to such sizes) of a single-band deflate GeoTIFF file; a BigTIFF file
    where the strips take 4 GB. Coordinate systems below 5000 are geographic."""
    kind = np.dtype(dtype)
    big = sum(sizes) + 24 * len(sizes) + 4096 >= 1 << 32
    long, small = ("Q", 8) if big else ("I", 4)
    entries: list[tuple[int, int, bytes]] = []

    def put(tag: int, kind_of: int, *values) -> None:
        entries.append((tag, kind_of, values[0] if kind_of == 2 else np.array(values, "<" + TIFF_TYPES[kind_of]).tobytes()))

    number = 16 if big else 4
    put(256, 4, width)
    put(257, 4, height)
    put(258, 3, kind.itemsize * 8)
    put(259, 3, 8)
    put(262, 3, 1)
    put(273, number, *[0] * len(sizes))
    put(277, 3, 1)
    put(278, 4, rows)
    put(279, number, *sizes)
    put(339, 3, {v: k for k, v in SAMPLE_KINDS.items()}[kind.kind])
    if transform is not None:
        a, b, c, d, e, f = transform
        put(34264, 12, a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1)
    if epsg is not None:
        geographic = 4000 <= epsg < 5000
        put(34735, 3, 1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)
    if nodata is not None:
        put(42113, 2, f"{nodata:.17g}".encode() + b"\0")
    start = 16 if big else 8
    beyond = start + (8 if big else 2) + len(entries) * (20 if big else 12) + small
    total = beyond + sum(len(v) for _, _, v in entries if len(v) > small)
    places = total + np.cumsum([0, *sizes[:-1]])
    out, tail = [struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start), struct.pack("<Q" if big else "<H", len(entries))], []
    for tag, kind_of, value in entries:
        if tag == 273:
            value = places.astype("<" + TIFF_TYPES[number]).tobytes()
        count = len(value) // np.dtype(TIFF_TYPES[kind_of]).itemsize
        if len(value) > small:
            here = struct.pack("<" + long, beyond + sum(map(len, tail)))
            tail.append(value)
        else:
            here = value.ljust(small, b"\0")
        out.append(struct.pack("<HH" + long, tag, kind_of, count) + here)
    return b"".join([*out, bytes(small), *tail])


def rows_of(scene: str, cube: np.ndarray, band: int, y: int, x: int) -> list[pa.RecordBatch]:
    """scene, band (from 1), y, x, value of a block, a batch for each band; what is not finite is null."""
    height, width = cube.shape[1:]
    row, column = (a.astype(np.int32) for a in np.divmod(np.arange(height * width), max(1, width)))
    out = []
    for k, own in enumerate(cube):
        values = own.ravel().astype(float)
        n = len(values)
        columns = [pa.repeat(pa.scalar(scene), n), pa.repeat(pa.scalar(band + k + 1, pa.int32()), n), pa.array(row + np.int32(y)), pa.array(column + np.int32(x)), pa.array(values, mask=~np.isfinite(values))]
        out.append(pa.RecordBatch.from_arrays(columns, names=["scene", "band", "y", "x", "value"]))
    return out
