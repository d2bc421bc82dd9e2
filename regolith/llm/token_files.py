"""Token ids in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.llm.bpe import Remembered
from regolith.llm.common import Workspace, slices
from regolith.llm.textscan import ragged

MAGIC = b"PFORIDS1"
BLOCK = 4096
#: Of a block's values, the share that fits the packed width; the others are exceptions.
PERCENTILE = 98
#: A partition's file is closed at so many ids, which bounds what a reader holds.
FILE_IDS = 4 << 20
_HEAD = struct.Struct("<IIHBx")  # least value, exceptions, values, width
_TAIL = struct.Struct("<QQQ8s")  # blocks, documents, place of the index, magic


def pack_block(ids: np.ndarray) -> bytes:
    """Least value, packed differences at the percentile's width, and the exceptions' places and differences."""
    least = int(ids.min())
    rest = (ids - least).astype("<u4")
    width = int(np.percentile(rest, PERCENTILE, method="higher")).bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(least, len(out), len(ids), width) + packed + out.astype("<u2").tobytes() + rest[out].tobytes()


def unpack_block(data: bytes, at: int) -> np.ndarray:
    """The ids of the block at this place."""
    least, odd, n, width = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    values = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    values[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return values + np.uint32(least)


def write_file(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """A file: blocks of BLOCK ids, then the index: where each block starts, and the id (with a flag for null) and number of
    ids of each document."""
    blocks, starts, at = [MAGIC], [], len(MAGIC)
    for k in range(0, len(ids), BLOCK):
        starts.append(at)
        blocks.append(pack_block(ids[k : k + BLOCK]))
        at += len(blocks[-1])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    index = np.array(starts, "<u8").tobytes() + known.tobytes() + numbers.tobytes() + np.asarray(counts, "<u8").tobytes()
    return b"".join([*blocks, index, _TAIL.pack(len(starts), len(doc_ids), at, MAGIC)])


def read_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where blocks start; of each document whether its id is known, the id, and its number of ids."""
    blocks, docs, at, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    places = [at, at + 8 * blocks, at + 8 * blocks + docs, at + 8 * blocks + 9 * docs]
    return (
        np.frombuffer(data, "<u8", blocks, places[0]),
        np.frombuffer(data, np.uint8, docs, places[1]).astype(bool),
        np.frombuffer(data, "<i8", docs, places[2]),
        np.frombuffer(data, "<u8", docs, places[3]).astype(np.int64),
    )


@functools.cache
def _byte_letters() -> dict[int, str]:
    """Fixed by byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


@functools.cache
def _library(definition: str, special: bool) -> tuple[object, Remembered | None, tuple[str, ...]]:
    """The library's tokenizer; for a plain byte-level one also an encoder that gives it each distinct pretoken once, for texts
    that hold none of the strings that come last."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = not special
    parsed = json.loads(definition)
    added = tuple(t["content"] for t in parsed.get("added_tokens") or [] if special or not t["special"])
    split = parsed["pre_tokenizer"] or {}
    if parsed["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return tokenizer, None, added
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()

    def fresh(data, starts, lengths, hashes):
        text = data[ragged(starts, lengths)].tobytes().decode("latin-1").translate(letters)
        found = [[t.id for t in tokenize(text[end - n : end])] for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]
        return np.array([x for ids in found for x in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    return tokenizer, Remembered(fresh), added


def encode_texts(definition: str, texts: pa.Array, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with no special tokens put around them, and where those of each text start (with the total last).
    special: as in write()."""
    tokenizer, remembered, added = _library(definition, special)

    def whole(some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in some.to_pylist()], add_special_tokens=False)]
        return np.array([x for own in ids for x in own], np.int32), np.array([len(own) for own in ids], np.int64)

    if remembered is None:
        ids, counts = whole(texts)
        return ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    holds = np.zeros(len(texts), bool)
    for content in added:
        holds |= pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)
    if not holds.any():
        return remembered.encode(texts)
    # The library splits a text at its added tokens first: texts that hold one go through it whole.
    ids, offsets = remembered.encode(pc.if_else(pa.array(holds), pa.scalar(None, texts.type), texts))
    own, counts = whole(texts.filter(pa.array(holds)))
    more = np.zeros(len(texts) + 1, np.int64)
    more[1:][holds] = counts
    return np.insert(ids, np.repeat(offsets[:-1][holds], counts), own), offsets + np.cumsum(more)


def _opened(folder: str):
    """The store and the path in it of a folder, which is made if need be."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    store.create_dir(top, recursive=True)
    return store, top


def write(docs: DataFrame, definition: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", special: bool = False, workspace: Workspace | None = None) -> tuple[str, DataFrame]:
    """Encodes every whole text with the tokenizers library, appends end_id, and writes the ids in ascending order of id.

    The texts are range-partitioned by id and sorted; each task writes its files (ids-<partition>-<number>.pfor) under `path`,
    a new folder in the workspace's if None. A file is complete before it gets its name, so a task may run again.

    Returns the folder, and the files as a table: file (string), start (long: ids in the files before it), docs, ids (long).
    Null ids come first; null and empty texts have end_id alone; rows of one id are in the order of a hash of their texts, so that a
    task that runs again writes the same file; extra columns are not written; an empty table has no files. A text is held whole in
    its task, with about 20 times its bytes beside it. definition: the tokenizer's JSON, a fixed vocabulary of a few MB. special: whether the strings of its
    special tokens have their ids where they stand in a text, as in the library unless it is told otherwise, or are plain text.
    """
    spark = docs.sparkSession
    work = workspace or Workspace(spark, "token-files")
    folder = path or f"{work.path}/ids"
    sent = spark.sparkContext.broadcast(definition)

    _opened(folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{number:06d}.pfor"
            joined = np.concatenate(ids)
            data = write_file(joined, names, np.concatenate(counts))
            own = f"{top}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "docs": [len(names)], "ids": [len(joined)]})

        for batch in slices(batches, "text"):
            own, offsets = encode_texts(sent.value, batch.column(1), special)
            own = np.insert(own, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            ids.append(own.astype(np.uint32))
            names += batch.column(0).to_pylist()
            counts.append(np.diff(offsets))
            held += len(own)
            if held >= FILE_IDS:
                yield close()
                ids, names, counts, held, number = [], [], [], 0, number + 1
        if names:
            yield close()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"))
    ordered = texts.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").drop("hash")
    files = work.staged(ordered.mapInArrow(run, "file string, docs long, ids long"), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file of FILE_IDS ids
    return folder, files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "docs", "ids")


def read_files(spark: SparkSession, folder: str, files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents in the files: id_col, start (ids before it in all files), n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), with with_ids also ids (array<long>)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer().to_pybytes()
                starts, known, numbers, counts = read_index(data)
                ids = np.concatenate([unpack_block(data, int(at)) for at in starts] or [np.zeros(0, "<u4")]).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array([name.rpartition("/")[2]] * len(counts)), pa.array(numbers, mask=~known), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "file string, id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.pfor").load(folder).select("path", "content").mapInArrow(run, schema)
    joined = found.join(files.select("file", F.col("start").alias("before")), "file")
    return joined.select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
