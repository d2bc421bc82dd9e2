"""Line deduplication: lines that many documents hold stay in one of them."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import Workspace, slices

#: Fixed: what is stripped from a line's ends, U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"


def _identity(text: Column) -> Column:
    """Rows with one id but different texts are told apart by this."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """A row (h1, h2, doc, row, pos) for each line whose key has least_chars code points; the key's hash has 128 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for place, line in enumerate((text or "").split("\n")):
                    key = line.strip(BLANK)
                    if len(key) >= least_chars:
                        digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                        rows.append(row)
                        places.append(place)
            hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            from_rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), batch.column(0).take(from_rows), batch.column(1).take(from_rows), pa.array(places, pa.int32())],
                names=["h1", "h2", "doc", "row", "pos"],
            )

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), _identity(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"h1 long, h2 long, doc {kind}, row long, pos int")


class _Run:
    """What is known of the run of one hash while its rows stream by, from the largest document down."""

    def __init__(self, first: bool):
        self.first, self.docs, self.last, self.top, self.held = first, 0, None, None, []


def _stream(batches: Iterable[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Decides on the sorted rows of one range partition.

    kind D: the line goes. Runs at the partition's ends may go on in another partition: kind S tells how many documents and
    which largest one this part of the run has, and kind U holds the lines on which that bears, those of fewer than least_docs
    documents or of the largest one. Nothing else is held, however long a run is.
    """
    run: _Run | None = None
    key = None

    def table(kind: str, rows: pa.RecordBatch, docs: int | None = None) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *rows.columns, pa.array([docs] * n, pa.int64())], names=["kind", *rows.schema.names, "docs"])

    def closed(run: _Run, last: bool) -> Iterator[pa.RecordBatch]:
        if not (run.first or last):
            return
        yield table("S", run.top, run.docs)
        for rows in run.held:
            yield table("U", rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        docs = batch.column(2).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        new_doc = np.ones(len(h1), bool)
        new_doc[1:] = docs[1:] != docs[:-1]
        bounds = [0, *cut.tolist(), len(h1)]
        going: list[pa.RecordBatch] = []
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            here = int(h1[start]), int(h2[start])
            if here != key:
                if run is not None:
                    going += closed(run, False)
                run, key = _Run(run is None), here
                run.top = batch.slice(start, 1)
            else:
                new_doc[start] = docs[start] != run.last
            over = run.docs >= least_docs
            if run.last is None:
                new_doc[start] = True
            run.docs += int(np.count_nonzero(new_doc[start:stop]))
            run.last = docs[stop - 1]
            rows = batch.slice(start, stop - start)
            if run.docs < least_docs:
                run.held.append(rows)
                continue
            top = run.top.column(2)[0].as_py()
            if not over:
                for held in [*run.held, rows]:
                    below = held.filter(pa.array(held.column(2).to_numpy(zero_copy_only=False) != top))
                    going.append(table("D", below))
                run.held = [h for held in [*run.held, rows] if (h := held.filter(pa.array(held.column(2).to_numpy(zero_copy_only=False) == top))).num_rows]
            else:
                going.append(table("D", rows))
        going = [g for g in going if g.num_rows]
        if going:
            yield pa.Table.from_batches(going).combine_chunks().to_batches()[0]
    if run is not None:
        yield from closed(run, True)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, workspace: Workspace | None = None) -> DataFrame:
    """A bitmap for each document that loses lines.

    A text's lines are what newlines part. A line's key is the line without blanks at its ends, A-Z in lower case. Keys of
    least_chars code points in at least least_docs documents lose all their lines but those in the largest id that holds it.

    The lines' hashes are range-partitioned together with the document, so that the lines of one key can span partitions, and
    sorted by document within; each partition streams by. What spans partitions is settled from two rows for each partition.

    Returns id_col, row (the hash of the text, which tells rows of one id apart) and keep (binary: zlib of bits by line, least
    bit first; lines behind its end stay). Rows of one id count as one document. Null ids neither count nor lose lines; null
    and empty texts have one empty line; ties cannot be, as ids differ; other columns do not pass. A text is held whole in its
    task, with a few times its bytes beside it. The result reads a table in `workspace` (a folder of its own by default).
    """
    work = workspace or Workspace(docs.sparkSession, "line-dedup")
    lines = work.staged(_long_lines(docs, id_col, text_col, least_chars), "lines")
    order = ["h1", "h2", F.desc("doc")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "pos")
    kind = docs.schema[id_col].dataType.simpleString()
    found = work.staged(ranged.mapInArrow(lambda batches: _stream(batches, least_docs), f"kind string, h1 long, h2 long, doc {kind}, row long, pos int, docs long"), "line-drops")
    work.remove("lines")
    ends = found.where("kind = 'S'").groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("doc").alias("top"))
    late = found.where("kind = 'U'").join(F.broadcast(ends), ["h1", "h2"]).where((F.col("total") >= least_docs) & (F.col("doc") < F.col("top")))
    drops = found.where("kind = 'D'").select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))

    @F.arrow_udf("binary")
    def bitmap(places: pa.Array) -> pa.Array:
        out = []
        for drop in places.to_pylist():
            bits = np.ones((max(drop) | 7) + 1, np.uint8)
            bits[drop] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        return pa.array(out, pa.binary())

    return drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("drop")).select(F.col("doc").alias(id_col), "row", bitmap("drop").alias("keep"))


def kept_bits(keep: bytes | None, n: int) -> np.ndarray:
    """Of n lines, which stay."""
    bits = np.ones(n, bool)
    if keep is not None:
        own = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
        bits[: len(own)] = own[:n]
    return bits


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that their bitmaps drop: text_col changes, n_lines and n_dropped (long) come; other columns pass.
    A null text stays null and counts one line. Columns of docs named like the new ones are replaced; other names are free."""
    taken = {c.lower() for c in docs.columns}
    own_id, own_row, own_keep, own_cut = (next(n for k in itertools.count() if (n := f"_{name}{k}") not in taken) for name in ("id", "row", "keep", "cut"))
    at = docs.drop("n_lines", "n_dropped").withColumns({own_row: _identity(F.col(text_col)), own_id: F.col(id_col)})
    marks = bitmaps.select(F.col(id_col).alias(own_id), F.col("row").alias(own_row), F.col("keep").alias(own_keep))

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        out, counts, gone = [], [], []
        for text, keep in zip(texts.to_pylist(), keeps.to_pylist(), strict=True):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if keep is None:
                out.append(text)
                gone.append(0)
            else:
                bits = kept_bits(keep, len(lines))
                out.append("\n".join(line for line, stays in zip(lines, bits.tolist(), strict=True) if stays))
                gone.append(len(lines) - int(bits.sum()))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_lines", "n_dropped"])

    joined = at.join(marks, [own_id, own_row], "left").withColumn(own_cut, cut(F.col(text_col), F.col(own_keep)))
    names = [F.col(f"{own_cut}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*names, F.col(f"{own_cut}.n_lines").alias("n_lines"), F.col(f"{own_cut}.n_dropped").alias("n_dropped"))
