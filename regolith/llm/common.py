"""What the corpus operators share: staging of tables, hot keys, and slicing of Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that an Arrow function works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: A key with more rows than this share of the table is joined by broadcast, so at most HOT_KEYS keys are.
HOT_KEYS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session has one in its warehouse, and
    any other is told to name one."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


class Workspace:
    """The tables that one run writes, in a folder of its own in the shared one. What it needs no more it removes itself; the rest
    its result reads, until the caller removes it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, list[str]] = {}

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet and reread: its lineage ends there, and losing an executor loses none of it."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.tables.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str, but: int = 0) -> None:
        """Removes the tables of these names, but for the last few; without names the whole folder."""
        gone = [self.path] if not names else []
        for name in names:
            own = self.tables.get(name, [])
            gone += own[: len(own) - but]
            self.tables[name] = own[len(own) - but :]
        for path in gone:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", least: int = 5000) -> DataFrame:
    """The keys of a counted table with more than `least` rows and more than total / HOT_KEYS; so there are at most HOT_KEYS."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(least, total / HOT_KEYS)).select(*keys)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key. Rows of hot keys (at most HOT_KEYS, see hot_keys) meet their
    row of right by broadcast, so that no task gets all rows of one key; the others meet by a shuffle."""
    flag = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    marked = left.join(flag, keys, "left")
    own = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    some = marked.where(F.col("_hot")).drop("_hot").join(own, keys, how)
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
    return some.unionByName(rest)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        places = offsets_of(column)
        ends = places[1:] - places[0]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array):
    """Byte offsets of each text in the column's buffer, as int64."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffer = column.buffers()[1]
    if buffer is None or buffer.size == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
