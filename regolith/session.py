"""Sessions, and where checkpoints go."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "regolith", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with what the queries count on: adaptive plans and UTC. The master and memory are the caller's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share. Where that is unset, a local session has one
    in its warehouse, and any other is told to name one."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, its lineage cut at a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and reread: for rows that several scans take, whose columns cost more than reading."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its executors once, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "regolith.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, file.relative_to(home.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark
