"""The store of past runs: partitioned tables, latest run, retention, listing."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITIONS = ("project", "deposit")
SCHEMA_VERSION = 1


def confined(root: str, relative: str) -> str | None:
    """The path of something in the store by its relative name; None if that leads out of the store's folder."""
    top = posixpath.normpath(root)
    path = posixpath.normpath(posixpath.join(top, relative))
    return path if path == top or path.startswith(top + "/") else None


def affine_list(transform: Column) -> Column:
    """The first six numbers of an affine transform (array) as doubles; null for fewer or unknown ones."""
    own = F.transform(F.slice(transform, 1, 6), lambda v: v.cast("double"))
    return F.when((F.size(own) == 6) & F.forall(own, lambda v: v.isNotNull()), own)


def structural_block(structural: Column) -> Column:
    """A run's structural entries (map of texts) without the embedded rose diagram, but with whether there is one."""
    bare = F.map_filter(structural, lambda k, v: k != "rose_diagram")
    there = F.coalesce(F.try_element_at(structural, F.lit("rose_diagram")), F.lit("")) != ""
    return F.when(structural.isNotNull(), F.map_concat(bare, F.create_map(F.lit("rose_diagram_present"), there.cast("string"))))


def manifests(runs: DataFrame, results: DataFrame, composites: DataFrame) -> DataFrame:
    """A row for each run with all that was found: runs (run_id, created_at, project, deposit and more) with results (array of the
    rows of `results`, which has run_id, sensor, mineral, method, ...), composites (the same of `composites`: run_id, sensor, ...),
    n_results, high_pixels (of all composites) and schema_version. A run without results has empty lists."""

    def lists(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
        own = [c for c in rows.columns if c != "run_id"]
        return rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in own if c not in order]))).alias(name))

    found, wholes = lists(results, "results", ["sensor", "mineral", "method"]), lists(composites, "composites", ["sensor"])
    high = composites.groupBy("run_id").agg(F.sum("high_pixels").alias("high_pixels"))
    met = runs.join(found, "run_id", "left").join(wholes, "run_id", "left").join(high, "run_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(met.schema[c].dataType)) for c in ("results", "composites")}
    met = met.withColumns(empty)
    return met.withColumns({"n_results": F.size("results").cast("long"), "high_pixels": F.coalesce("high_pixels", F.lit(0)), "schema_version": F.lit(SCHEMA_VERSION)})


def save(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def load(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs if run_id is None else runs.where(F.col("run_id") == run_id)


def save_layers(layers: DataFrame, path: str) -> None:
    """Layers (run_id, sensor, mineral, method, y, x, index_value, is_anomaly) in folders by run, sensor, mineral and method."""
    layers.write.mode("append").partitionBy("run_id", "sensor", "mineral", "method").parquet(path)


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each project and deposit type."""
    return runs.groupBy(*PARTITIONS).agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at"))


def surplus(runs: DataFrame, keep: int) -> DataFrame:
    """The runs that retention drops: all but the newest `keep` of each project and deposit type; none if keep is not over 0."""
    w = Window.partitionBy(*PARTITIONS).orderBy(F.desc("created_at"), F.desc("run_id"))
    ranked = runs.withColumn("_k", F.row_number().over(w))
    return (ranked.where(F.col("_k") > keep) if keep > 0 else ranked.limit(0)).drop("_k")


def summaries(runs: DataFrame, project: str | None = None) -> DataFrame:
    """Runs of a project, or all, the newest first; unknown times last. Of manifests() the summary's columns alone."""
    own = runs if project is None else runs.where(F.col("project") == project)
    brief = ["run_id", "project", "deposit", "created_at", "n_results", "usable_sensors", "high_pixels"]
    if "n_results" in runs.columns:
        own = own.select(*[c for c in brief if c in runs.columns])
    return own.orderBy(F.desc_nulls_last("created_at"), "run_id")
