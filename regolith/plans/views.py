"""The driver's tables seen as rasters, spectra, radar pairs, knowledge base and runs; the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
#: Rows, about, of a task that joins observations to their pairs.
TASK_ROWS = 1 << 20
#: Wavelengths of the 64 values of an embedding, in micrometres.
WAVELENGTHS = [0.42 + 0.0325 * i for i in range(64)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one scene of 100 columns with four bands."""
    e = read(spark, sf_dir, "events")
    at = F.col("event_id")
    return e.select(
        F.lit("s").alias("scene"), F.floor(at / WIDTH).cast("long").alias("y"), (at % WIDTH).cast("long").alias("x"), "event_type",
        F.col("value").alias("B1"), (F.hour("ts") + 1).cast("double").alias("B2"), (F.col("user_id") + 1).cast("double").alias("B3"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("B4"),
    )


RASTER = f"""px AS (
  SELECT event_id // {WIDTH} AS y, event_id % {WIDTH} AS x, event_type, value AS B1, (hour(ts) + 1)::DOUBLE AS B2, (user_id + 1)::DOUBLE AS B3,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS B4
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels with four bands."""
    names = {"l_quantity": "B1", "l_extendedprice": "B2", "l_discount": "B3", "l_tax": "B4"}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *[F.col(a).alias(b) for a, b in names.items()])


SAMPLES = "px AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity AS B1, l_extendedprice AS B2, l_discount AS B3, l_tax AS B4 FROM lineitem)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as spectra of 64 reflectances."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double") + 0.5).alias("spectrum"))


SPECTRA = "cube AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE + 0.5) AS s FROM embeddings)"


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as observations of pixels in radar pairs."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = -(-lines.count() // TASK_ROWS)
    if parts > spark.sparkContext.defaultParallelism:
        # So many tasks, each with as much to sort and to sum whatever the tables' size; below that the planner's own number has no more.
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 20).alias("x"), F.col("l_orderkey").alias("pair"), F.to_date("o_orderdate").alias("ref_date"),
        F.to_date("l_shipdate").alias("sec_date"), (F.col("l_extendedprice") / 1000).alias("disp"), (1 - F.col("l_discount") * 8).alias("coherence"),
    )


RADAR = """obs AS (
  SELECT l_suppkey AS y, l_partkey % 20 AS x, l_orderkey AS pair, o_orderdate::DATE AS ref_date, l_shipdate::DATE AS sec_date, l_extendedprice / 1000 AS disp,
         1 - l_discount * 8 AS coherence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def alterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the knowledge base's alterations: brand as deposit type, type as mineral."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size")

    def formula(a: int, b: int):
        return F.concat(F.lit("B"), (size % a + 1).cast("string"), F.lit("/ B"), (size % b + 1).cast("string"), F.lit("（low）"))

    ratios = F.map_filter(
        F.map_from_arrays(
            F.array(F.lit("ASTER"), F.lit("Landsat8"), F.lit("Sentinel2")),
            F.array(F.when(size % 2 == 0, formula(9, 7)), F.when(size % 3 == 0, formula(7, 5)), F.when(size % 5 == 0, F.lit("R(2.10)/R(2.20)"))),
        ),
        lambda k, v: v.isNotNull(),
    )
    bands = F.array(*[F.lit(b) for b in ("B1", "B4", "B6", "B7")])
    landsat = F.array(*[F.lit(b) for b in ("B2", "B5", "B6", "B7")])
    return p.select(
        F.col("p_partkey").alias("pos"), F.col("p_brand").alias("deposit"), F.col("p_type").alias("mineral"), F.when(size % 4 > 0, (size % 4).cast("int")).alias("priority"),
        ratios.alias("sensor_ratio"), F.when(size % 4 == 0, "ASTER").when(size % 7 == 0, "Sentinel2").alias("pca_sensor"), F.when((size % 4 == 0) | (size % 7 == 0), bands).alias("input_bands"),
        F.when(size % 8 == 0, landsat).alias("landsat_bands"), (size % 16 != 0).alias("has_criterion"),
        F.when(size % 6 == 1, F.struct(F.lit(2.2).alias("feature_um"), F.array(F.lit(2.1), F.lit(2.3)).alias("shoulder_um"), F.lit(1).alias("sign"))).alias("enmap_feature"),
    )


ALTERATIONS = """alt AS (
  SELECT p_partkey AS pos, p_brand AS deposit, p_type AS mineral, coalesce(nullif(p_size % 4, 0), 2)::INT AS priority,
         CASE WHEN p_size % 2 = 0 THEN 'B' || (p_size % 9 + 1) || '/B' || (p_size % 7 + 1) END AS aster_ratio,
         CASE WHEN p_size % 3 = 0 THEN 'B' || (p_size % 7 + 1) || '/B' || (p_size % 5 + 1) END AS landsat_ratio,
         CASE WHEN p_size % 4 = 0 THEN 'ASTER' WHEN p_size % 7 = 0 THEN 'Sentinel2' END AS pca_sensor,
         p_size % 16 <> 0 AND (p_size % 4 = 0 OR p_size % 7 = 0) AS aster_pca,
         p_size % 16 <> 0 AND p_size % 8 = 0 AS landsat_pca,
         p_size % 16 <> 0 AND p_size % 4 <> 0 AND p_size % 7 = 0 AS sentinel_pca, p_size % 6 = 1 AS depth
  FROM part)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("deposit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), "o_totalprice"
    )


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS project, o_orderpriority AS deposit, strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_totalprice FROM orders)"
