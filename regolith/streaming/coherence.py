"""An extension for streams: pair-wise mean coherence as pairs arrive, and the decay fit brought up to date after each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regolith.operators.deformation import decay


def pair_means(observations: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """window, pair_id, baseline and mean coherence of a stream of observations (arrived, pair_id, baseline, coherence); what
    comes later than the delay is dropped, so state stays bounded."""
    marked = observations.withWatermark("arrived", delay)
    return marked.groupBy(F.window("arrived", window), "pair_id", "baseline").agg(F.avg("coherence").alias("coherence"))


def fit_stream(observations: DataFrame, pairs_path: str, fit_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the finished pair means to a table, and after each batch writes the decay fit over all of them."""

    def after(batch: DataFrame, number: int) -> None:
        # Each batch has its own folder, so a batch that runs again replaces its rows.
        batch.select("pair_id", "baseline", "coherence").write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")
        pairs = batch.sparkSession.read.parquet(pairs_path)
        decay(pairs).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(fit_path)

    return pair_means(observations).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(after).start()
