"""Quality of documents from their own evidence and from the posteriors of their host and path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.llm import statistics
from regolith.llm.common import Workspace, hot_keys, join_unique, slices
from regolith.llm.linear import logistic
from regolith.llm.quality_rules import labelled_features

#: The verdict's least probability of good quality.
LEAST = 0.5
#: Bounds of a prior's strength, in documents.
STRENGTH = (2.0, 1e6)


@dataclass
class Evidence:
    """A logistic document classifier on standardised features and their squares."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -6, 6)
        return np.hstack([z, z * z, np.ones((len(z), 1))]) @ self.weights


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **columns: str) -> Evidence:
    """The document classifier, fitted on a bounded sample of the labelled documents."""
    x, y = labelled_features(docs, labels, label_col, **columns)
    if not len(x):
        width = len(statistics.FEATURES)
        return Evidence(np.zeros(width), np.ones(width), np.zeros(2 * width + 1))
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - middle) / spread, -6, 6)
    return Evidence(middle, spread, logistic(np.hstack([z, z * z]), y, ridge=1e-4))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first directory of the path of a URL; null where there is none."""
    path = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^(/[^/]+)/", 1)
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.nullif(path, F.lit(""))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(between: float, within: float, mean: float) -> float:
    """The strength of a beta prior by moments: the groups' variance beyond what their own sizes explain."""
    spread = max(between - within, 1e-9)
    return float(np.clip(mean * (1 - mean) / spread - 1, *STRENGTH))


def posteriors(scored: DataFrame, work: Workspace, host: str = "host", path: str = "path", p: str = "p") -> tuple[DataFrame, float, float, float]:
    """Sums by path and by its host, from grouped aggregates alone: columns host, path, n, total, host_n, host_total; then the
    global mean and the strengths of the host's and the path's prior."""
    paths = work.staged(scored.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.sum(F.col(p) * (1 - F.col(p))).alias("noise")), "paths")
    hosts = work.staged(paths.groupBy(host).agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"), F.sum("noise").alias("host_noise"), F.count("*").alias("paths")), "hosts")
    # A host with very many paths meets its sums by broadcast.
    both = work.staged(join_unique(paths, hosts, [host], hot_keys(hosts, [host], "paths")).drop("paths"), "sites")
    one = hosts.agg(F.sum("host_total").alias("total"), F.sum("host_n").alias("n")).first()
    if not one.n:
        return both, 0.5, 1.0, 1.0
    mean = float(np.clip(one.total / one.n, 1e-6, 1 - 1e-6))
    rate, own = F.col("host_total") / F.col("host_n"), F.col("total") / F.col("n")
    h = hosts.agg(F.avg((rate - mean) ** 2).alias("between"), F.avg(F.col("host_noise") / F.col("host_n") / F.col("host_n")).alias("within")).first()
    q = both.agg(F.avg((own - rate) ** 2).alias("between"), F.avg(F.col("noise") / F.col("n") / F.col("n")).alias("within")).first()
    return both, mean, _strength(h.between, h.within, mean), _strength(q.between, q.within, mean)


def classify(docs: DataFrame, evidence: Evidence, host: Column, path: Column, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """Quality by hierarchical empirical Bayes: id_col, host, path, evidence (the document classifier's probability),
    path_posterior, quality (double, 0 to 1) and kept (quality at least `least`).

    A host's rate of good documents is shrunk toward the global mean, a path's toward its host's, by priors whose strengths come
    from the spread between hosts and between paths; a document's own share is taken out of both. The document's evidence and
    the path's posterior odds against the global ones add up. So a sparse site changes little, and a site of junk a lot.

    A row for each row of docs. Null hosts or paths are a site like any other; null and empty texts are judged by their
    statistics, which are zeros; null ids stay null; other columns do not pass. Hosts of any size: sums are combined before the
    shuffle, and the rows of large sites meet them by broadcast. A text is held whole in its task, with about 20 times its bytes
    beside it. The result reads tables in `workspace` (a folder of its own by default).
    """
    work = workspace or Workspace(docs.sparkSession, "quality")
    sent = docs.sparkSession.sparkContext.broadcast(evidence)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics.features(statistics.count(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sent.value.logits(x))], names=["id", "host", "path", "logit"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    scored = work.staged(texts.mapInArrow(run, f"id {kind}, host string, path string, logit double").withColumn("p", 1 / (1 + F.exp(-F.col("logit")))), "evidence")
    sites, mean, host_strength, path_strength = posteriors(scored, work)
    met = join_unique(scored, sites, ["host", "path"], work.staged(hot_keys(sites, ["host", "path"]), "hot-sites"))
    host_rate = (F.lit(host_strength * mean) + F.col("host_total") - F.col("p")) / (host_strength + F.col("host_n") - 1)
    path_rate = (path_strength * host_rate + F.col("total") - F.col("p")) / (path_strength + F.col("n") - 1)
    judged = met.withColumn("path_posterior", path_rate).withColumn("quality", 1 / (1 + F.exp(-(F.col("logit") + _logit(F.col("path_posterior")) - _logit(F.lit(mean))))))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("p").alias("evidence"), "path_posterior", "quality", (F.col("quality") >= least).alias("kept"))
