"""Quality rules: fixed limits on document statistics, and boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm import boosting, statistics
from regolith.llm.common import slices

#: Labelled documents that a classifier is fitted on, on average at most.
SAMPLE = 4000
#: The verdict's least probability of good quality.
LEAST = 0.5
#: Features of which more never makes a document better.
WORSE = ("symbols", "dup_lines", "repeats", "loud")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def labelled_features(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about `sample` labelled documents, chosen by a hash of their id; only these numbers come to the
    driver. Null labels and labels without a document are left out; of differing labels of one id the largest counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(max(n, sample))) < sample)  # about `sample` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics.features(statistics.count(batch.column(2))).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, x binary").toArrow().sort_by("id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f8").reshape(got.num_rows, len(statistics.FEATURES))
    return x, np.array(got.column("label").to_pylist(), float)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **columns: str) -> boosting.Forest:
    """Boosted trees for good quality on a bounded sample of the labelled documents."""
    x, y = labelled_features(docs, labels, label_col, **columns)
    return boosting.fit(x, y, {statistics.FEATURES.index(name): -1 for name in WORSE})


def judge(docs: DataFrame, forest: boosting.Forest, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long, see
    statistics.count), base_failed, kept and quality (double, the trees' probability).

    base_failed: fewer than 20 words, or over 30 % of the words in windows of 8 words found twice or more. kept: false if
    base_failed, else whether quality is at least `least`. A null or empty text has zeros and fails. A row for each row of docs;
    null ids stay null; without labels the trees give 0.5, which keeps; other columns do not pass.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = statistics.count(batch.column(1))
            score = sent.value.score(statistics.features(counts))
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            columns = [batch.column(0), *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *_COUNTS, "base_failed", "kept", "quality"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, quality double"
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
