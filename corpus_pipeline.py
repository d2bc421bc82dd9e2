"""The corpus pipeline: from raw documents to token ids, in stages that each take all that the stage before kept.

Every stage but the last returns the columns of `documents` (doc_id, text, lang, source, n_chars). Rows with a null id pass
through the stages that compare documents by id; null and empty texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from regolith.llm.common import Workspace, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Documents whose language cannot be told (no text or no letter in it) go; where `lang` is null the prediction fills it."""
    model = language_id.train(docs, ~language_id.held_out())
    known = docs.select(*COLUMNS)
    # Predictions come with the document's row: its other columns travel as the id, and its text beside them only once.
    rows = known.select(F.struct(*[c for c in COLUMNS if c != "text"]).alias("row"), "text")
    found = language_id.identify(rows, model, id_col="row", with_text=True).where(F.col("lang_pred") != language_id.UNKNOWN)
    own = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred")}
    return found.select(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Long lines that five documents or more hold stay in the one with the largest id; n_chars follows the text."""
    found = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, workspace=work))
    return found.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Of each group of documents with similar five-word shingles the one with the smallest id stays, in one row: of rows that repeat
    its id the one whose text has the smallest hash, then the smallest of the row."""
    kept = near_dedup.near_duplicates(docs, workspace=work).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rest = F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")])
    found = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64("text"), rest)).alias("row"))
    return found.select("row.*").unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Documents that hold a benchmark item, as it is or edited, go."""
    leaks = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Byte-level BPE ids of every document, with digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bpe.encode(docs, ranks, decoded=True, digest=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]
#: SVM verdicts, components, alignments and a tokenizer's ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Each stage's result is written; then its own tables and its input go, so one result stays at the end."""
    docs, results, before = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        work = Workspace(spark, f"pipeline-{name}")
        docs = results.staged(stage(spark, docs, sf_dir, work), name)
        work.remove()
        if before:
            results.remove(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
