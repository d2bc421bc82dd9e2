"""Every stage against a plain version on its own input, and the whole run."""

import hashlib
import re
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from regolith.llm import bpe
from tests.llm.test_lines import brute as plain_lines
from tests.llm.test_near_dedup import brute as plain_groups

PATH = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(PATH + "/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = [(9001, None, "en", "s", None), (9002, "", "en", None, 0), (9003, "123 !", None, "s", 5), (9004, "the house of the thing", None, None, 22), (None, "the one without an id", "en", "s", 21)]
    return own.unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_languages(spark, docs):
    before, after = rows(docs), rows(corpus_pipeline.languages(spark, docs, PATH))
    assert set(after) == {i for i, r in before.items() if r.text and any(map(str.isalpha, r.text))}
    assert after[9004].lang is not None
    assert all(tuple(after[i]) == tuple(before[i]) for i in after if before[i].lang is not None)


def test_lines(spark, docs):
    before, after = rows(docs), rows(corpus_pipeline.lines(spark, docs, PATH))
    plain = {i: (text, dropped) for i, _, dropped, text in plain_lines([(r.doc_id, r.text) for r in before.values()])}
    assert set(after) == set(before)
    for i, r in after.items():
        assert (r.text or "") == plain[i][0] and r.n_chars == (len(r.text) if plain[i][1] else before[i].n_chars)


def test_near_duplicates(spark, docs):
    again = docs.unionByName(docs.where("doc_id = 5"))
    after = corpus_pipeline.near_duplicates(spark, again, PATH).collect()
    expected = [i for i, _, c in plain_groups([(r.doc_id, r.text) for r in docs.collect()], 5) if i is None or i == c]
    assert sorted((r.doc_id for r in after), key=str) == sorted(expected, key=str)


def test_benchmark_leaks(spark, docs):
    words = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    items = [w for r in spark.read.parquet(PATH + "/benchmark.parquet").collect() if (w := words(r.text))]
    before, after = rows(docs), rows(corpus_pipeline.benchmark_leaks(spark, docs, PATH))
    leaked = {i for i, r in before.items() if any(f" {w} " in f" {words(r.text)} " for w in items)}
    assert leaked and not leaked & set(after) and len(before) - len(after) < len(leaked) + 4


def test_tokens_and_the_whole_run(spark, docs):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    for r in corpus_pipeline.tokens(spark, docs.limit(40), PATH).collect():
        text = rows(docs)[r.doc_id].text or ""
        ids = public.encode_ordinary(text)
        assert (r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    step = spark.read.parquet(PATH + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, PATH)
    whole = corpus_pipeline.run(spark, PATH)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {r.doc_id: r.ids for r in whole.collect()} == {r.doc_id: r.ids for r in step.collect()}


def test_empty_table(spark):
    step = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, PATH)
    assert step.count() == 0


def test_a_run_keeps_the_last_stage_alone(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    assert corpus_pipeline.run(spark, PATH).count() > 0
    (own,) = set(shared.iterdir()) - before
    assert own.name.startswith("pipeline-") and [p.name.partition("-")[0] for p in own.iterdir()] == ["decontamination"]


def test_repeated_ids_keep_one_row_by_a_rule(spark):
    rows = [(1, "first text with some words in it here", "en", "a", 1), (1, "second text with other words in it there", "en", "b", 2), (2, "third", "en", "c", 3)]
    kept = [sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(own, SCHEMA), PATH).collect()) for own in (rows, rows[::-1])]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == [1, 2]
