"""Near-duplicates against all pairs, on made-up groups and on the test tables."""

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from regolith.llm import near_dedup, queries
from regolith.llm.common import Workspace, shared_dir


def brute(rows, words, percent=80):
    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(zip(*(own[k:] for k in range(words)), strict=False)) if len(own) >= words else frozenset([tuple(own)] if own else [])

    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    distinct = {}
    for i, s in sets:
        if i is not None and s:
            distinct.setdefault(s, []).append(i)
    for ids in distinct.values():
        for i in ids:
            a, b = sorted((find(i), find(ids[0])))
            top[b] = a
    by = {}
    for s, ids in distinct.items():
        for x in s:
            by.setdefault(x, []).append((s, ids[0]))
    for s, ids in distinct.items():
        near = {}
        for x in s:
            for other, j in by[x]:
                near[j] = (other, near.get(j, (other, 0))[1] + 1)
        for j, (other, shared) in near.items():
            if 100 * shared >= percent * (len(s) + len(other) - shared):
                a, b = sorted((find(ids[0]), find(j)))
                top[b] = a
    return sorted(((i, len(s), i if i is None else find(i)) for i, s in sets), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(docs, words):
    rows = near_dedup.near_duplicates(docs, words).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def made_up(n_groups=25, seed=7, large=220):
    own = random.Random(seed)
    word = lambda: "w%d" % own.randint(0, 3000)
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range(own.choice([1, 2, 3, 6, 12, 60, 200]))]
        for _ in range(large if g == 0 else own.randint(1, 8)):
            copy = list(base) if g else (base * 60)[:60]
            for _ in range(own.randint(0, 1 + len(copy) // 12)):
                copy[own.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [texts[3].upper()] * 40 + ["", "\n \t", "one", "ONE", "one two", "x"]
    own.shuffle(texts)
    return [(i * 7 % 100003, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, monkeypatch, words):
    rows = [*made_up(), (200001, None), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, component_id int")
    assert found(docs, words) == brute(rows, words)


def test_large_mixed_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    rows = made_up(12, 3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute(rows, 2)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id long, text string")
    assert found(docs, 2) == [(1, 5, 1)] * 3 + [(2, 5, 1)]
    assert found(docs.limit(0), 2) == []
    assert found(spark.createDataFrame([(4, "")], "doc_id long, text string"), 2) == [(4, 0, 4)]


def test_signature_bins_agree_as_often_as_sets_overlap():
    own = np.random.default_rng(1)
    for shared, apart in ((4, 1), (40, 5), (400, 50), (4000, 500)):
        rates = []
        for _ in range(40):
            x = own.integers(0, 2**63, shared + 2 * apart, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[: shared + apart]), np.sort(np.concatenate([x[:shared], x[shared + apart :]]))
            rates.append(np.mean(near_dedup.signature(a, 160) == near_dedup.signature(b, 160)))
        assert abs(np.mean(rates) - shared / (shared + 2 * apart)) < 0.08


def test_query_op2(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = queries.op2_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 2)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    wanted = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({queries.SQL['op2_near_dedup']})").fetchall()
    assert sorted(wanted) == sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    assert sum(not r.kept for r in out) > 20


def test_hash_patterns_are_no_equal_sets(spark):
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, a)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2) == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 1, 1)]


def test_a_run_removes_its_tables_and_names_a_shared_folder(spark):
    work = Workspace(spark, "test")
    near_dedup.near_duplicates(spark.createDataFrame([(i, f"a b c d e f g {i % 3}") for i in range(30)], "doc_id long, text string"), 2, workspace=work).count()
    folder = Path(work.path.removeprefix("file://"))
    assert not any(p.name.startswith(("sets", "blocks", "mixed", "pairs", "links")) for p in folder.iterdir())
    work.remove()
    assert not folder.exists()

    class Elsewhere:
        conf = type("", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)
