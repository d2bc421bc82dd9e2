"""Merkle manifests against a plain version."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from regolith.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(nodes):
    """The top of these nodes, and of each the siblings before and behind it level by level."""
    ways, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, at in enumerate(where):
            run = runs[at // 16]
            ways[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        where = [at // 16 for at in where]
        nodes = [h(*run) for run in runs]
    return nodes[0], ways


def plain(rows, tampered):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (values of COLUMNS)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    tops = {s: climbed([leaf_of(r) for r in groups[s]]) for s in order}
    root, outer = climbed([tops[s][0] for s in order]) if order else (None, [])
    out = []
    for s, beyond in zip(order, outer, strict=True):
        for row, way in zip(groups[s], tops[s][1], strict=True):
            folded = leaf_of(tampered(row))
            for left, right in way + beyond:
                folded = h(left, folded, right)
            out.append((row[0], leaf_of(row), tops[s][0], root, h(*[left + right for left, right in way + beyond]), folded, folded == root))
    return out


def tampered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_query_op13(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select(*COLUMNS).collect()]
    found = queries.op13_merkle(spark, path).collect()
    assert in_order(found) == in_order(plain(rows, tampered))
    assert 0 < sum(not r.verified for r in found) < len(rows)


def test_sql_op13(tmp_path):
    rows = [(k, [None, "a", "ä", "b"][k % 4] if k < 90 else "c", "en", k, f"Text {k}") for k in range(700)] + [(9999, "d", None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    found = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.OP13_SQL})").fetchall()
    assert in_order(found) == in_order(plain(rows, tampered))


def test_odd_rows(spark, tmp_path):
    own = random.Random(3)
    sources = [None, "", "a", "ä", "Z", "\U0001f600", "￿", *[f"s{k}" for k in range(40)]]
    rows = [(k, own.choice(sources[2:6]), "en", k, own.choice(["Text", "täxt", "", "lower"]) + str(k)) for k in range(900)]
    rows += [(2000 + k, s, None, None, None) for k, s in enumerate(sources)]
    rows += [(5, "a", "en", 5, "Again"), (5, "a", "en", 5, "Again"), (None, "a", "x", 1, "No id"), (None, None, None, None, None), (-7, "a", "en", 1, "NEGATIVE\n" * 1000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("key", tag()).withColumn("leaf", tag())
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_merkle(spark, str(tmp_path)).collect()
    assert in_order(found) == in_order(plain(rows, tampered))
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_merkle(spark, f"{tmp_path}/none").count() == 0
    table.where("doc_id = 7").write.parquet(f"{tmp_path}/one/documents.parquet")
    one = queries.op13_merkle(spark, f"{tmp_path}/one").collect()
    assert in_order(one) == in_order(plain([r for r in rows if r[0] == 7], tampered))
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == h("")


def tag():
    from pyspark.sql import functions as F

    return F.lit("clash")


@pytest.mark.parametrize("sizes", [[1, 16, 17, 256, 257, 4096, 4097], [20000], [1, 1], [70000, 3]])
def test_sizes_around_the_levels(spark, sizes):
    rows = [(k, f"g{g}", None, None, None) for g, n in enumerate(sizes) for k in range(n)]
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    table = spark.createDataFrame(rows, columns).repartition(6)
    found = merkle.manifest(table, COLUMNS, "source", "doc_id").collect()
    assert in_order(found) == in_order(plain(rows, lambda row: row))
    assert all(r.verified for r in found)


def test_positions_of_keys_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from regolith.llm.common import Workspace

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, "=m").when(F.col("id") < 3010, F.concat(F.lit("=a"), F.col("id"))).otherwise("=z").alias("key"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = merkle.positions(rows, [F.col("id")], Workspace(spark, "positions")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = {}
    for r in found:
        by.setdefault(r.key, []).append((r.id, r["at"]))
    assert all([at for _, at in sorted(own)] == list(range(len(own))) for own in by.values()) and len(found) == 5000


def test_a_statements_memory_does_not_grow_with_the_height_of_the_tree():
    n, outer, side = 2 * merkle.BUCKET, 6, h("side") * 7
    digests = [h(str(i)) for i in range(n)]
    numbers, at = np.repeat([0, 1], merkle.BUCKET), np.tile(np.arange(merkle.BUCKET), 2)
    leaves = pa.table({"k": numbers, "levels": np.full(n, merkle.LEVELS), "pos": at, "digest": digests, "start": digests})
    outers = pa.table({"k": [0, 1], "lefts": [[side] * outer] * 2, "rights": [[side] * outer] * 2, "beyond": [side * 2 * outer] * 2})
    engine = duckdb.connect()
    for setting in ("threads = 1", "temp_directory = ''", "memory_limit = '200MB'"):
        engine.execute(f"SET {setting}")
    engine.register("leaves", leaves)
    engine.register("outers", outers)
    found = engine.sql(merkle._proofs_sql(outer)).fetchall()
    expected = []
    for start in (0, merkle.BUCKET):
        top, ways = climbed(digests[start : start + merkle.BUCKET])
        for _ in range(outer):
            top = h(side, top, side)
        expected += [(h(*[a + b for a, b in way], side * 2 * outer), top) for way in ways]
    assert found == expected
