"""Line deduplication against a brute-force version, also where keys span partitions."""

import hashlib
import random

import duckdb
import pyarrow as pa

from regolith.llm import line_dedup, queries


def brute(rows, least_chars=40, least_docs=5):
    def key(line):
        own = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in own)

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(docs, **args):
    rows = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, **args)).collect()
    return [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in rows]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_against_brute_force(spark):
    own = random.Random(2)
    common = ["Common line %d " % k + "é" * own.randint(20, 40) for k in range(12)]
    rows = []
    for i in range(400):
        lines = [own.choice(["  " + c.upper() if own.random() < 0.2 else c + "\t" for c in common]) if own.random() < 0.5 else f"own {i} {own.random()} " + "x" * own.randint(0, 40) for _ in range(own.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, common[0]), (5, common[1]), (5, common[1]), (903, (common[0] + "\n") * 3000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, keep string")
    assert in_order(found(docs)) == in_order(brute(rows))
    assert found(docs.limit(0)) == []


def test_columns_of_any_name_pass(spark):
    line = "A long line that five documents of this table hold"
    docs = spark.createDataFrame([(i, line, f"a{i}", i, "k", "c", -1) for i in range(6)], "doc_id long, text string, _row string, _id0 int, _keep0 string, _cut string, n_lines long")
    rows = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)).orderBy("doc_id").collect()
    assert [(r._row, r._id0, r._keep0, r._cut, r.n_lines, r.n_dropped) for r in rows] == [(f"a{i}", i, "k", "c", 1, int(i < 5)) for i in range(6)]
    assert [r.text for r in rows] == [""] * 5 + [line]


def test_one_key_over_many_partitions(spark):
    rows = [(i, "The same long line in every document of this table\nown line %d" % i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert in_order(found(docs)) == in_order(brute(rows))


def test_stream_does_not_depend_on_where_batches_and_partitions_end():
    own = random.Random(5)
    rows = sorted({(own.choice([1, 2, 3, 3, 3, 4, 9]), 0, own.randint(1, 40)) for _ in range(120)}, key=lambda r: (r[0], r[1], -r[2]))
    holders = {}
    for h, _, d in rows:
        holders.setdefault(h, set()).add(d)
    expected = sorted((h, d) for h, ds in holders.items() if len(ds) >= 5 for d in ds if d != max(ds))
    for _ in range(200):
        cuts = sorted(own.sample(range(1, len(rows)), own.randint(0, 6)))
        drops, ends, late = [], {}, []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part, inner = rows[a:b], sorted(own.sample(range(b - a + 1), min(3, b - a)))
            batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int64()), pa.array([r[1] for r in x], pa.int64()), pa.array([r[2] for r in x], pa.int64()), pa.array([0] * len(x), pa.int64()), pa.array([0] * len(x), pa.int32())], names=["h1", "h2", "doc", "row", "pos"]) for s, t in zip([0, *inner], [*inner, b - a], strict=True) for x in [part[s:t]]]
            for out in line_dedup._stream(batches, 5):
                for r in out.to_pylist():
                    if r["kind"] == "D":
                        drops.append((r["h1"], r["doc"]))
                    elif r["kind"] == "S":
                        n, top = ends.get(r["h1"], (0, 0))
                        ends[r["h1"]] = n + r["docs"], max(top, r["doc"])
                    else:
                        late.append((r["h1"], r["doc"]))
        drops += [(h, d) for h, d in late if ends[h][0] >= 5 and d < ends[h][1]]
        assert sorted(drops) == expected


def test_query_op10_is_its_sql(spark):
    for size in ("sf0.001", "sf0.01"):
        rows = sorted(map(tuple, queries.op10_line_dedup(spark, f"/root/testdata/{size}").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{size}/documents.parquet'")
        assert rows == sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.SQL['op10_line_dedup']})").fetchall())
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert sum(r[2] for r in rows) > 0
    assert [r[3] for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for *_, t in sorted(brute([(d.doc_id, d.text) for d in texts]))]
