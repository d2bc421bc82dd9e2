"""Statistics, boosted trees and site posteriors against plain versions, and held-out accuracy."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from regolith.llm import boosting, quality_bayes, quality_rules, queries, statistics
from regolith.llm.common import Workspace


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def made_up(seed=1, n=300):
    own = random.Random(seed)
    parts = ["a", "bé", "中文", "#", "|x", "\n", "\n\n", " ", "\t", "x y\n", "one two three four five six seven eight nine ", "\x0b", "\x85", "😀 "]
    return ["".join(own.choice(parts) for _ in range(own.randint(0, 60))) for _ in range(n)]


def test_counts():
    texts = [*made_up(), None, "", "\n", "a\n", "\na"]
    found = statistics.count(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(found[k][i]) for k in names) for i in range(len(texts))] == [plain(t) for t in texts]
    assert found["n_lines"].tolist() == [(t or "").count("\n") + 1 for t in texts]


def test_boosted_trees_learn_and_obey_their_constraints():
    own = np.random.default_rng(2)
    x = own.random((3000, 4))
    y = (own.random(3000) < 1 / (1 + np.exp(-(6 * x[:, 0] - 8 * x[:, 1] + np.sin(9 * x[:, 2]))))).astype(float)
    forest = boosting.fit(x[:2000], y[:2000], {0: 1, 1: -1})
    p = forest.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.8
    for f, side in ((0, 1), (1, -1)):
        at = np.repeat(own.random((50, 1, 4)), 60, 1)
        at[:, :, f] = np.linspace(-0.1, 1.1, 60)
        assert (np.diff(forest.score(at.reshape(-1, 4)).reshape(50, 60), axis=1) * side >= -1e-12).all()
    one = boosting.fit(np.zeros((0, 4)), np.zeros(0))
    assert one.score(x[:3]).tolist() == [0.5] * 3


def test_rules(spark):
    texts = [*made_up(5, 60), None, ""]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(None, "x", True), (7, texts[7], True)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (4000, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        own = plain("x" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0]) and not (r.base_failed and r.kept)
    empty = quality_rules.judge(docs.limit(0), quality_rules.train(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0


def check_accuracy(spark, rows, least_good, least_bad):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not getattr(r, "base_failed", False)]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > least_good and 1 - np.mean(bad) > least_bad, (np.mean(good), np.mean(bad))


def test_rules_on_documents_that_they_were_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = quality_rules.train(docs, labels.where("doc_id % 2 = 0"))
    evidence = quality_bayes.train(docs, labels.where("doc_id % 2 = 0"))
    other = docs.where("doc_id % 2 = 1")
    check_accuracy(spark, quality_rules.judge(other, forest).collect(), 0.98, 0.95)
    sources = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1")
    check_accuracy(spark, quality_bayes.classify(sources, evidence, F.col("source"), F.col("lang")).collect(), 0.97, 0.9)


def test_query_op4(spark):
    rows = queries.op4_quality_rules(spark, "/root/testdata/sf0.1").collect()
    check_accuracy(spark, rows, 0.98, 0.9)


def test_query_op3(spark):
    rows = queries.op3_quality_bayes(spark, "/root/testdata/sf0.1").collect()
    check_accuracy(spark, rows, 0.97, 0.7)


def test_posteriors_against_plain_sums(spark):
    own = random.Random(3)
    rows = [(f"h{min(own.randint(0, 30), own.randint(0, 30))}", f"p{own.randint(0, 2)}", own.random()) for _ in range(800)] + [("", "", 0.5)]
    sites, mean, host_strength, path_strength = quality_bayes.posteriors(spark.createDataFrame(rows, "host string, path string, p double"), Workspace(spark, "test"))
    ps = np.array([p for *_, p in rows])
    assert abs(mean - ps.mean()) < 1e-9

    def strength(groups):
        between = np.mean([(np.mean(g) - m) ** 2 for g, m in groups])
        within = np.mean([np.sum(np.array(g) * (1 - np.array(g))) / len(g) ** 2 for g, _ in groups])
        return float(np.clip(mean * (1 - mean) / max(between - within, 1e-9) - 1, *quality_bayes.STRENGTH))

    by_host, by_path = {}, {}
    for h, q, p in rows:
        by_host.setdefault(h, []).append(p)
        by_path.setdefault((h, q), []).append(p)
    assert abs(host_strength / strength([(g, mean) for g in by_host.values()]) - 1) < 1e-6
    assert abs(path_strength / strength([(g, np.mean(by_host[h])) for (h, _), g in by_path.items()]) - 1) < 1e-6
    assert {(r.host, r.path): (r.n, round(r.total, 9), r.host_n) for r in sites.collect()} == {k: (len(g), round(sum(g), 9), len(by_host[k[0]])) for k, g in by_path.items()}


def test_sites_shift_their_documents(spark):
    good, bad = "All is well in this plain text about things that are so and so. " * 3, "### $$$ | buy | buy | %%% !!! " * 12
    rows = [(i, good, "fine.example", "/a") for i in range(60)] + [(100 + i, bad, "junk.example", "/b") for i in range(60)] + [(500, good, "junk.example", "/b"), (501, good, "new.example", None), (502, None, None, None), (None, good, "fine.example", "/a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_bayes.classify(docs, quality_bayes.train(docs, labels), docs.host, docs.path).collect()}
    assert len(found) == len(rows) and found[0].kept and not found[100].kept
    assert found[500].quality < found[501].quality < found[0].quality and found[500].evidence == found[501].evidence
    assert quality_bayes.classify(docs.limit(0), quality_bayes.train(docs.limit(0), labels), docs.host, docs.path).count() == 0
    urls = spark.createDataFrame([("https://A.example/x/y?z",), ("http://b.example",), ("no url",), (None,)], "url string")
    assert [tuple(r) for r in urls.select(*quality_bayes.site_of(urls.url)).collect()] == [("a.example", "/x"), ("b.example", None), (None, None), (None, None)]


def test_the_fixed_columns_of_op4_are_its_sql(spark, tmp_path):
    odd = [*made_up(9, 200), None, "", "\n", "one two three four five six seven eight " * 3]
    spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for path, files in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.01", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{files}'")
        names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
        wanted = con.execute(f"SELECT {names} FROM ({queries.OP4_BASE_SQL})").fetchall()
        assert sorted(wanted) == sorted(map(tuple, queries.op4_quality_rules(spark, path).select(*names.split(", ")).collect()))


def test_hash_patterns_are_no_equal_lines(spark):
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    found = statistics.count(pa.array([f"{a}\n{b}", f"{a}\n{a}"]))
    assert found["n_dup_lines"].tolist() == [0, 1] and found["n_distinct_words"].tolist() == [2, 1]


def test_repeated_labels_count_by_their_largest(spark):
    docs = spark.createDataFrame([(i, "a text of so many words") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0), (2, None), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality_rules.labelled_features(docs, labels, "quality")[1].tolist() == [1, 0, 0, 1]


def plain_posteriors(rows):
    """path posterior and quality of (host, path, logit) rows by loops over them."""
    p = [1 / (1 + math.exp(-z)) for *_, z in rows]
    hosts, paths = {}, {}
    for (h, q, _), own in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(own)
        paths.setdefault((h, q), []).append(own)
    mean = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)

    def strength(groups):
        between = sum((sum(g) / len(g) - m) ** 2 for g, m in groups) / len(groups)
        within = sum(sum(x * (1 - x) for x in g) / len(g) ** 2 for g, _ in groups) / len(groups)
        return min(max(mean * (1 - mean) / max(between - within, 1e-9) - 1, quality_bayes.STRENGTH[0]), quality_bayes.STRENGTH[1])

    of_host = strength([(g, mean) for g in hosts.values()])
    of_path = strength([(g, sum(hosts[h]) / len(hosts[h])) for (h, _), g in paths.items()])
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for (h, q, z), own in zip(rows, p, strict=True):
        host = (of_host * mean + sum(hosts[h]) - own) / (of_host + len(hosts[h]) - 1)
        path = (of_path * host + sum(paths[h, q]) - own) / (of_path + len(paths[h, q]) - 1)
        out.append((path, 1 / (1 + math.exp(-(z + logit(path) - logit(mean))))))
    return out


def test_verdicts_against_plain_loops(spark):
    own = random.Random(11)
    texts = made_up(12, 400)
    sites = [(f"h{min(own.randint(0, 40), own.randint(0, 40))}.example", own.choice(["/a", "/b", None])) for _ in texts]
    docs = spark.createDataFrame([(i, t, *s) for i, (t, s) in enumerate(zip(texts, sites, strict=True))], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(len(texts[i]) % 3 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    evidence = quality_bayes.train(docs, labels)
    logits = evidence.logits(statistics.features(statistics.count(pa.array(texts))))
    wanted = plain_posteriors([(h, q or "", float(z)) for (h, q), z in zip(sites, logits, strict=True)])
    for r in quality_bayes.classify(docs, evidence, docs.host, docs.path).collect():
        assert abs(r.path_posterior - wanted[r.doc_id][0]) < 1e-9 and abs(r.quality - wanted[r.doc_id][1]) < 1e-9
        assert r.kept == (r.quality >= quality_bayes.LEAST)


def test_a_host_of_many_paths_meets_its_sums_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quality_bayes, "hot_keys", lambda counts, keys, n="n", least=0: counts.where(F.col(n) > 20).select(*keys))
    rows = [("big", f"p{i}", (i % 10) / 10) for i in range(200)] + [("small", "p", 0.5)]
    sites, *_ = quality_bayes.posteriors(spark.createDataFrame(rows, "host string, path string, p double"), Workspace(spark, "test"))
    assert {(r.host, r.host_n) for r in sites.collect()} == {("big", 200), ("small", 1)} and sites.count() == 201


def test_pages_are_judged_by_their_sites(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = queries.quality_of_pages(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.select("page_id").collect())
    sizes = Counter((r.host, r.path) for r in rows)
    assert all(r.host for r in rows) and sum(n <= 2 for n in sizes.values()) > 10 and all(0 <= r.quality <= 1 for r in rows)


def test_trees_against_a_plain_walk():
    own = np.random.default_rng(21)
    x = own.normal(size=(500, 5)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = boosting.fit(x, y, monotone={0: 1}, trees=15)

    def walked(row):
        total = forest.base
        for root in forest.roots.tolist():
            node = root
            while forest.feature[node] >= 0:
                node = int(forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node])
            total += forest.value[node]
        return 1 / (1 + math.exp(-total))

    some = np.concatenate([x[:200], own.normal(size=(100, 5))])
    assert np.allclose(forest.score(some), [walked(r) for r in some], atol=1e-12)
    # No row's score falls as the constrained feature grows.
    for r in some[:50]:
        line = [walked([v, *r[1:]]) for v in np.linspace(-3, 3, 25)]
        assert all(b >= a - 1e-12 for a, b in zip(line, line[1:], strict=False))


def test_posteriors_of_pages_against_plain_loops(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.quality_of_pages(spark, path).collect()
    evidence = quality_bayes.train(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    texts = {r.page_id: r.text for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", bare.alias("text")).collect()}
    logits = evidence.logits(statistics.features(statistics.count(pa.array([texts[r.page_id] for r in rows], pa.string()))))
    wanted = plain_posteriors([(r.host, r.path, float(z)) for r, z in zip(rows, logits, strict=True)])
    for r, (at_path, quality) in zip(rows, wanted, strict=True):
        assert abs(r.path_posterior - at_path) < 1e-9 and abs(r.quality - quality) < 1e-9
