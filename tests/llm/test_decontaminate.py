"""Alignment against the textbook recurrence, and planted leaks."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa

from regolith.llm import decontaminate, queries


def plain_words(text):
    """Runs of letters, numbers and marks in lower case; ideographs and kana one by one."""
    apart = "".join(f" {c} " if "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" else c for c in (text or "").lower())
    return "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in apart).split(" ")


def textbook(window, item):
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            s = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_alignment():
    own = np.random.default_rng(1)
    windows = [own.integers(0, 6, own.integers(1, 30)).astype(np.uint64) for _ in range(80)]
    items = [own.integers(0, 6, own.integers(1, 15)).astype(np.uint64) for _ in range(80)]

    def padded(rows):
        out = np.zeros((len(rows), max(map(len, rows))), np.uint64)
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out, np.array([len(r) for r in rows])

    assert decontaminate.align(*padded(windows), *padded(items)).tolist() == [textbook(w, i) for w, i in zip(windows, items, strict=True)]


def test_planted_leaks(spark):
    own = random.Random(3)
    word = lambda: "w%d" % int(own.paretovariate(0.3) % 5000)
    items = [(i, " ".join(word() for _ in range(own.randint(14, 50)))) for i in range(30)]
    rows, expected = [], set()
    for d in range(300):
        words = [word() for _ in range(own.randint(0, 300))]
        if d % 5 == 0:
            i, text = own.choice(items)
            copy = text.upper().split()
            for _ in range(len(copy) // 8):
                copy[own.randrange(len(copy))] = word()
            at = own.randint(0, len(words))
            words[at:at] = [copy[0], "(" + copy[1] + "),", *copy[2:]]
            expected.add((d, i))
        rows.append((d, " ".join(words), 1.0))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, items[4][1] * 1, 1.0), (1002, items[4][1], 1.0), (None, items[5][1], 1.0)]
    expected |= {(1002, 4), (None, 5)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    bench = spark.createDataFrame([*items, (90, None), (None, "x y z"), (91, "one two"), (92, ""), (93, "?!")], "item_id long, text string")
    found = decontaminate.leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and found.count() == len(expected)
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_a_large_benchmark_goes_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "eta theta iota kappa lambda mu")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta"), (2, "eta theta iota kappa lambda mu")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_query_op5(spark):
    path = "/root/testdata/sf0.01"
    words = lambda t: [w for w in plain_words(t) if w]
    items = {r.item_id: words(r.text) for r in spark.read.parquet(path + "/benchmark.parquet").collect()}
    whole = set()
    aligned = {}
    for d in spark.read.parquet(path + "/documents.parquet").collect():
        own = " " + " ".join(words(d.text)) + " "
        aligned[d.doc_id] = own
        whole |= {(d.doc_id, i) for i, w in items.items() if w and f" {' '.join(w)} " in own}
    found = {(r.doc_id, r.item_id): r.score for r in queries.op5_decontamination(spark, path).collect()}
    assert whole and whole <= set(found)
    for (d, i), score in found.items():
        if (d, i) not in whole:
            assert abs(textbook(aligned[d].split(), items[i]) / (2 * len(items[i])) - score) < 1e-9 and score >= decontaminate.LEAST_SCORE
    assert len({d for d, _ in found}) < 100


def test_words_of_every_script():
    texts = ["Ein Fuß, zwei Füße!", "今日は良い天気ですね。明日は?", "ab中文cd 中", None, "", "naïve “quoted” e\u0301 x_y", "\xa0non\xa0breaking", "हिन्दी में", "a1b2"]
    for one in ([t] for t in texts), [texts]:
        for own in one:
            words, first = decontaminate.word_hashes(pa.array(own, pa.string()))
            flat = [[w for w in plain_words(t) if w] for t in own]
            every = sorted({w for ws in flat for w in ws})
            names = dict(zip(every, decontaminate.word_hashes(pa.array(every, pa.string()))[0].tolist(), strict=True))
            assert [words[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [[names[w] for w in ws] for ws in flat]


def test_short_and_unspaced_items_and_every_third_word_replaced(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    edited = " ".join("changed%d" % k if k % 3 == 2 else w for k, w in enumerate(item.split()))
    bench = spark.createDataFrame([(1, "Xyzzy"), (2, "plugh, plover"), (3, "今日は良い天気ですね。明日は雨でしょうか?"), (4, item), (5, "XYZZY!")], "item_id long, text string")
    filler = "this is a plain text about nothing much and it goes on "
    docs = spark.createDataFrame([(10, filler + "xyzzy " + filler), (11, filler + "Plugh plover"), (12, "彼は「今日は良い天気ですね。明日は雨でしょうか」と言った"), (13, filler + edited), (14, filler * 300), (15, "plover plugh"), (16, "今日は仕事です")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench).collect()}
    assert set(found) == {(10, 1), (11, 2), (12, 3), (13, 4)} and found[10, 1] == found[11, 2] == found[12, 3] == 1


def test_a_template_is_found_as_a_class_and_its_items_by_their_own_words(spark):
    items = [(k, f"What is the capital of land{k} and who rules there today") for k in range(3000)]
    bench = spark.createDataFrame([*items, (9000, items[5][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + items[7][1] + " they asked"), (2, items[5][1]), (3, "what is the capital of elsewhere and who rules there today")] + [(100 + k, "other words entirely %d" % k) for k in range(50)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.score, 3), r.n_items) for r in decontaminate.leaks(docs, bench).collect()}
    own = round(textbook(plain_words("what is the capital of elsewhere and who rules there today"), plain_words(items[0][1].lower())) / 22, 3)
    assert found == {(1, 7): (1, 1), (2, 5): (1, 1), (1, 0): (own, 3000), (2, 0): (own, 3000), (3, 0): (own, 3000)}
    members = decontaminate.classes(bench).collect()
    assert sorted(r.item_id for r in members) == list(range(3000)) and {r.class_id for r in members} == {0}


def test_forty_items_of_a_template_and_a_document_with_another_own_word(spark):
    words = "seven brave sailors carried the heavy golden chest across {} frozen northern harbour".split()
    items = [(k, " ".join(words).format(f"own{k}")) for k in range(40)]
    bench = spark.createDataFrame([*items, (50, "unrelated little question about the moons of distant planets"), (51, "seven brave sailors went home")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "they say " + " ".join(words).format("another") + " last year"), (2, "they say " + items[3][1]), (3, "seven brave sailors sang"), (4, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.n_items) for r in decontaminate.leaks(docs, bench).collect()}
    lowest = textbook(" ".join(words).format("another").split(), items[0][1].split()) / (2 * len(words))
    assert found[1, 0] == (lowest, 40) and lowest > 0.8
    assert found[2, 3] == (1, 1) and found[2, 0] == (lowest, 40)
    assert {d for d, _ in found} <= {1, 2, 3} and (3, 0) not in found
    # The class stands for its members: each one's own alignment is no lower.
    for r in decontaminate.classes(bench).where("class_id = 0").collect():
        assert textbook(" ".join(words).format("another").split(), items[r.item_id][1].split()) / (2 * len(words)) >= lowest
