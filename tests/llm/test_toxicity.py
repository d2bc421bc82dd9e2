"""Weak supervision: the label model on made-up votes, and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from regolith.llm.textscan import buffer_of
from regolith.llm import language_id, queries, toxicity


def test_label_model_finds_accuracies_and_copies():
    own = np.random.default_rng(4)
    truth = own.random(6000) < 0.2
    rates = (0.95, 0.9, 0.8, 0.7, 0.85)
    votes = np.column_stack([np.where(own.random(6000) < 0.3, 0, np.where(own.random(6000) < r, truth, ~truth) * 2 - 1) for r in rates])
    copy = np.where(own.random(6000) < 0.98, votes[:, 3], -votes[:, 3])
    votes = np.column_stack([votes, copy, copy]).astype(np.int8)
    model, posterior = toxicity.fit_labels(votes, 0.2)
    right = [model.chance[1, 2, j] / (model.chance[1, 2, j] + model.chance[1, 0, j]) for j in range(4)]
    assert right[0] > right[2] > right[3] and abs(right[0] - rates[0]) < 0.08
    assert model.weight[3] < 0.6 * model.weight[0]
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_entries_are_words_and_their_beginnings():
    a, text, words = toxicity._entry_hashes(pa.array(["Éclairage x", None, "éclair", "12 !", "éclairés"]))
    assert words.tolist() == [2, 0, 1, 0, 1] and text.tolist() == [0, 0, 2, 4]
    assert a[0, 3] == a[3, 3] != 0 and a[2, 3] == 0 and a[0, 1] == a[2, 1] == a[3, 1] != 0 and (a[1, 1:] == 0).all()


def test_query_op7(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    both = sum(p and t for p, t in own)
    assert both / sum(t for _, t in own) > 0.9 and both / sum(p for p, _ in own) > 0.9


def test_odd_rows(spark):
    rows = [(i, "you are a worthless idiot and a moron" if i % 3 == 0 else "the weather is nice and the sea is calm", "x", 0.5) for i in range(60)]
    odd = [(900, None, "x", 0.1), (901, "", "x", 0.1), (None, "idiot", "x", 0.1), (902, "fine words " * 20000, "x", 0.1), (3, rows[3][1], "x", 0.1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1, None), (None, 1), (4000, 1)], "doc_id long, toxic int")
    learn = ~language_id.held_out(parts=4, part=2)
    found = toxicity.score(docs, toxicity.train(docs, labels, learn)).collect()
    assert len(found) == len(rows) + 5
    score = {r.doc_id: r.score for r in found}
    assert min(score[i] for i in range(0, 60, 3)) > 0.3 > max(score[i] for i in [*range(1, 60, 3), 900, 901, 902])
    none = toxicity.train(docs.limit(0), labels.limit(0), learn)
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_few_labels_in_many_documents_all_anchor_the_label_model(spark, monkeypatch):
    rows = [(i, "you are a worthless idiot and a moron" if i % 50 == 0 else "the weather is nice and the sea is calm") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(0, 6000, 10)], "doc_id long, toxic int")
    learn = ~language_id.held_out(parts=4, part=2)
    known = [r.toxic for r in labels.where(learn).collect()]
    seen = {}

    def fit(votes, prior, marks=None, *args, _fit=toxicity.fit_labels, **named):
        seen["toxic"], seen["clean"], seen["none"] = (int((marks == m).sum()) for m in (1, -1, 0))
        return _fit(votes, prior, marks, *args, **named)

    monkeypatch.setattr(toxicity, "fit_labels", fit)
    model = toxicity.train(docs, labels, learn, sample=300)
    assert seen["toxic"] == sum(known) and 120 < seen["clean"] < 280 and 200 < seen["none"] < 340
    assert model.labels.prior < 0.15
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(score[i] for i in range(0, 6000, 50)) > 0.3 > max(score[i] for i in range(6000) if i % 50)


def hashes(words):
    return {w: toxicity._entry_hashes(pa.array([w]))[0][0, 0] for w in words}


def lexicon_of(odds):
    """A mined lexicon of entries: a word, or a word beginning with * behind it."""
    keys = {}
    for entry in odds:
        if entry.endswith("*"):
            keys[entry] = toxicity._entry_hashes(pa.array([entry[:-1] + "zz"]))[0][0, 1 + toxicity.BEGINNINGS.index(len(entry) - 1)]
        else:
            keys[entry] = hashes([entry])[entry]
    return toxicity.Lexicon(np.array(list(keys.values()), np.uint64), np.array(list(odds.values())), *toxicity.fixed_words()), {e: int(k) % toxicity.SHARDS for e, k in keys.items()}


def plain_look(text, odds, shard):
    """Votes and features word by word."""
    words = re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())
    group = {}
    for g, line in enumerate(toxicity.LEXICONS):
        for w in line.split():
            group.setdefault(w, g)
    hit, strengths, shards, groups, known = [], [], set(), set(), 0
    for w in words:
        entries = [e for e in (w, *(w[:n] + "*" for n in toxicity.BEGINNINGS if len(w) > n)) if e in odds]
        best = max(entries, key=odds.get, default=None)
        strengths.append(odds[best] if best else 0.0)
        if best:
            shards.add(shard[best])
        if w in group:
            groups.add(group[w])
            known += 1
        hit.append(best is not None or w in group)
    n, hits, power = max(1, len(words)), sum(hit), sum(strengths)
    dense = hits / n >= 0.004
    phrases = [any(words[i : i + len(p.split())] == p.split() for p in line.split(", ") for i in range(len(words))) for line in toxicity.PHRASES]
    place = [i for i, h in enumerate(hit) if h]
    addressed = any(words[i - k] in toxicity.ADDRESS.split() for i in place for k in range(1, toxicity.BEFORE + 1) if i >= k)
    near = [any(b - a <= reach for a, b in zip(place, place[more:], strict=False)) for more, reach in ((1, toxicity.PAIR), (2, toxicity.RUN))]
    votes = [int(dense and g in groups) for g in range(len(toxicity.LEXICONS))] + [int(dense and k in shards) for k in range(toxicity.SHARDS)]
    votes += [-1 if not hits else int(hits / n >= 0.01), -1 if power / n < 0.005 else int(power / n > 0.04), int(len(shards) >= 3 and hits / n >= 0.005), int(known > 0 and known / n >= 0.004)]
    votes += [int(dense and x) for x in (*phrases, addressed, *near)]
    m = len(words)
    features = [math.log((hits + 0.5) / (0.01 * m + 0.5)), math.log((power + 1) / (0.04 * m + 1)), math.log((known + 0.5) / (0.01 * m + 0.5)), math.log1p(hits), min(hits / n, 0.2) * 20, math.sqrt(min(hits / n, 0.2)) * 5]
    features += [min(power / n, 1) * 5, max(strengths, default=0) / 3, math.log1p(known), min(known / n, 0.2) * 20, math.log1p(m) / 5]
    return votes, features


ODDS = {"vile": 3.5, "zorg*": 4.0, "zorgon": 5.0, "miesé*": 2.75, "blarg": 3.0, "blargen*": 3.25}


def made_up(seed=6, n=300):
    own = random.Random(seed)
    parts = ["you", "idiot", "vile", "zorgon", "zorgonic", "mieséra", "blarg", "blargening", "shut", "up", "piece", "of", "trash", "drop dead", "house", "sea", "calm", "Éclair", "12", "kill you", "x", "HATE", "\n", "trottel, du"]
    return [" ".join(own.choice(parts[10 if own.random() < 0.4 else 0 :]) for _ in range(own.randint(0, 60))) for _ in range(n)]


def test_votes_and_features_against_plain_loops(monkeypatch):
    texts = [*made_up(), None, "", "!!", "plain " * 400 + "you vile idiot"]
    lexicon, shard = lexicon_of(ODDS)
    own = toxicity.Voters(lexicon)
    votes, features = own.look(pa.array(texts))
    wanted = [plain_look(t, ODDS, shard) for t in texts]
    assert votes.tolist() == [v for v, _ in wanted] and np.allclose(features, [f for _, f in wanted])
    assert (votes > 0).any(0).sum() >= 15
    monkeypatch.setattr(toxicity, "PIECE", 40)
    long = ["plain words and then some " * 30 + t for t in ("", "vile", "zorgon")] + texts
    votes, features = own.look(pa.array(long))
    wanted = [plain_look(t, ODDS, shard) for t in long]
    assert votes.tolist() == [v for v, _ in wanted] and np.allclose(features, [f for _, f in wanted])


def test_a_phrase_counts_wherever_a_long_text_is_cut():
    lexicon, shard = lexicon_of(ODDS)
    own = toxicity.Voters(lexicon)
    for shift in range(0, 24, 3):
        text = "plain " * ((toxicity.PIECE - shift) // 6) + "shut up you vile thing " + "plain " * (2 * toxicity.PIECE // 6)
        assert len(text) > 2 * toxicity.PIECE
        pieces = toxicity._cuts(*buffer_of(pa.array([text])))
        assert len(pieces) > 2
        parts = own._sums(*buffer_of(pa.array([text]))).patterns[0]
        before, found = toxicity.Tail(np.zeros(0, np.uint64), np.zeros(0, bool)), []
        data, _ = buffer_of(pa.array([text]))
        for a, b in zip(pieces[:-1].tolist(), pieces[1:].tolist(), strict=True):
            found.append(own._sums(data[a:b], np.array([0, b - a]), before).patterns[0])
        assert (np.any(found, 0) == parts).all() and parts[0]


def test_label_model_against_plain_loops():
    own = np.random.default_rng(8)
    truth = own.random(150) < 0.3
    votes = np.column_stack([np.where(own.random(150) < 0.4, 0, np.where(own.random(150) < r, truth, ~truth) * 2 - 1) for r in (0.9, 0.8, 0.7, 0.6)]).astype(np.int8)
    marks = np.where(own.random(150) < 0.2, truth * 2 - 1, 0)
    weights = own.random(150) + 0.5
    n, m = votes.shape
    p = [toxicity.SURE if k > 0 else 1 - toxicity.SURE if k < 0 else min(max(0.5 + 0.2 * int(sum(v)), 0.02), 0.98) for v, k in zip(votes.tolist(), marks.tolist(), strict=True)]
    prior = 0.1
    for _ in range(5):
        chance = [[[(sum(q for q, v in zip([x if y else 1 - x for x in p], votes[:, j].tolist(), strict=True) if v == vote) + 0.5) / (sum(x if y else 1 - x for x in p) + 1.5) for vote in (-1, 0, 1)] for j in range(m)] for y in (0, 1)]
        shared = [[0.0] * m for _ in range(m)]
        for side in (True, False):
            rows = [votes[i].tolist() for i in range(n) if (p[i] > 0.5) == side]
            means = [sum(r[j] for r in rows) / max(1, len(rows)) for j in range(m)]
            for j in range(m):
                for k in range(m):
                    shared[j][k] += sum((r[j] - means[j]) * (r[k] - means[k]) for r in rows)
        spread = [math.sqrt(max(shared[j][j], 0.001 * n + 1e-9)) for j in range(m)]
        weight = [1 / (1 + sum(max(0.0, shared[j][k] / spread[j] / spread[k]) for k in range(m) if k != j)) for j in range(m)]
        prior = min(max(0.5 * prior + 0.5 * sum(w * x for w, x in zip(weights, p, strict=True)) / sum(weights), 0.01), 0.5)
        logit = [math.log(prior / (1 - prior)) + sum(weight[j] * math.log(chance[1][j][v + 1] / chance[0][j][v + 1]) for j, v in enumerate(row)) for row in votes.tolist()]
        p = [(toxicity.SURE if k > 0 else 1 - toxicity.SURE) if k else 1 / (1 + math.exp(-z)) for z, k in zip(logit, marks.tolist(), strict=True)]
    model, posterior = toxicity.fit_labels(votes, 0.1, marks, 5, weights)
    assert np.allclose(posterior, p) and abs(model.prior - prior) < 1e-12 and np.allclose(model.weight, weight) and np.allclose(model.chance.transpose(0, 2, 1), chance)


def test_scores_against_plain_loops(spark):
    texts = [*made_up(7, 80), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon, shard = lexicon_of(ODDS)
    weights = np.random.default_rng(1).normal(size=12)
    model = toxicity.Model(lexicon, toxicity.LabelModel(0.1, np.full((2, 3, 1), 1 / 3), np.ones(1)), weights)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        z = sum(w * x for w, x in zip(weights, [*plain_look(text, ODDS, shard)[1], 1], strict=True))
        assert abs(found[i] - 1 / (1 + math.exp(-z))) < 1e-9
