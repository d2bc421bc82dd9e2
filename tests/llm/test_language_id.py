"""Language identification by held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from regolith.llm import language_id, linear, queries
from regolith.llm.textscan import buffer_of


def test_query_op9(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in own]) > 0.97


def test_odd_rows(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the house is on the hill", "en"), ("das haus ist auf dem berg", "de"), ("la maison est sur la colline", "fr"), ("la casa está en la colina", "es")] * 20)]
    odd = [(900, None, "en", 1), (901, "", "en", 1), (902, "12 !?", None, 1), (None, "the house", "en", 1), (903, "das haus " * 5000, None, 1), (903, "das haus", None, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    model = language_id.train(docs, ~language_id.held_out())
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and set(model.within) == {("de", "en"), ("es", "fr")} and set(model.between) == {("germanic", "romance")}
    found = {}
    for r in language_id.identify(docs, model).collect():
        found.setdefault(r.doc_id, []).append(r.lang_pred)
    assert [found[k] for k in (900, 901, 902, None, 903)] == [["und"], ["und"], ["und"], ["en"], ["de", "de"]]
    assert all(found[i] == [lang] for i, _, lang, _ in rows)
    assert language_id.train(docs.limit(0), ~language_id.held_out()) is None
    assert [r.lang_pred for r in language_id.identify(docs.limit(1), None).collect()] == ["und"]


def plain_row(text, bits):
    """Square roots of the counts of hashed n-grams of bytes, at length 1, one n-gram after another."""
    own = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    counts = [0] * (1 << bits)
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            gram = sum(b << (8 * k) for k, b in enumerate(own[i : i + n]))
            counts[(((gram * 2654435761 + n * 0x1EBCA6B) & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - bits)] += 1
    length = math.sqrt(sum(counts)) or 1.0
    return [math.sqrt(c) / length for c in counts]


def plain_vote(names, between, x):
    wins, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for (a, b), w in between.items():
        if a in names and b in names:
            p = 1 / (1 + math.exp(-2 * (sum(float(u) * v for u, v in zip(w[:-1], x, strict=True)) + float(w[-1]))))
            wins[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
    if len(names) == 1:
        return names[0], 1.0
    best = max(names, key=lambda n: wins[n] + sure[n] / len(names))
    return best, sure[best] / (len(names) - 1)


def test_grams_and_duels_against_plain_loops(spark, monkeypatch):
    own = random.Random(2)
    words = {"en": "the house is on hill and water", "de": "das haus ist auf dem berg und wasser", "nl": "het huis staat op een heuvel en water", "fr": "la maison est sur colline et eau", "es": "la casa está en colina y agua", "fi": "talo on mäellä ja vesi"}
    rows = [(i, " ".join(own.choice(words[lang].split()) for _ in range(own.randint(1, 30))), lang) for i, lang in enumerate(list(words) * 20)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "Ünï © 12!", "en"), (903, "x", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(linear, "PIECE", 50)
    found = np.concatenate(list(linear.ngram_rows(*buffer_of(pa.array([t for _, t, _ in rows])), language_id.BITS)))
    plain = [plain_row(t, language_id.BITS) for _, t, _ in rows]
    assert np.allclose(found, plain, atol=1e-6)
    model = language_id.train(docs, ~language_id.held_out())
    assert len(model.families) == 3 and len(model.within) == 4
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    for (i, text, _), x in zip(rows, plain, strict=True):
        family, sure = plain_vote(sorted(model.families), model.between, x)
        lang, more = plain_vote(model.families[family], model.within, x)
        if any(c.isalpha() for c in text or ""):
            assert out[i][0] == lang and abs(out[i][1] - sure * more) < 1e-4
        else:
            assert out[i] == ("und", 0)
