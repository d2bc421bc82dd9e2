"""BPE by words against the tokenizers library, and the automaton against a trie."""

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkFiles
from tokenizers import Tokenizer

from regolith.llm import queries, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = Path(PATH).read_text(encoding="utf-8")
PIECES = ["a", "B", "'", "s", "t", "re", "VE", "ll", " ", "  ", "\n", "\t", "\xa0", "　", "é", "É", "中", "1", "٣", "!", "😀", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "é", "́", "̇", "İ", "ẞ", "Σ", "ς", "ǅ", "한", "ᄒ", "ᅡ", "ᆫ", " ", "​", "K", "Å", "क", "़", "½", "ᾳ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=1):
    own = random.Random(seed)
    return ["".join(own.choice(PIECES) for _ in range(own.randint(0, 30))) for _ in range(n)] + ["", "a" * 3000, "中" * 2000, "'s" * 900, "ab1é" * 2000]


def test_the_automaton_numbers_words_in_order_and_shares_ends(tmp_path):
    own = random.Random(2)
    words = sorted({bytes(own.choice(b"abc\xc3") for _ in range(own.randint(1, 6))) + own.choice([b"", b"ing", b"tion"]) for _ in range(2000)})
    ids = [[own.randint(0, 9) for _ in range(own.randint(1, 3))] for _ in words]
    (tmp_path / "book").write_bytes(transducer.Lexicon.build(words, ids))
    book = transducer.mapped(str(tmp_path / "book"))
    others = [w + b"x" for w in words[:50]] + [w[:-1] for w in words if len(w) > 1 and w[:-1] not in words][:50] + [b"z", b"a" * 100]
    spans = words + others
    data = np.frombuffer(b"".join(spans), np.uint8)
    lengths = np.array([len(w) for w in spans])
    assert book.find(data, np.cumsum(lengths) - lengths, lengths).tolist() == [*range(len(words)), *[-1] * len(others)]
    assert [book.ids[book.offsets[k] : book.offsets[k + 1]].tolist() for k in range(len(words))] == ids
    # Minimal: as many states as there are different sets of endings.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    endings = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(book.final) == len(set(endings.values())) < len(prefixes) / 3
    assert not book.keys.flags.writeable


def test_empty_lexicon():
    book = transducer.Lexicon(transducer.Lexicon.build([], []))
    assert book.find(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 1])).tolist() == [-1, -1]


def test_ids_are_the_librarys(library):
    own = transducer.speller(DEFINITION)
    words = sorted({b"the", b"a", b"b", b"'s", b"!", b"1", "é".encode(), "İ".encode(), b"aa"})
    whole = np.array([transducer._is_whole(w, own.opens) for w in words])
    texts = odd_texts(3000)
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    decoder = transducer.Decoder(DEFINITION)
    for some in (words, []):
        book = transducer.Lexicon(transducer.Lexicon.build(some, own.ids(some, whole[: len(some)])))
        ids, offsets = transducer.Encoder(book, own).encode(pa.array([*texts, None]))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-2], offsets[1:-1], strict=True)] == wanted
        assert offsets[-1] == offsets[-2]
    for found, text in zip(wanted, texts, strict=True):
        assert decoder.decode(np.array(found, np.int64)).decode() == library.decode(found, skip_special_tokens=False), text


def test_every_letter_as_the_library_has_it(library):
    own = transducer.speller(DEFINITION)
    encoder = transducer.Encoder(transducer.Lexicon(transducer.Lexicon.build([], [])), own)
    points = [c for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000] + list(range(0x2000)) + list(range(0xE0000, 0xE0200))
    texts = [f"{chr(c)}a'{chr(c)}" for c in points]
    ids, offsets = encoder.encode(pa.array(texts))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == wanted


def test_long_texts_go_in_pieces(library, monkeypatch):
    monkeypatch.setattr(transducer, "PIECE", 64)
    own = transducer.speller(DEFINITION)
    encoder = transducer.Encoder(transducer.Lexicon(transducer.Lexicon.build([b"the"], own.ids([b"the"], np.array([False])))), own)
    texts = [*odd_texts(200, 5), "The house's " * 300, "x" * 5000, " " * 5000]
    ids, offsets = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_and_decode(spark, library):
    texts = odd_texts(200, 3)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, "x", 1), (900, "same row", "x", 1), (900, "same row", "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, word int")
    book = transducer.lexicon(docs, DEFINITION, frequent=100)
    assert 0 < book.words < 100
    found = transducer.encode(docs, DEFINITION, book, decoded=True)
    wanted = [(-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows]
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), r.decoded) for r in found.collect()) == sorted((i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in wanted)
    again = transducer.decode(found.select("doc_id", "ids"), DEFINITION)
    assert sorted((r.doc_id or -1, r.decoded) for r in again.collect()) == sorted((r.doc_id or -1, r.decoded) for r in found.collect())
    none = docs.limit(0)
    empty = transducer.lexicon(none, DEFINITION)
    assert empty.words == 0 and transducer.encode(none, DEFINITION, empty).count() == 0
    assert transducer.encode(docs, DEFINITION, empty).where("doc_id = 7").first().ids == library.encode(texts[7], add_special_tokens=False).ids


def test_the_lexicon_holds_the_frequent_words(spark):
    docs = spark.createDataFrame([("the cat's 1 The", ), ("THE dog", ), (None, ), ("x" * 100 + " the", )], "text string")
    counts = {bytes(r.word): r.n for r in transducer.word_counts(docs, DEFINITION).collect()}
    assert counts == {b"the": 4, b"cat": 1, b"'s": 1, b"1": 1, b"dog": 1}
    book = transducer.lexicon(docs, DEFINITION, frequent=4)
    assert book.words == 1
    mapped = transducer.mapped(SparkFiles.get(book.file))
    assert mapped.ids.tolist() == [518]  # fixed by the vocabulary


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="not a word BPE"):
        transducer.check(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())


def test_query_op11(spark, library):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op11_word_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(documents)
    for d in documents:
        ids, own = library.encode(d.text, add_special_tokens=False).ids, found[d.doc_id]
        text = library.decode(ids, skip_special_tokens=False)
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
