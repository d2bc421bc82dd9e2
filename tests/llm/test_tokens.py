"""BPE and token files against the public libraries, and round trips."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from regolith.llm import bpe, queries, textscan, token_files

PIECES = ["a", "B", "'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\xa0", "　", "é", "中", "1", "٣", "!", "😀", "-", "²", "\x1c", "\x85", "<|endoftext|>"]


def odd_texts(n, seed=1):
    own = random.Random(seed)
    return ["".join(own.choice(PIECES) for _ in range(own.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, " " * 2000, "x'" * 700, "ab1" * 2000]


@pytest.fixture(scope="module")
def tokens():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def public(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_pretokens_are_the_patterns_matches():
    texts = odd_texts(3000)
    data, places = textscan.buffer_of(pa.array(texts))
    starts, first = textscan.pretoken_starts(data, places)
    ends = np.append(starts[1:], len(data))
    for i, text in enumerate(texts):
        assert [bytes(data[starts[k] : ends[k]]).decode() for k in range(first[i], first[i + 1])] == regex.findall(public_tokenizers.PATTERN, text)


def test_words_are_the_runs_between_blanks():
    texts = ["", " ", "a", " a  b\tc\n", "é　中 x", "a\x0bb\x0cc\x85d", *odd_texts(200)]
    data, places = textscan.buffer_of(pa.array([None, *texts]))
    starts, ends, first = textscan.word_spans(data, places)
    for i, text in enumerate(["", *texts]):
        assert [bytes(data[starts[k] : ends[k]]).decode() for k in range(first[i], first[i + 1])] == regex.findall(r"[^\x20\x09-\x0D]+", text)


def test_encode_and_decode(spark, tokens, public):
    texts = odd_texts(300)
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(900, None, "x", None), (900, "same row", "x", None), (900, "same row", "x", None), (None, "no id", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    found = bpe.encode(docs, tokens, decoded=True).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), bytes(r.decoded)) for r in found) == sorted((-1 if i is None else i, public.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    again = bpe.decode(bpe.encode(docs, tokens), tokens).where("doc_id = 5").first()
    assert bytes(again.decoded).decode() == texts[5]
    assert bpe.encode(docs.limit(0), tokens).count() == 0


def test_query_op1(spark, public):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(documents)
    for d in documents:
        ids, own = public.encode_ordinary(d.text), found[d.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


@pytest.mark.parametrize("ids", [[7], [5] * 5000, list(range(4096)), [0, 50000, 2**32 - 1] * 10, [3] * 300 + [49000] * 2])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    own = token_files.pack_block(ids[:4096])
    assert (token_files.unpack_block(b"zz" + own, 2) == ids[:4096]).all()


def test_outliers_do_not_widen_a_block():
    even = np.full(4000, 9, np.uint32)
    assert len(token_files.pack_block(np.append(even, [60000] * 10))) < len(token_files.pack_block(even)) + 100


def test_token_files(spark):
    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    texts = odd_texts(200, 4)
    rows = [(i * 3 % 211, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (None, "no id", 1), (501, "x", 1), (501, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder, files = token_files.write(docs, definition)
    found = token_files.read_files(spark, folder, files, with_ids=True).collect()
    start = 0
    expected = []
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in found), key=lambda r: r[1]) == expected
    folder, files = token_files.write(docs.limit(0), definition)
    assert token_files.read_files(spark, folder, files).count() == 0


def test_query_op8(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in queries.op8_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 2]
        assert (found[d.doc_id].start, found[d.doc_id].n_tokens, found[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_query_op8_splits_at_added_tokens(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["end<|endoftext|>next", "plain", "<|endoftext|>", None, "", " <|endoftext|> <|endoftext|>\n x", "<|endoftext|", "more plain text", *odd_texts(100, 5)]
    assert library.encode(texts[0], add_special_tokens=False).ids == [437, 50256, 19545]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op8_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_added_tokens_that_are_not_special():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.add_tokens(["foo bar"])
    texts = ["a foo bar b", None, "foo", "foo bar", "x<|endoftext|>foo bar"]
    for special in (False, True):
        library.encode_special_tokens = not special
        ids, offsets = token_files.encode_texts(library.to_str(), pa.array(texts), special)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    """Two words of n letters that sums of powers modulo 2 ** 64 cannot tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_similar_patterns_have_their_own_ids(spark, tokens, public):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [w for n in (8, 64, 256, 512, 1024, 2048, 8192) for w in thue_morse(n)]
    texts += [f"{a} {b}" for a, b in map(thue_morse, (128, 1024, 4096))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in bpe.encode(docs, tokens, decoded=True).collect()}
    assert [(found[i].ids, bytes(found[i].decoded).decode()) for i in range(len(texts))] == [(public.encode_ordinary(t), t) for t in texts]
    ids, offsets = token_files.encode_texts(library.to_str(), pa.array(texts), True)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_of_different_bytes_change_nothing(monkeypatch, tokens, public):
    few = textscan.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *args: few(*args) & textscan.U64(63))
    own = bpe.Merger(tokens)
    encoder = bpe.Remembered(own.encode)
    texts = odd_texts(300, 9) + ["the house of the thing and the other thing"] * 3
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [public.encode_ordinary(t) for t in texts]
