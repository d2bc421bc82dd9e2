"""BPE by words: a minimal acyclic transducer of frequent words, and exact merges for the others."""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import struct
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.bpe import PIECE, Merger, as_lists
from regolith.llm.common import Workspace, slices
from regolith.llm.textscan import _PARTS_WORDS, NUMBER, SPACE, HashTable, _byte_classes, _classes, _lowered, buffer_of, ragged, span_hashes, spans_outside
from regolith.llm.token_files import _byte_letters, _opened

#: A word that makes up over one in so many of all words is frequent, so there are at most so many frequent words.
FREQUENT = 1 << 19
#: Longer words, in bytes, have no place in the lexicon.
LONGEST_WORD = 64
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
MAGIC = b"LEXICON1"
_HEAD = struct.Struct("<8s4Q")  # magic, edges, states, words, ids


class Lexicon:
    """Words and their ids as a minimal acyclic automaton whose edges carry numbers: those on a word's path add up to the word's
    number in the order of bytes, and the number finds its ids. Words that end alike share the states of their ends."""

    NAMES = ("keys", "targets", "outputs", "final", "offsets", "ids")
    KINDS = ("<i8", "<i4", "<i4", "u1", "<i4", "<i4")

    def __init__(self, buffer):
        magic, edges, states, words, n_ids = _HEAD.unpack_from(buffer, 0)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        at = _HEAD.size
        for name, kind, n in zip(self.NAMES, self.KINDS, (edges, edges, edges, states, words + 1, n_ids), strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.words = words

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> bytes:
        """The file of these words, which ascend and are distinct."""
        known: dict[tuple, int] = {}  # states that will not change, by what can follow them
        edges: list[tuple[tuple[int, int], ...]] = []
        finals: list[bool] = []
        path: list[list] = [[False, []]]  # of the word before: whether it may end here, and the edges so far

        def settled(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(edges)
                edges.append(key[1])
                finals.append(node[0])
            return known[key]

        before = b""
        for word in words:
            same = next((k for k, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
            while len(path) - 1 > same:
                node = path.pop()
                path[-1][1].append((before[len(path) - 1], settled(node)))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            before = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settled(node)))
        root = settled(path[0])
        # States are settled after those that they lead to, so the words behind each state are known in this order.
        behind, keys, targets, outputs = [], [], [], []
        last = len(edges) - 1
        for state, (own, final) in enumerate(zip(edges, finals, strict=True)):
            n = int(final)
            for byte, target in own:
                keys.append((last - state << 8) | byte)
                targets.append(last - target)
                outputs.append(n)
                n += behind[target]
            behind.append(n)
        assert root == last and behind[root] == len(words)
        order = np.argsort(np.array(keys, np.int64))
        arrays = [np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(outputs, np.int64)[order], np.array(finals[::-1], bool)]
        arrays += [np.cumsum([0, *map(len, ids)]), np.array([x for own in ids for x in own], np.int64)]
        head = _HEAD.pack(MAGIC, len(keys), len(finals), len(words), len(arrays[-1]))
        return head + b"".join(a.astype(kind).tobytes() for a, kind in zip(arrays, Lexicon.KINDS, strict=True))

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each span that is a word, -1 for the others; all spans take a step at a time."""
        out = np.full(len(starts), -1, np.int64)
        open_ = np.flatnonzero(lengths <= LONGEST_WORD)
        if not len(self.keys) or not len(open_):
            return out
        at, left, state, number = starts[open_], lengths[open_], np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        while len(open_):
            over = left == 0
            if over.any():
                ends = over & (self.final[state] == 1)
                out[open_[ends]] = number[ends]
                open_, at, left, state, number = (x[~over] for x in (open_, at, left, state, number))
                continue
            key = (state << 8) | data[at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            real = self.keys[edge] == key
            edge = edge[real]
            open_, at, left = open_[real], at[real] + 1, left[real] - 1
            state, number = self.targets[edge].astype(np.int64), number[real] + self.outputs[edge]
        return out


@functools.cache
def mapped(path: str) -> Lexicon:
    """The lexicon in this file, which all processes of a machine that open it share."""
    with open(path, "rb") as file:
        return Lexicon(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


class WordMerger(Merger):
    """Ids of words, given as symbols: a byte, or a byte and 256 where it is the word's last."""

    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        vocabulary, end, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.single = np.array([vocabulary[letters[b] + tail] for tail in ("", end) for b in range(256)], np.int32)
        made = []
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made.append((vocabulary[left], vocabulary[right], vocabulary[left + right], k))
        table = np.array(made, np.int64).reshape(-1, 4)
        if (np.diff(table[:, 2]) <= 0).any():
            raise ValueError("the ids of merged tokens are not in the order of the merges")
        self.pairs = HashTable(len(table))
        self.pairs.put(self._key(table[:, 0], table[:, 1]), table[:, 2].astype(np.int32))

    def _tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return np.full(len(starts), -1, np.int32)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, none of which is empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int16)
        ends = np.cumsum(lengths)
        symbols[ends - 1] += 256
        ids, counts = self.encode(symbols, ends - lengths, lengths, np.zeros(len(words), np.uint64))
        stops = np.cumsum(counts).tolist()
        return [ids[stop - n : stop].tolist() for stop, n in zip(stops, counts.tolist(), strict=True)]


@functools.cache
def _steady() -> np.ndarray:
    """1 for each code point that no neighbour and no normal form changes and that has one lower-case letter of its own class."""
    kinds, table = _classes(), np.zeros(0x110000, np.uint8)
    seconds = set(range(0x1161, 0x1200))  # fixed: the letters that Hangul syllables are composed with
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c) in ("Cn", "Cs") or unicodedata.combining(c) or point in seconds or not unicodedata.is_normalized("NFC", c):
            continue
        low = c.lower()
        table[point] = len(low) == 1 and kinds[ord(low)] == kinds[point]
    return table


def words_of(data: np.ndarray, places: np.ndarray, opens: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts: bytes with A-Z in lower case, starts, ends, whether a word is a whole run between blanks, and for each
    text the number of its first word (with the total last).

    Words are contractions, runs of letters, single numbers and runs of other signs. A run between blanks with a code point that is
    not steady, or with one of `opens` (how added tokens begin), is one word with its case kept.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, bool), np.zeros(len(places), np.int64)
    low = _lowered()[data]
    kind = _byte_classes(low, _classes())
    size = len(data)
    begin = np.zeros(size + 1, bool)
    begin[places[:-1]] = True
    begin = begin[:size]
    begin[1:] |= kind[1:] != kind[:-1]
    begin |= (kind == NUMBER) & ((low & 0xC0) != 0x80)
    quotes = np.flatnonzero((low == 0x27) & begin)
    if len(quotes):
        stops = places[np.searchsorted(places, quotes, "right")]
        padded = np.concatenate([low, np.zeros(3, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quotes + 1 < stops)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (quotes + 2 < stops)
        for found, letters in ((quotes[short], 1), (quotes[long], 2)):
            begin[found + 1] = False
            over = found + 1 + letters
            begin[over[over < size]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], size)
    real = kind[starts] != SPACE
    starts, ends = starts[real], ends[real]
    odd = _byte_classes(data, _steady()) == 0
    for mark in opens:
        here = data[: size - len(mark) + 1] == mark[0]
        for k in range(1, len(mark)):
            here = here & (data[k : size - len(mark) + 1 + k] == mark[k])
        odd[np.flatnonzero(here)] = True
    bad = np.flatnonzero(odd)
    whole = np.zeros(len(starts), bool)
    if len(bad):
        first, last, _ = spans_outside(_PARTS_WORDS, data, places)
        runs = np.unique(np.searchsorted(first, bad, "right") - 1)
        taken = np.zeros(len(first), bool)
        taken[runs] = True
        own = np.searchsorted(first, starts, "right") - 1
        stay = ~taken[own]
        starts, ends = np.concatenate([starts[stay], first[runs]]), np.concatenate([ends[stay], last[runs]])
        order = np.argsort(starts, kind="stable")
        whole = np.repeat([False, True], [int(stay.sum()), len(runs)])[order]
        starts, ends = starts[order], ends[order]
        raw = ragged(first[runs], last[runs] - first[runs])
        low[raw] = data[raw]
    return low, starts, ends, whole, np.searchsorted(starts, places)


class Speller:
    """Ids of distinct words without a lexicon, exactly as the library gives them."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Lowercase

        self.library, self.lower, self.merger = Tokenizer.from_str(definition), Lowercase(), WordMerger(definition)
        self.library.no_padding()
        self.library.no_truncation()
        self.opens = tuple({t["content"].encode()[:2] for t in json.loads(definition).get("added_tokens") or []})

    def ids(self, words: list[bytes], whole: np.ndarray) -> list[list[int]]:
        """whole: which words are runs between blanks, that the library normalises and splits."""
        out: list[list[int]] = [[]] * len(words)
        plain = np.flatnonzero(~whole).tolist()
        if plain:
            texts = [words[k] for k in plain]
            if not all(t.isascii() for t in texts):
                texts = self.lower.normalize_str(b"\n".join(texts).decode()).encode().split(b"\n")
            for k, found in zip(plain, self.merger.merge(texts), strict=True):
                out[k] = found
        rest = np.flatnonzero(whole).tolist()
        for k, found in zip(rest, self.library.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out


@functools.cache
def speller(definition: str) -> Speller:
    return Speller(definition)


def check(definition: str) -> None:
    """Raises where the tokenizer is not one that words_of() splits as the library does."""
    parsed = json.loads(definition)
    steps = [s["type"] for s in (parsed["normalizer"] or {}).get("normalizers", [])]
    splits = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed by the tokenizer's kind
    split = splits[0].get("pattern", {}).get("Regex") == pattern and splits[0].get("invert") and splits[0].get("behavior") == "Removed"
    model = parsed["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
    if steps != ["NFC", "Replace", "Lowercase"] or not split or not plain or parsed["decoder"] or not model["end_of_word_suffix"]:
        raise ValueError("not a word BPE tokenizer of the kind that this operator encodes")


def _tallied(words: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})


def word_counts(docs: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """Each distinct word (binary, of at most LONGEST_WORD bytes) of the whole texts and its number, counted in the tasks first."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = speller(sent.value), {}
        for batch in slices(batches, "text"):
            for data, places in _pieces(batch.column(0)):
                low, starts, ends, _, _ = words_of(data, places, own.opens)
                short = ends - starts <= LONGEST_WORD
                starts, ends = starts[short], ends[short]
                first, n = np.unique(span_hashes(low, starts, ends), return_index=True, return_counts=True)[1:]
                raw = low.tobytes()
                for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    word = raw[a:b]
                    counts[word] = counts.get(word, 0) + k
            if len(counts) > COUNTED:
                yield _tallied(counts)
                counts = {}
        if counts:
            yield _tallied(counts)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and bounds of texts; a long text goes alone, in pieces that end at blanks."""
    data, places = buffer_of(texts)
    if np.diff(places).max(initial=0) <= 2 * PIECE:
        yield data, places
        return
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        cuts = [a, *_blanks(data, a, b), b]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield data[start:stop], np.array([0, stop - start])


def _blanks(data: np.ndarray, start: int, stop: int) -> Iterator[int]:
    """Places of blanks within the text, PIECE bytes apart or more."""
    at = start + PIECE
    while at < stop:
        near = np.flatnonzero(_PARTS_WORDS[data[at : min(at + PIECE, stop)]])
        if not len(near):
            at += PIECE
            continue
        yield at + int(near[0])
        at += int(near[0]) + PIECE


@dataclass
class Shipped:
    """A lexicon on its way to the tasks: its file's name among those that Spark sends, its words and states."""

    file: str
    words: int
    states: int


def lexicon(docs: DataFrame, definition: str, text_col: str = "text", frequent: int = FREQUENT, workspace: Workspace | None = None) -> Shipped:
    """Compiles the words that make up over one in `frequent` of all words of docs, with the ids that each has.

    There are less than `frequent` such words of at most LONGEST_WORD bytes, which bounds what comes to the driver and the file; the
    file is written to the workspace and sent to each executor once, where its Python workers map it. It only makes encoding faster:
    ids do not depend on it, so an empty table's empty lexicon serves any texts.
    """
    check(definition)
    spark = docs.sparkSession
    work = workspace or Workspace(spark, "lexicon")
    counts = work.staged(word_counts(docs, definition, text_col), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = sorted(bytes(r.word) for r in counts.where(F.col("n") > total / frequent).select("word").toLocalIterator())
    work.remove("words")
    own = speller(definition)
    whole = np.array([_is_whole(w, own.opens) for w in words], bool)
    data = Lexicon.build(words, own.ids(words, whole))
    store, top = _opened(work.path)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{top}/{name}") as out:
        out.write(data)
    spark.sparkContext.addFile(f"{work.path}/{name}")
    return Shipped(name, len(words), len(Lexicon(data).final))


def _is_whole(word: bytes, opens: tuple[bytes, ...]) -> bool:
    data = np.frombuffer(word, np.uint8)
    return bool(words_of(data, np.array([0, len(data)]), opens)[3].any())


class Encoder:
    """Ids of whole texts by a lexicon and, for what it lacks, a speller."""

    def __init__(self, book: Lexicon, own: Speller):
        self.book, self.own = book, own
        counts = np.diff(book.offsets)
        self.starts, self.counts = book.offsets[:-1], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each text start (with the total last)."""
        data, places = buffer_of(texts)
        if np.diff(places).max(initial=0) <= 2 * PIECE:
            return self._encode(data, places)
        found, offsets = [], [0]
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            cuts = [a, *_blanks(data, a, b), b]
            own = [self._encode(data[x:y], np.array([0, y - x]))[0] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            found += own
            offsets.append(offsets[-1] + sum(map(len, own)))
        return np.concatenate(found), np.array(offsets)

    def _encode(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, starts, ends, whole, first = words_of(data, places, self.own.opens)
        number = self.book.find(low, starts, ends - starts)
        counts = np.zeros(len(starts), np.int64)
        met = np.flatnonzero(number >= 0)
        counts[met] = self.counts[number[met]]
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = low.tobytes()
            spans = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            distinct = {w: k for k, w in enumerate(dict.fromkeys(spans))}
            which = np.array([distinct[w] for w in spans])
            kind = np.zeros(len(distinct), bool)
            kind[which] = whole[new]
            ids = self.own.ids(list(distinct), kind)
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.array([x for own in ids for x in own], np.int32)
            counts[new] = lengths[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(total[-1]), np.int32)
        out[ragged(total[:-1][met], counts[met])] = self.book.ids[ragged(self.starts[number[met]].astype(np.int64), counts[met])]
        if len(new):
            out[ragged(total[:-1][new], counts[new])] = flat[ragged((np.cumsum(lengths) - lengths)[which], counts[new])]
        return out, total[first]


@functools.cache
def _encoder(definition: str, file: str) -> Encoder:
    return Encoder(mapped(SparkFiles.get(file)), speller(definition))


class Decoder:
    """Texts of ids: the tokens as the vocabulary writes them, with a blank between, as the library joins them without a decoder."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        names = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed.get("added_tokens") or []}
        tokens = [names[i].encode() + b" " if i in names else b"" for i in range(max(names) + 1)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one list of ids in UTF-8. Ids that the vocabulary lacks have no token."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        parts = [self.bytes[ragged(self.starts[own], self.lengths[own])].tobytes() for own in (ids[k : k + PIECE] for k in range(0, len(ids), PIECE))]
        return b"".join(parts)[:-1]


@functools.cache
def _decoder(definition: str) -> Decoder:
    return Decoder(definition)


def encode(docs: DataFrame, definition: str, book: Shipped, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, digest: bool = False) -> DataFrame:
    """The ids of every whole text as the tokenizers library gives them without special tokens around a text.

    Blanks (U+0020, U+0009 to U+000D) bound words in any case. Words that are in the lexicon have their ids from it; each other
    distinct word of a batch is merged pair by pair; runs between blanks whose characters could be changed by their neighbours, or
    that may hold an added token, go through the library whole.

    definition: the tokenizer's JSON, a fixed vocabulary of a few MB. book: as lexicon() gives it.
    Returns id_col, ids (array<int>), with decoded also decoded (string: as decode() gives it), with digest also ids_sha256 (lowercase
    hex over the ids as little-endian unsigned 32-bit integers) and, with both, decoded_sha256 instead of decoded. Other columns do not
    pass. One row for each row of docs, repeated rows too; null and empty texts have no ids; null ids stay. A text goes in pieces of
    about 1 MB where it has blanks, with about 20 times a piece beside it, so that its ids are most of what it takes.
    """
    check(definition)
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    kind, file = docs.schema[id_col].dataType.simpleString(), book.file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = _encoder(sent.value, file), _decoder(sent.value)
        for batch in slices(batches, "text"):
            ids, offsets = own.encode(batch.column(1))
            columns = {"id": batch.column(0), "ids": as_lists(ids, offsets)}
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            if decoded and not digest:
                columns["decoded"] = pa.array([words.decode(ids[a:b]).decode() for a, b in bounds], pa.string())
            if digest:
                flat = ids.astype("<u4")
                columns["ids_sha256"] = pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in bounds], pa.string())
                if decoded:
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(words.decode(ids[a:b])).hexdigest() for a, b in bounds], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", decoded string" * (decoded and not digest) + ", ids_sha256 string" * digest + ", decoded_sha256 string" * (decoded and digest)
    return texts.mapInArrow(run, f"id {kind}, ids array<int>{more}").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, definition: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids in column `into`: the tokens with a blank between, added tokens too. A null list has no
    text; ids that are null or that the vocabulary lacks have no token."""
    sent = rows.sparkSession.sparkContext.broadcast(definition)

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        own = _decoder(sent.value)
        return pa.array(["" if x is None else own.decode(np.array([i for i in x if i is not None], np.int64)).decode() for x in lists.to_pylist()], pa.string())

    return rows.withColumn(into, text_of(F.col(ids_col)))
