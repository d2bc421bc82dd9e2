"""Byte-level BPE: ids of whole texts from a rank file, and the bytes of ids."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import slices
from regolith.llm.textscan import U64, HashTable, buffer_of, pretoken_starts, ragged, same_bytes, span_hashes

#: Pretokens whose ids a worker remembers; beyond that it starts anew, which changes no result.
REMEMBERED = 300_000
#: Pretokens of more bytes merge by a heap, since a matrix would take time with the square of their length.
LONGEST_ROW = 512
_NONE = np.int32(2**31 - 1)


@functools.cache
def load_ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a rank file (base64 token and rank on each line) in order of rank; the ranks count from 0."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    found = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in found] != list(range(len(found))):
        raise ValueError("the ranks are not 0, 1, 2, ...")
    return tuple(token for _, token in found)


class Merger:
    """Ids of byte spans. A pair of ids has the rank of the token that their bytes make together, if there is one."""

    def __init__(self, tokens: tuple[bytes, ...]):
        ranks = {token: rank for rank, token in enumerate(tokens)}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        parts = [
            (left, right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        made = np.array(parts or [(0, 0, 0)], np.int64)[: len(parts)]
        self.pairs = HashTable(len(made))
        self.pairs.put(self._key(made[:, 0], made[:, 1]), made[:, 2].astype(np.int32))
        self.ranks = ranks
        self.whole = HashTable(len(tokens))
        keys, first = np.unique(span_hashes(self.bytes, self.starts, self.starts + self.lengths), return_index=True)
        self.whole.put(keys, first.astype(np.int32))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(U64) << U64(32)) | right.astype(U64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE for pairs that make no token and for the padding, which is -1."""
        out = np.full(left.shape, _NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        found = self.pairs.get(self._key(left[real], right[real]))
        out[real] = np.where(found < 0, _NONE, found)
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans, one after another, and the number of ids of each span."""
        whole = self._tokens(data, starts, lengths, hashes)
        counts = np.ones(len(starts), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        open_ = np.flatnonzero(whole < 0)
        for row in open_[lengths[open_] > LONGEST_ROW]:
            ids = self._heap(data[starts[row] : starts[row] + lengths[row]])
            counts[row] = len(ids)
            pieces.append((np.array([row]), ids))
        open_ = open_[lengths[open_] <= LONGEST_ROW]
        width = 2
        while len(open_):
            fits = lengths[open_] <= width
            if fits.any():
                pieces += self._matrix(data, starts, lengths, open_[fits], counts)
                open_ = open_[~fits]
            width += max(2, width // 3)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, ids in pieces:
            out[ragged((ends - counts)[rows], counts[rows])] = ids
        return out, counts

    def _tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The rank of each span that is a token, -1 for the others. A token found by its hash counts only if the bytes agree."""
        found = self.whole.get(hashes)
        hit = np.flatnonzero(found >= 0)
        of = found[hit]
        short = np.minimum(lengths[hit], self.lengths[of])
        same = (self.lengths[of] == lengths[hit]) & same_bytes(data, starts[hit], self.bytes, self.starts[of], short)
        for k in hit[~same].tolist():
            found[k] = self.ranks.get(data[starts[k] : starts[k] + lengths[k]].tobytes(), -1)
        return found

    def _matrix(self, data, starts, lengths, rows, counts) -> list[tuple[np.ndarray, np.ndarray]]:
        """One bucket: a row for each span, padded with -1. Each round merges the leftmost pair of least rank in every row, so
        each row loses one column; rows without such a pair leave the matrix."""
        width = int(lengths[rows].max())
        column = np.arange(width)
        inside = column < lengths[rows, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = self.single[data[ragged(starts[rows], lengths[rows])]]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        done = []
        while len(rows):
            n, width = ids.shape
            if width > 1:
                at = ranks.argmin(1)
                least = ranks[np.arange(n), at]
                over = least == _NONE
            else:
                over = np.ones(n, bool)
            if over.any():
                left = ids[over]
                real = left >= 0
                counts[rows[over]] = real.sum(1)
                done.append((rows[over], left[real]))
                rows, ids = rows[~over], ids[~over]
                if not len(rows):
                    break
                ranks, at, least = ranks[~over], at[~over], least[~over]
                n = len(rows)
            each = np.arange(n)
            ids[each, at] = least
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            if width > 2:
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self._ranks(ids[before, at[before] - 1], ids[before, at[before]])
                behind = np.flatnonzero(at < width - 2)
                ranks[behind, at[behind]] = self._ranks(ids[behind, at[behind]], ids[behind, at[behind] + 1])
        return done

    def _heap(self, span: np.ndarray) -> np.ndarray:
        """The ids of one long span: pairs wait in a heap by rank and place, neighbours are linked."""
        ids = self.single[span].tolist()
        n = len(ids)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self._ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        waiting = [(int(rank), i, ids[i], ids[i + 1]) for i, rank in enumerate(first) if rank != _NONE]
        heapq.heapify(waiting)
        known: dict[tuple[int, int], int] = {}

        def offer(i: int) -> None:
            j = behind[i]
            if j < n:
                pair = ids[i], ids[j]
                if pair not in known:
                    known[pair] = int(self._ranks(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
                if known[pair] != _NONE:
                    heapq.heappush(waiting, (known[pair], i, *pair))

        while waiting:
            rank, i, left, right = heapq.heappop(waiting)
            j = behind[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            behind[i] = behind[j]
            if behind[j] < n:
                before[behind[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each row of ids start (with the total last)."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(int(ends[-1]), np.uint8)
        for k in range(0, len(ids), PIECE):
            own = slice(k, k + PIECE)
            out[ends[k] : ends[min(k + PIECE, len(ids))]] = self.bytes[ragged(self.starts[ids[own]], lengths[own])]
        return out, ends[offsets]


@functools.cache
def merger(tokens: tuple[bytes, ...]) -> Merger:
    return Merger(tokens)


class Remembered:
    """Encodes texts, each distinct pretoken once: `fresh(data, starts, lengths, hashes)` gives the ids of those not met before.

    Pretokens are looked up by hash; one whose bytes are not those that the hash was met with first is encoded by itself.
    """

    def __init__(self, fresh: Callable, spans: Callable = pretoken_starts):
        self.fresh, self.spans = fresh, spans
        self._forget()

    def _forget(self) -> None:
        self.table, self.n = HashTable(1 << 16), 0
        self.ids, self.bytes = _Arena(np.int32), _Arena(np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each text start (with the total last). A long text goes in
        pieces that start where a match starts in any case."""
        data, places = buffer_of(texts)
        long = np.flatnonzero(np.diff(places) > 2 * PIECE)
        if not len(long):
            return self._encode(data, places)
        inner = [cut for k in long.tolist() for cut in _safe_cuts(data, int(places[k]), int(places[k + 1]))]
        cuts = np.sort(np.concatenate([places, np.array(inner, np.int64)]))
        found = [self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        total = np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
        return np.concatenate(found), total[np.searchsorted(cuts, places)]

    def _encode(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = self.spans(data, places)
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        hashes = span_hashes(data, starts, ends)
        if self.n > REMEMBERED:
            self._forget()
        which = self.table.get(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            keys, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[one]
            self.ids.add(*self.fresh(data, starts[at], lengths[at], keys))
            self.bytes.add(data[ragged(starts[at], lengths[at])], lengths[at])
            self.table.put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
            which[new] = self.n + back
            self.n += len(keys)
        known = self.bytes.counts[which]
        same = (known == lengths) & same_bytes(data, starts, self.bytes.values, self.bytes.starts[which], np.minimum(known, lengths))
        counts = self.ids.counts[which]
        other = np.flatnonzero(~same)
        if not len(other):
            total = np.concatenate([[0], np.cumsum(counts)])
            return self.ids.values[ragged(self.ids.starts[which], counts)], total[first]
        own, counts[other] = self.fresh(data, starts[other], lengths[other], hashes[other])
        total = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(total[-1]), np.int32)
        out[ragged(total[:-1][other], counts[other])] = own
        met = np.flatnonzero(same)
        out[ragged(total[:-1][met], counts[met])] = self.ids.values[ragged(self.ids.starts[which[met]], counts[met])]
        return out, total[first]


#: A blank between a word of ASCII and a letter starts a match of the byte-level tokenizers' pattern, whatever stands around them.
_SAFE = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
#: Bytes of a piece, about.
PIECE = 1 << 20


def _safe_cuts(data: np.ndarray, start: int, stop: int) -> Iterator[int]:
    """Places within the text at which it can be cut, about PIECE bytes apart."""
    text = memoryview(np.ascontiguousarray(data[start:stop]))
    at = PIECE
    while found := _SAFE.search(text, at):
        yield start + found.start()
        at = found.start() + PIECE


class _Arena:
    """Lists of values, one after another in an array that grows."""

    def __init__(self, kind: type):
        self.values, self.filled = np.zeros(1 << 16, kind), 0
        self.starts, self.counts, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        def roomy(x: np.ndarray, more: int, used: int) -> np.ndarray:
            return x if used + more <= len(x) else np.concatenate([x, np.zeros(max(more, len(x)), x.dtype)])

        self.values = roomy(self.values, len(values), self.filled)
        self.starts, self.counts = roomy(self.starts, len(counts), self.n), roomy(self.counts, len(counts), self.n)
        self.values[self.filled : self.filled + len(values)] = values
        self.starts[self.n : self.n + len(counts)] = self.filled + np.cumsum(counts) - counts
        self.counts[self.n : self.n + len(counts)] = counts
        self.n, self.filled = self.n + len(counts), self.filled + len(values)


@functools.cache
def _encoder(tokens: tuple[bytes, ...]) -> Remembered:
    return Remembered(merger(tokens).encode)


def as_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def as_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def digests(ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The sha256 (lowercase hex) of each row's ids as decimals joined by commas, made in pieces."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        sha = hashlib.sha256()
        for k in range(a, b, PIECE):
            sha.update(("," * (k > a) + ",".join(map(str, ids[k : min(b, k + PIECE)].tolist()))).encode())
        out.append(sha.hexdigest())
    return out


def encode(docs: DataFrame, tokens: tuple[bytes, ...], id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, digest: bool = False) -> DataFrame:
    """The BPE ids of every whole text.

    Texts are split at the byte-level tokenizers' usual pattern; within a match, each round merges the leftmost pair of least
    rank. A match that is a token itself is that token. No special tokens: their strings are ordinary text.

    tokens: as load_ranks() gives them, a fixed vocabulary of about 1 MB that goes out with the tasks.
    Returns id_col and ids (array<int>), with decoded also the ids' bytes (binary), with digest also ids_sha256 (as digests() gives it);
    other columns do not pass. One row for each
    row of docs, repeated rows too; a null or empty text has no ids; a null id stays null; long texts are encoded whole, with about 15
    times their bytes beside them (a text of 50 MB within 1 GB), one without blanks with 35 times.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own = _encoder(sent.value), merger(sent.value)
        for batch in slices(batches, "text"):
            ids, offsets = encoder.encode(batch.column(1))
            columns = {"id": batch.column(0), "ids": as_lists(ids, offsets)}
            if decoded:
                columns["decoded"] = as_binary(*own.decode(ids, offsets))
            if digest:
                columns["ids_sha256"] = pa.array(digests(ids, offsets), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(run, f"id {kind.simpleString()}, ids array<int>" + ", decoded binary" * decoded + ", ids_sha256 string" * digest)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokens: tuple[bytes, ...], ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the bytes of each list of ids in column `into`; a null list gives no bytes. Ids must be those of the vocabulary."""
    sent = rows.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("binary")
    def bytes_of(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        return as_binary(*merger(sent.value).decode(ids, offsets - offsets[0]))

    return rows.withColumn(into, bytes_of(F.col(ids_col)))
