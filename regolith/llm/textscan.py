"""Numpy scans over the UTF-8 bytes of many texts at once: word and pretoken bounds, and hashes of byte spans."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash

from regolith.llm.common import offsets_of

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)

#: Fixed: bytes that part words, U+0020 and U+0009 to U+000D.
_PARTS_WORDS = np.zeros(256, bool)
_PARTS_WORDS[[0x20, *range(0x09, 0x0E)]] = True

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Fixed: code points with Unicode's White_Space property.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its texts in them; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    places = offsets_of(column)
    data = column.buffers()[2]
    first, last = int(places[0]), int(places[-1])
    if data is None or last == first:
        return np.zeros(0, np.uint8), places - first
    return np.frombuffer(data, np.uint8)[first:last], places - first


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Bits of the first k bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Spans of more bytes are hashed one by one by xxhash, shorter ones together in steps of eight bytes.
_LONG = 256
#: Spans that arrays are made for at a time, so that one long text needs little memory beside its own arrays.
_AT_ONCE = 1 << 18


def eights(data: np.ndarray) -> np.ndarray:
    """For each place of the buffer the eight bytes from there as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each byte span; with lower, A-Z count as a-z.

    Each step takes eight bytes of all spans that have some left and mixes them in, so that no two spans of the same eight
    bytes or fewer collide, and of longer ones none but by chance. Sums of powers, which cost one pass, would give different
    spans of some self-similar patterns one hash.
    """
    if lower:
        data = _lowered()[data]
    words = eights(data)
    out = np.empty(len(starts), U64)
    for first in range(0, len(starts), _AT_ONCE):
        begins, stops, own = starts[first : first + _AT_ONCE], ends[first : first + _AT_ONCE], out[first : first + _AT_ONCE]
        lengths = stops - begins
        own[:] = mix(lengths.astype(U64) + _ODD)
        for k in np.flatnonzero(lengths > _LONG).tolist():
            own[k] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[begins[k] : stops[k]]))
        open_ = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
        at, left = begins[open_], lengths[open_]
        while len(open_):
            own[open_] = mix((own[open_] * _ODD) ^ (words[at] & _FIRST[np.minimum(left, 8)]))
            more = left > 8
            open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each span of data has the bytes of the span of the same length in `other`."""
    out = np.ones(len(starts), bool)
    mine, its = eights(data), eights(other)
    for k in np.flatnonzero(lengths > _LONG).tolist():
        out[k] = np.array_equal(data[starts[k] : starts[k] + lengths[k]], other[others[k] : others[k] + lengths[k]])
    open_ = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
    at, to, left = starts[open_], others[open_], lengths[open_]
    while len(open_):
        same = (mine[at] ^ its[to]) & _FIRST[np.minimum(left, 8)] == 0
        out[open_[~same]] = False
        more = same & (left > 8)
        open_, at, to, left = open_[more], at[more] + 8, to[more] + 8, left[more] - 8
    return out


def gram_hashes(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash for each gram of hashed words, that of the words `offsets` places behind each word; as many as there are whole ones."""
    out = np.full(max(0, len(hashes) - offsets[-1]), len(offsets), U64)
    for first in range(0, len(out), _AT_ONCE):
        own = out[first : first + _AT_ONCE]
        for k in offsets:
            own[:] = mix(own * _ODD + hashes[first + k : first + k + len(own)])
    return out


def word_spans(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text the number of its first word (with the total last)."""
    return spans_outside(_PARTS_WORDS, data, places)


def spans_outside(parts: np.ndarray, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which `parts` is false, and for each text the number of its first run (with the
    total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(places), np.int64)
    inside = ~parts[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    bounds = places[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    begin[bounds] = inside[bounds]
    stop[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, places)


@functools.cache
def _classes() -> np.ndarray:
    """For each code point: LETTER, NUMBER, SPACE or OTHER."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(_WHITE)] = SPACE
    return table


#: Fixed: first and last code points of scripts that put no blank between words: Thai and Lao, Burmese, Khmer, kana, ideographs.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))
PART, JOINED, SINGLE = 0, 1, 2


@functools.cache
def _letter_classes() -> np.ndarray:
    """For each code point: JOINED for letters, numbers and marks, SINGLE for those of scripts without blanks, PART for others."""
    table = np.fromiter((JOINED if unicodedata.category(chr(c))[0] in "LNM" else PART for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in _UNSPACED:
        table[first : last + 1] *= SINGLE
    return table


def letter_spans(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, numbers and marks, each character of a script without blanks being a run of its own;
    and for each text the number of its first run (with the total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(places), np.int64)
    kind = _byte_classes(data, _letter_classes())
    inside = kind != PART
    begin = inside.copy()
    begin[1:] &= kind[1:] != kind[:-1]
    begin |= (kind == SINGLE) & ((data & 0xC0) != 0x80)
    bounds = places[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    begin[bounds] = inside[bounds]
    stop = inside.copy()
    stop[:-1] &= begin[1:] | ~inside[1:]
    stop[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, places)


def _byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to, by a table of code points."""
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        x = data[lead].astype(np.int32)
        more = 1 + (x >= 0xE0) + (x >= 0xF0)
        point = x & np.array([0x1F, 0x0F, 0x07])[more - 1]
        last = len(data) - 1
        for k in (1, 2, 3):
            has = more >= k
            point[has] = (point[has] << 6) | (data[np.minimum(lead[has] + k, last)] & 0x3F)
        found = table[np.minimum(point, 0x10FFFF)]
        kind[lead] = found
        for k in (1, 2, 3):
            has = (more >= k) & (lead + k <= last)
            kind[lead[has] + k] = found[has]
    return kind


def pretoken_starts(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the matches of the byte-level tokenizers' usual pattern (contractions; letters, numbers or other signs with
    one space before them; white space), and for each text the number of its first match (with the total last).

    The matches cover the texts, so that each ends where the next starts. Runs of one class are the matches but for three rules:
    a single U+0020 goes to the run that follows it; of longer white space before a run the last character stands alone or goes
    to that run; a contraction ends after its letters.
    """
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(len(places), np.int64)
    kind = _byte_classes(data, _classes())
    first = np.zeros(size + 1, bool)
    first[places[:-1]] = True
    first = first[:size]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    start = run & white
    begins = np.flatnonzero(run & ~white)
    inner = begins[~first[begins]]
    after = inner[white[inner - 1]]
    if len(after):
        back = after - 1
        for _ in range(3):
            back = back - ((data[back] & 0xC0) == 0x80)
        start[back] = True
    start[begins] = True
    start[after[data[after - 1] == 0x20]] = False
    quotes = np.flatnonzero((data == 0x27) & start)
    if len(quotes):
        stops = places[np.searchsorted(places, quotes, "right")]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quotes + 1 < stops)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (quotes + 2 < stops)
        for found, letters in ((quotes[short], 1), (quotes[long], 2)):
            start[found + 1] = False
            over = found + 1 + letters
            start[over[over < size]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, places)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of every span, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class HashTable:
    """Maps 64-bit keys to int32 by open addressing, for arrays of keys at once. A table over a third full grows."""

    def __init__(self, least: int = 1 << 10):
        self.bits = max(10, (3 * least).bit_length())
        self.n = 0
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.used = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, bool)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those that are not there."""
        at, mask = self._slots(keys), (1 << self.bits) - 1
        found = np.where(self.used[at] & (self.keys[at] == keys), self.values[at], -1)
        open_ = np.flatnonzero((found < 0) & self.used[at] & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            place = at[open_]
            same = self.used[place] & (self.keys[place] == keys[open_])
            found[open_[same]] = self.values[place[same]]
            open_ = open_[self.used[place] & ~same]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys, which are distinct and not there yet."""
        self.n += len(keys)
        if 3 * self.n > 1 << self.bits:
            old = self.used.copy(), self.keys, self.values
            self.bits = (3 * self.n).bit_length() + 1
            self._clear()
            self._place(old[1][old[0]], old[2][old[0]])
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, mask = self._slots(keys), (1 << self.bits) - 1
        left = np.arange(len(keys))
        while len(left):
            free = left[~self.used[at[left]]]
            places, which = np.unique(at[free], return_index=True)
            won = free[which]
            self.used[places], self.keys[places], self.values[places] = True, keys[won], values[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + self.used[at[left]]) & mask
