"""Statistics of documents, counted in numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from regolith.llm.textscan import U64, buffer_of, gram_hashes, mix, span_hashes, word_spans

#: Words in a window that counts as a repeat when found again.
WINDOW = 8
_STEP = U64(0x9E3779B97F4A7C15)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _flags(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT, _LOUD, _STOP = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(b"0123456789"), _flags(b"!?"), _flags(b".")
#: Fixed: bytes that start a character of a word: not blanks, nor those that continue a character in UTF-8.
_WORD_POINTS = ~_flags(bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]))


def _repeated(windows: np.ndarray) -> int:
    """The words in windows (hashes, one for each first word) that are found twice or more."""
    own = np.sort(windows)
    again = own[1:][own[1:] == own[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(again[np.minimum(np.searchsorted(again, windows), len(again) - 1)] == windows)
    edges = np.bincount(at, minlength=len(windows) + WINDOW) - np.bincount(at + WINDOW, minlength=len(windows) + WINDOW + 1)[: len(windows) + WINDOW]
    return int(np.count_nonzero(np.cumsum(edges)))


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text, as int64; a null text counts as empty.

    n_words (runs of other than U+0020 and U+0009-U+000D), word_chars (code points in them), n_symbols (of #*$%&|<>), n_lines,
    n_dup_lines (lines with a word that equal an earlier line of the text), n_repeat_words (words in windows of WINDOW words
    that the text holds twice or more, the first included), n_distinct_words, and n_upper, n_lower, n_digits, n_loud (!?),
    n_stops (full stops) of ASCII.
    """
    data, places = buffer_of(texts)
    n = len(places) - 1

    some = np.flatnonzero(np.diff(places))

    def summed(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(n, np.int64)
        if len(some):
            sums[some] = np.add.reduceat(flags, places[some], dtype=np.int64)
        return sums

    starts, ends, first = word_spans(data, places)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": summed(_WORD_POINTS[data]), "n_symbols": summed(_SYMBOLS[data])}

    breaks = np.flatnonzero(data == 10)
    n_lines = np.diff(np.searchsorted(breaks, places)) + 1
    begin, stop = np.sort(np.concatenate([places[:-1], breaks + 1])), np.sort(np.concatenate([breaks, places[1:]]))
    of = np.repeat(np.arange(n), n_lines)
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    keys = mix(span_hashes(data, begin, stop) + of.astype(U64) * _STEP)
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    out |= {"n_lines": n_lines, "n_dup_lines": np.bincount(of[again & worded], minlength=n)}

    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, tuple(range(WINDOW)))
    out |= {"n_distinct_words": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(words[a:b])
            out["n_distinct_words"][i] = 1 + np.count_nonzero(own[1:] != own[:-1])
        if b > a + WINDOW:
            out["n_repeat_words"][i] = _repeated(grams[a : b - WINDOW + 1])
    for name, flags in (("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_loud", _LOUD), ("n_stops", _STOP)):
        out[name] = summed(flags[data])
    return out


#: The features of a document that classifiers see, each free of its length but for the first.
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "loud", "stops", "line_words")


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text."""
    c = {k: v.astype(float) for k, v in counts.items()}
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_distinct_words"] / words,
            c["n_upper"] / letters,
            c["n_digits"] / chars,
            c["n_loud"] / words,
            c["n_stops"] / words,
            np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
        ]
    )
