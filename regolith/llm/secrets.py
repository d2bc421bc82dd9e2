"""Secrets in texts: fixed patterns, and windows of high entropy."""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import slices

#: Fixed: the kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: Fixed: patterns of the base kinds.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes, narrowest first: name, pattern of the whole candidate, characters in a window, least entropy in bits.
#: 20 random base-64 characters have about 4.1 bits, 20 letters of a compound word about 3.2.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), 20, math.inf),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, 2.9),
    ("letters", re.compile(r"[A-Za-z]+"), 20, 3.85),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.7),
)
#: Within a candidate of a wider class, runs of hex digits that are not all decimal have their own least entropy.
HEX_RUN = re.compile(r"(?![0-9]+(?![0-9a-fA-F]))[0-9a-fA-F]{20,}")
#: Alphabets and digits in order: no window that overlaps one counts.
SEQUENCE = re.compile(r"(?i:abcdefghijkl|0123456789|qwertyuiop)")
#: What is never a secret though it looks random: UUIDs, words and paths without digits, identifiers of short words between
#: dashes or slashes.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[A-Z]?[a-z]+"),
    re.compile(r"[A-Z]+"),
    re.compile(r"(?:[A-Za-z]{1,15}[0-9]{0,4}|[0-9]{1,4})(?:[-_/+=]+(?:[A-Za-z]{1,15}[0-9]{0,4}|[0-9]{1,4}))+"),
)


def _plogs(window: int) -> list[float]:
    return [0.0] + [n * math.log2(n) for n in range(1, window + 1)]


def high_entropy(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """The unions of overlapping windows with at least so many bits of Shannon entropy. Each step of the window changes two
    characters' counts, and with them the sum of n log n."""
    logs, counts, total = _plogs(window), {}, 0.0
    out: list[tuple[int, int]] = []
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        counts[char] = n + 1
        if i >= window:
            old = text[i - window]
            m = counts[old]
            if old == char:
                counts[old] = m - 1
                m = n = 0
            else:
                counts[old] = m - 1
                total += logs[m - 1] - logs[m] + logs[n + 1] - logs[n]
        else:
            total += logs[n + 1] - logs[n]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = out[-1][0], i + 1
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """The unions of overlapping windows of a candidate that have the least entropy of its class or, in a run of hex digits, of
    that class, and overlap no sequence."""
    name, window, least = next((n, w, bits) for n, p, w, bits in CLASSES if p.fullmatch(candidate))
    hex_window, hex_least = next((w, bits) for n, _, w, bits in CLASSES if n == "hex")
    cuts = [0, *itertools.chain.from_iterable(m.span() for m in SEQUENCE.finditer(candidate)), len(candidate)]
    spans = []
    for begin, end in zip(cuts[::2], cuts[1::2], strict=True):
        part = candidate[begin:end]
        spans += [(begin + a, begin + b) for a, b in high_entropy(part, window, least)]
        if name == "base64":
            for m in HEX_RUN.finditer(part):
                spans += [(begin + m.start() + a, begin + m.start() + b) for a, b in high_entropy(m[0], hex_window, hex_least)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end) in code points, end exclusive, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    # A place lies in a base span if, of the spans that start no later, one ends no earlier.
    base = sorted((a, b) for _, a, b in found)
    begins, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max, initial=-1))
    for m in CANDIDATE.finditer(text):
        own = m[0]
        if any(p.fullmatch(own) for p in ALLOWED):
            continue
        for a, b in entropy_spans(own):
            a, b = a + m.start(), b + m.start()
            if reach[bisect_right(begins, a)] < b:
                found.append(("entropy", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets in every whole text: id_col and spans, an array of (kind, start, end) in code points, end exclusive, by start
    and then kind.

    assign, access and hex are the fixed patterns' leftmost matches that do not overlap. entropy: in strings of 20 and more
    letters, digits and +/_=-, the windows whose Shannon entropy is high for the string's character class or for that of the run of
    hex digits that they lie in, unless the string is on the allow list, the window overlaps an alphabet or digits in order, or a
    fixed pattern has found the place.

    A row for each row of docs, repeated rows too; null and empty texts have no spans; null ids stay null; other columns do not pass.
    Long texts are searched whole, in time that grows with their length, with their spans beside them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["id", "spans"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)
