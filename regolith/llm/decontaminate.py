"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import slices
from regolith.llm.textscan import U64, HashTable, buffer_of, gram_hashes, letter_spans, span_hashes

#: Places of a seed's words behind its first one: three in a row, or one left out, which an edit of every third word leaves whole.
SEEDS = ((0, 1, 2), (0, 1, 3))
#: Seeds of items of one and of two words: the whole item.
SHORT_SEEDS = ((0,), (0, 1))
#: Least information of a seed by its words' frequencies in the corpus, in bits; below that it is too common to look up.
LEAST_BITS = 22.0
#: Of an item's seeds of each form the rarest share that is looked up in any case.
KEPT_SEEDS = 0.25
#: Seeds of more items do not tell items apart: they are looked up once for all items that share the same words in the same places.
MOST_ITEMS = 16
#: Stands for an item's own words where only those that it shares count; no word has this hash but by chance.
OWN_WORD = U64(0)
#: Alignment scores; an item aligned word for word has MATCH for each of its words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score of a leak, as a share of the item's highest.
LEAST_SCORE = 0.45
#: Benchmark words that go out to the tasks at once; a larger benchmark is searched in so many parts.
WORDS_AT_ONCE = 4_000_000


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case, and for each text the number of its first word (with the total last)."""
    data, places = buffer_of(pc.utf8_lower(texts))
    starts, ends, first = letter_spans(data, places)
    return span_hashes(data, starts, ends), first


def _grams(words: np.ndarray, first: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams within one text, and the place of each one's first word."""
    hashes = gram_hashes(words, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(hashes)] == text[offsets[-1] :])
    return hashes[at], at


@dataclass(eq=False)
class Items:
    """Benchmark items and behind them classes of items: ids (of a class its smallest), members (1 for an item), words with where each
    one's start, and the seeds: gram hash, item or class, place in it. forms: which grams of a document can be seeds. of: each item's
    class (its number among all), -1 for none."""

    ids: np.ndarray
    members: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    forms: tuple[tuple[int, ...], ...]
    of: np.ndarray


def vocabulary_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How often the corpus has each word of the vocabulary (distinct hashes, in order), and the number of all its words. One scan
    for each WORDS_AT_ONCE words of the vocabulary."""
    out, total = np.zeros(len(vocabulary), np.int64), 0
    for start in range(0, len(vocabulary), WORDS_AT_ONCE):
        sent = docs.sparkSession.sparkContext.broadcast(vocabulary[start : start + WORDS_AT_ONCE])

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = HashTable(len(sent.value))
            table.put(sent.value, np.arange(len(sent.value), dtype=np.int32))
            counts = np.zeros(len(sent.value) + 1, np.int64)
            for batch in slices(batches, "text"):
                words, _ = word_hashes(batch.column(0))
                counts += np.bincount(table.get(words) + 1, minlength=len(counts))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(counts[some])], names=["word", "n"])

        got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        word, n = (np.array(got.column(c).to_pylist(), np.int64) for c in ("word", "n"))
        out[start + word[word >= 0]] = n[word >= 0]
        total = int(n.sum())
    return out, total


def _alone(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which items are the first ones of their words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(words[a:b].tobytes(), i) == i for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))], bool)


def _chosen(gram: np.ndarray, worth: np.ndarray, own: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Of the grams of each `own` the rarest `quota` of them, and all with LEAST_BITS."""
    order = np.lexsort((-worth, own))
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
    return np.flatnonzero((rank < quota) | (worth >= LEAST_BITS))


def prepare(items: pa.Table, vocabulary: np.ndarray, counts: np.ndarray, total: int, least_score: float = LEAST_SCORE) -> Items:
    """The seeds of benchmark items (item_id, text, in order of item_id), chosen by how rare their words are in the corpus, by the
    counts of a vocabulary that holds them. Of items of the same words the first one counts.

    A gram of at most MOST_ITEMS items is a seed of each. A more common one covers its words in the items that hold it: items with
    the same covered words in the same places are a class, whose words are the covered ones, with OWN_WORD between, and whose seeds
    are the common grams. What a class's words score is the least that each member scores. Classes whose covered words are too few
    to reach least_score are left out, as they cannot."""
    words, first = word_hashes(items.column("text").combine_chunks())
    size, alone = np.diff(first), _alone(words, first)
    bits = -np.log2((counts[np.searchsorted(vocabulary, words)] + 1) / (total + len(vocabulary) + 1))
    forms = [f for n, f in enumerate(SHORT_SEEDS, 1) if (size == n).any()] + list(SEEDS)
    grams, places, worth = [], [], []
    for form in forms:
        hashes, at = _grams(words, first, form)
        of = np.searchsorted(first, at, "right") - 1
        use = alone[of] & ((size[of] == len(form)) | (form in SEEDS))
        grams.append(hashes[use])
        places.append(at[use])
        worth.append(sum(bits[at[use] + k] for k in form))
    form = np.repeat(np.arange(len(forms)), [len(g) for g in grams])
    gram, at, worth = np.concatenate(grams), np.concatenate(places), np.concatenate(worth)
    item = np.searchsorted(first, at, "right") - 1
    _, back = np.unique(gram, return_inverse=True)
    one = np.unique(np.column_stack([back, item]), axis=0)[:, 0] if len(item) else back
    common = np.bincount(one, minlength=1)[back] > MOST_ITEMS
    # Classes: the shared words of each item, and which items have the same ones.
    covered = np.zeros(len(words), bool)
    for n, offsets in enumerate(forms):
        for k in offsets:
            covered[at[common & (form == n)] + k] = True
    shared = np.where(covered, words, OWN_WORD)
    classes: dict[bytes, list[int]] = {}
    of = np.full(len(size), -1, np.int64)
    for i in np.unique(item[common]).tolist():
        if covered[first[i] : first[i + 1]].sum() >= least_score * size[i]:
            classes.setdefault(shared[first[i] : first[i + 1]].tobytes(), []).append(i)
    heads = np.array([own[0] for own in classes.values()], np.int64)
    for number, own in enumerate(classes.values()):
        of[own] = len(size) + number
    head = np.full(len(size), -1, np.int64)
    head[heads] = of[heads]
    quota = np.ceil(KEPT_SEEDS * np.bincount(item * len(forms) + form, minlength=len(size) * len(forms)))
    own = item * len(forms) + form
    alone_rows, class_rows = np.flatnonzero(~common), np.flatnonzero(common & (head[item] >= 0))
    kept = [some[_chosen(gram[some], worth[some], own[some], quota[own[some]])] for some in (alone_rows, class_rows)]
    rows = np.concatenate(kept)
    whose = np.concatenate([item[kept[0]], head[item[kept[1]]]])
    place = at[rows] - first[item[rows]]
    order = np.argsort(gram[rows], kind="stable")
    ids = np.array(items.column("item_id").to_pylist(), np.int64)
    lengths = np.concatenate([size, size[heads]])
    every = np.concatenate([words, *[shared[first[i] : first[i + 1]] for i in heads.tolist()]])
    members = np.concatenate([np.ones(len(size), np.int64), np.array([len(own) for own in classes.values()], np.int64)])
    return Items(np.concatenate([ids, ids[heads]]), members, every, np.concatenate([[0], np.cumsum(lengths)]), gram[rows][order], whose[order], place[order], tuple(forms), of)


def align(window: np.ndarray, length: np.ndarray, item: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best local alignment score of each row of windows with its item (hashes of words, padded; their true lengths).

    All rows go together, an item's word each step. Within a step, a gap in the item reaches from any earlier place of the
    window, which a running maximum gives.
    """
    rows, width = window.shape
    inside = np.arange(width) < length[:, None]
    slope = -GAP * np.arange(1, width + 1)
    before = np.zeros((rows, width + 1), np.int32)
    best = np.zeros(rows, np.int32)
    for k in range(item.shape[1]):
        score = np.where((window == item[:, k, None]) & inside, MATCH, MISMATCH)
        here = np.maximum(np.maximum(before[:, :-1] + score, before[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        here[~inside] = 0
        active = k < size
        before[active, 1:] = here[active]
        best[active] = np.maximum(best[active], here[active].max(1, initial=0))
    return best


def search(texts: pa.Array, items: Items, table: HashTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' number, the item's number, the best score as a share of the highest, and the number of seeds found, for each
    text and item that share a seed. table: each seed's first row among the seeds, which are in order."""
    words, first = word_hashes(texts)
    rows, places = [], []
    for form in items.forms:
        grams, at = _grams(words, first, form)
        found = table.get(grams)
        rows.append(found[found >= 0].astype(np.int64))
        places.append(at[found >= 0])
    row, at = np.concatenate(rows), np.concatenate(places)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    copies = np.searchsorted(items.seeds, items.seeds[row], "right") - row
    from_ = np.repeat(row - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
    at = np.repeat(at, copies)
    item = items.item[from_]
    text = np.searchsorted(first, at, "right") - 1
    sizes = np.diff(items.first)[item]
    slack = sizes // 2 + 4
    start = np.maximum(first[text], at - items.place[from_] - slack)
    stop = np.minimum(first[text + 1], at - items.place[from_] + sizes + slack)
    order = np.lexsort((start, item, text))
    text, item, start, stop = text[order], item[order], start[order], stop[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    # Windows of one text and item that overlap are one.
    pair = np.cumsum(new) - 1
    reach = np.maximum.accumulate(stop + pair * (len(words) + 1)) - pair * (len(words) + 1)
    new[1:] |= start[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    ends = np.append(begin[1:], len(new))
    a, b, seeds = start[begin], reach[ends - 1], ends - begin
    text, item = text[begin], item[begin]
    length, size = b - a, np.diff(items.first)[item]
    score = np.zeros(len(text))
    by_width = np.argsort(length, kind="stable")
    done = 0
    while done < len(by_width):
        width = int(length[by_width[done]])
        some = by_width[done : done + max(1, 100_000 // max(1, int(length[by_width[min(len(by_width) - 1, done + 63)]])))][:256]
        width, tall = int(length[some].max()), int(size[some].max())
        windows = words[np.minimum(a[some, None] + np.arange(width), len(words) - 1)]
        wanted = items.words[np.minimum(items.first[item[some]][:, None] + np.arange(tall), len(items.words) - 1)]
        score[some] = align(windows, length[some], wanted, size[some]) / (MATCH * size[some])
        done += len(some)
    return text, item, score, seeds


@functools.lru_cache(2)
def _seed_table(items: Items) -> HashTable:
    table = HashTable(len(items.seeds))
    keys, rows = np.unique(items.seeds, return_index=True)
    table.put(keys, rows.astype(np.int32))
    return table


def _parts(benchmark: DataFrame, item_col: str) -> tuple[int, Callable[[int], pa.Table]]:
    """In how many parts a benchmark is searched, and what gives each; items of the same words are in one part."""
    known = benchmark.where(F.col("text").isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), "text")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(size // (5 * WORDS_AT_ONCE)) + 1
    bare = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\p{M}]+", " "))
    return parts, lambda number: known.where(F.pmod(F.xxhash64(bare), F.lit(parts)) == number).toArrow().sort_by("item_id")


def classes(benchmark: DataFrame, least_score: float = LEAST_SCORE, item_col: str = "item_id") -> DataFrame:
    """Which class of leaks() each item is in: item_col and class_id, the smallest id of the class; a row for each item in a class."""
    parts, part = _parts(benchmark, item_col)
    found = []
    for number in range(parts):
        own = part(number)
        if own.num_rows:
            words = np.unique(word_hashes(own.column("text").combine_chunks())[0])
            items = prepare(own, words, np.zeros(len(words), np.int64), 0, least_score)
            some = np.flatnonzero(items.of >= 0)
            found += zip(items.ids[some].tolist(), items.ids[items.of[some]].tolist(), strict=True)
    return benchmark.sparkSession.createDataFrame(found, f"{item_col} long, class_id long")


def leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Which documents hold which benchmark items, as they are or edited: id_col, item_col, score (share of the highest alignment
    score), n_seeds and n_items, a row for each document and item, or class of items, with a score of at least `least_score`.

    Words are runs of letters and digits, in lower case; in scripts without blanks between words each character is one. Seeds are
    grams of three words (SEEDS) that are rare by their words' frequencies in all documents; a leak does
    not make its own words common enough to lose its seeds, and the rarest share of every item's seeds is kept in any case. An
    item of one or two words is its own seed, so it is found word for word. Where a document has an item's seed, the words around
    it are aligned with the whole item (Smith-Waterman). The benchmark goes out to the tasks in parts of WORDS_AT_ONCE words, so no
    document is shuffled.

    Items of a template share seeds that do not tell them apart. Such seeds are looked up once for a class of items, which have the
    same shared words in the same places, and those words are aligned once: where they reach least_score, each of the class does,
    and one row has the class's smallest id, its score by the shared words and its number of items in n_items (classes() tells which
    items they are). Seeds with an item's own words find it besides, with n_items 1; where both fall on one id the row has the higher
    score and the class's n_items. Items of the same words are one: it has the smallest of their ids. Null texts and items, and items without words, have no leak; null ids are reported as null; of
    repeated rows the best score counts; an empty table gives no rows; other columns do not pass. A text is held whole in its
    task, with about 20 times its bytes beside it.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, score double, n_seeds long, n_items long"
    parts, part = _parts(benchmark, item_col)
    vocabulary = np.zeros(0, U64)
    for number in range(parts):
        vocabulary = np.union1d(vocabulary, word_hashes(part(number).column("text").combine_chunks())[0])
    counts, total = vocabulary_counts(docs, vocabulary, text_col)
    found = []
    for number in range(parts):
        own = part(number)
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast(prepare(own, vocabulary, counts, total, least_score))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in slices(batches, "text"):
                text, item, score, seeds = search(batch.column(1), items, _seed_table(items))
                good = score >= least_score
                values = [batch.column(0).take(pa.array(text[good])), *[pa.array(x[good]) for x in (items.ids[item], score, seeds, items.members[item])]]
                yield pa.RecordBatch.from_arrays(values, names=["id", "item_id", "score", "n_seeds", "n_items"])

        found.append(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    both = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    best = both.groupBy("id", "item_id").agg(F.max("score").alias("score"), F.sum("n_seeds").alias("n_seeds"), F.max("n_items").alias("n_items"))
    return best.withColumnsRenamed({"id": id_col, "item_id": item_col})
