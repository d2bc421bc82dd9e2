"""Near-duplicate documents: MinHash by one permutation, banded buckets, exact confirmation, connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.bpe import as_lists
from regolith.llm.common import Workspace, hot_keys, join_unique, slices
from regolith.llm.textscan import U64, buffer_of, gram_hashes, mix, span_hashes, word_spans

#: Bands and rows of a band: two sets of similarity 0.8 share no bucket with probability (1 - 0.8 ** 5) ** 32, about 3e-6.
BANDS, ROWS = 32, 5
#: Candidate centres that a set is first confirmed with.
CENTRES = 2
#: Buckets of more sets are searched block by block; smaller ones pair by pair.
SMALL_BUCKET = 64
#: Shingles in a block, about.
BLOCK_SHINGLES = 40_000
#: Classes, buckets and centres of more rows can be hot; the rows of stars are so short that they may be ten times as many.
HOT_ROWS = 500
_STEP = U64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of so many words (A-Z in lower case); of a text with fewer
    words the one shingle of all of them; of a text without words none."""
    data, places = buffer_of(texts)
    starts, ends, first = word_spans(data, places)
    hashes = span_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(hashes, tuple(range(words)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield gram_hashes(hashes[a:b], tuple(range(b - a)))
        else:
            yield np.zeros(0, U64)


@functools.cache
def _donors(bins: int) -> np.ndarray:
    """For each bin an own random order of all bins, in which an empty one looks for the value it takes over."""
    return np.argsort(mix(np.arange(1, bins * bins + 1, dtype=U64)).reshape(bins, bins), axis=1).astype(np.int16)


def signature(own: np.ndarray, bins: int) -> np.ndarray:
    """The least hash in each of `bins` ranges of hashes. An empty bin takes the value of the first filled bin in its own
    random order, so that two sets' bins agree with their similarity as probability, empty or not (optimal densification)."""
    at = (((own >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)
    first = np.ones(len(own), bool)
    first[1:] = at[1:] != at[:-1]
    out, filled = np.zeros(bins, U64), np.zeros(bins, bool)
    out[at[first]], filled[at[first]] = own[first], True
    empty = np.flatnonzero(~filled)
    order, done = _donors(bins), 0
    while len(empty):
        look = order[empty, done : done + 16]
        hit = filled[look]
        found = hit.any(1)
        out[empty[found]] = out[look[found, hit[found].argmax(1)]]
        empty, done = empty[~found], done + 16
    return out


@functools.cache
def _band_factors(bands: int, rows: int) -> np.ndarray:
    return mix(np.arange(1, bands * rows + 1, dtype=U64)).reshape(bands, rows) | U64(1)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc, n (set size), fp1 and fp2 (128-bit fingerprint of the set), bands (the bucket's key in each band)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, prints, keys = [], [], []
            for own in shingle_sets(batch.column(1), words):
                sizes.append(len(own))
                prints.append((mix(own + _STEP).sum(dtype=U64), mix(own ^ _STEP).sum(dtype=U64)))
                if len(own):
                    banded = (signature(own, bands * rows).reshape(bands, rows) * _band_factors(bands, rows)).sum(1, dtype=U64)
                    keys.append(mix(banded + np.arange(bands, dtype=U64)))
                else:
                    keys.append(np.zeros(0, U64))
            both = np.array(prints, U64).view(np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), as_lists(np.concatenate(keys).view(np.int64), ends)],
                names=["doc", "n", "fp1", "fp2", "bands"],
            )

    return docs.mapInArrow(run, "doc long, n long, fp1 long, fp2 long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc and own (array<long>: the hashes of its shingles)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(shingle_sets(batch.column(1), words))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(np.concatenate(found).view(np.int64), ends)], names=["doc", "own"])

    return docs.mapInArrow(run, "doc long, own array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. The rows of a hot a are split by salt."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    degree = F.broadcast(counts.join(F.broadcast(hot_keys(counts, ["a"], least=HOT_ROWS)), "a", "left_semi").select("a", F.ceil(F.col("n") / 1000).cast("int").alias("salts")))
    left = pairs.join(degree, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    with_b = left.join(sets.select(F.col("doc").alias("b"), F.col("own").alias("own_b")), "b")
    centres = sets.select(F.col("doc").alias("a"), F.col("own").alias("own_a")).join(degree, "a", "left")
    centres = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return with_b.join(centres, ["a", "salt"]).where(shared * 100 >= percent * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b").distinct()


def components(edges: DataFrame, work: Workspace, name: str = "star") -> DataFrame:
    """doc and component (the smallest id reachable) of each node of the edges (a, b). Alternates large stars and small stars,
    each written to the shared folder under `name`, until nothing changes."""

    def star(now: DataFrame, large: bool) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now
        least = work.staged(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")), f"{name}-least")
        hot = hot_keys(least, ["a"])
        met = both.join(least, "a") if hot.isEmpty() else join_unique(both, least, ["a"], hot)
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        else:
            out = met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        new = work.staged(out.where("a <> b").distinct(), name)
        work.remove(name, but=1)
        work.remove(f"{name}-least")
        return new

    def digest(now: DataFrame):
        return now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = work.staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = digest(now)
    while before[0]:
        now = star(star(now, True), False)
        after = digest(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("doc"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct())


def _pairs_in_small(mixed: DataFrame) -> DataFrame:
    """The pairs of different groups in small buckets, each with one set outside its bucket's main group."""
    left = mixed.select("bucket", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = mixed.select("bucket", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    return left.join(right, "bucket").where("a < b AND la <> lb").select("a", "b", "na", "nb")


def _links_in_large(mixed: DataFrame, sets: DataFrame, hot: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The links of sets outside their large bucket's main group with that bucket's other groups. A bucket's sets are dealt to
    blocks by hash, about BLOCK_SHINGLES in each; each pair of blocks is a row, and its sets are compared in the task. The sets
    outside the main group go to every block of their bucket, so the pairs of one bucket are spread over as many keys."""
    total = mixed.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = join_unique(mixed, total, ["bucket"], hot).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    full = dealt.join(sets, "doc")
    one = F.struct("doc", "label", "own")
    blocks = work.staged(full.groupBy("bucket", "block").agg(F.collect_list(one).alias("all")), "blocks")
    main = mixed.select("bucket", "main").distinct().join(total, "bucket")
    some = blocks.join(main, "bucket").withColumn("some", F.expr("filter(all, x -> x.label <> main)")).where(F.size("some") > 0)
    rest = some.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "some")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some, all_ = batch.column(0)[row].values, batch.column(1)[row].values
                docs, labels = (all_.field(k).to_numpy(zero_copy_only=False) for k in ("doc", "label"))
                lists = all_.field("own")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(lists.offsets.to_numpy())
                begins = np.cumsum(sizes) - sizes
                a, b = [], []
                for doc, label, own in zip(some.field("doc").to_pylist(), some.field("label").to_pylist(), some.field("own"), strict=True):
                    own = np.sort(own.values.to_numpy(zero_copy_only=False))
                    at = np.minimum(own.searchsorted(flat), len(own) - 1)
                    shared = np.add.reduceat((own[at] == flat).astype(np.int64), begins)
                    linked = (100 * shared >= percent * (len(own) + sizes - shared)) & (labels != label)
                    a += [doc] * int(linked.sum())
                    b += docs[linked].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rest.join(blocks, ["bucket", "block"]).select("some", "all").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, workspace: Workspace | None = None) -> DataFrame:
    """Groups of documents linked by similar sets of shingles.

    A document's set: its distinct shingles of so many words (runs of other than U+0020 and U+0009-U+000D, A-Z in lower case);
    of a text with fewer words the one shingle of all of them; of a null text or one without words empty, and linked with
    nothing. Two documents are linked if 100 * intersection >= percent * union.

    1. Documents of one set are a class; its smallest id stands for it. 2. Classes are put in buckets by the bands of their
    MinHash (one permutation, optimal densification). 3. Each class meets the smallest member of its buckets (stars, so at most
    one pair for each class and bucket), at most CENTRES of them, on the full sets. 4. In buckets where more than one group is
    left, all pairs across groups are confirmed on the full sets, in blocks where the bucket is large, so no link in a bucket
    is lost. 5. Components of the links. Groups of any size are split over tasks, and each step starts from a written table.

    Returns id_col, n_shingles, component_id (the smallest id reachable, itself included) and kept (id = component_id), a row
    for each row of docs. Rows of one id are one document, linked by any of its texts. A null id is in no group: component_id
    is null and it is kept. Other columns do not pass. A text is held whole in its task, with about 20 times its bytes beside
    it. The result reads tables in `workspace` (a folder of its own by default), which its caller may remove afterwards.
    """
    work = workspace or Workspace(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = work.staged(_signed(texts, words, bands, rows), "signatures")
    sound = signed.where("doc IS NOT NULL AND n > 0")
    classes = work.staged(sound.groupBy("fp1", "fp2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    hot = work.staged(hot_keys(classes, ["fp1", "fp2"], "copies", HOT_ROWS), "hot-classes")
    reps = signed.join(classes.select("fp1", "fp2", F.col("rep").alias("doc")), ["fp1", "fp2", "doc"], "left_semi").select("doc", "n", F.explode("bands").alias("bucket"))
    buckets = work.staged(reps.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc").alias("centre")).where("size > 1"), "buckets")
    hot_buckets = work.staged(hot_keys(buckets.select("bucket", F.col("size").alias("n")), ["bucket"], least=HOT_ROWS), "hot-buckets")
    members = work.staged(join_unique(reps, buckets, ["bucket"], hot_buckets), "members")

    met = members.where("doc <> centre").groupBy(F.col("centre").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("together"))
    best = Window.partitionBy("b").orderBy(F.desc("together"), "a")
    stars = work.staged(met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= CENTRES).select("a", "b"), "stars")
    needed = members.select("doc").distinct()
    sets = work.staged(_sets(texts.join(needed, "doc", "left_semi"), words), "sets")
    links = work.staged(_confirmed(stars, sets, percent), "links")

    label = components(links, work)
    labelled = members.join(label, "doc", "left").select("bucket", "size", "doc", "n", F.coalesce("component", "doc").alias("label"))
    groups = labelled.groupBy("bucket", "label").agg(F.count("*").alias("own"))
    mains = groups.groupBy("bucket").agg(F.max(F.struct("own", "label")).alias("top"), F.count("*").alias("groups")).where("groups > 1").select("bucket", F.col("top.label").alias("main"))
    mixed = work.staged(join_unique(labelled, mains, ["bucket"], hot_buckets), "mixed")
    fits = f"100 * least(na, nb) >= {int(percent)} * greatest(na, nb)"
    pairs = _pairs_in_small(mixed.where(F.col("size") <= SMALL_BUCKET)).where(fits).select("a", "b").distinct()
    pairs = work.staged(pairs.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    more = _confirmed(pairs, sets, percent).unionByName(_links_in_large(mixed.where(F.col("size") > SMALL_BUCKET), sets, hot_buckets, percent, work))
    more = work.staged(more, "more-links")
    # A component's links are as good as its nodes' links with its smallest one, and need fewer rounds.
    known = label.where("doc <> component").select(F.col("doc").alias("a"), F.col("component").alias("b"))
    final = label if more.isEmpty() else components(known.unionByName(more), work, "last-star")

    work.remove("buckets", "hot-buckets", "members", "stars", "sets", "links", "mixed", "pairs", "blocks", "more-links")
    named = classes.join(final.withColumnRenamed("doc", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    grouped = join_unique(sound.select("doc", "n", "fp1", "fp2"), named, ["fp1", "fp2"], hot).select("doc", "n", "component_id")
    alone = signed.where("doc IS NULL OR n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return grouped.unionByName(alone).select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept")
    )
