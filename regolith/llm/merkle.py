"""Merkle manifests of tables: DuckDB hashes aligned buckets of leaves in the tasks, Spark joins the buckets' roots to one root."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.common import Workspace, join_unique

#: Nodes that one node above stands for.
FAN = 16
#: Levels of a bucket; a bucket has FAN ** LEVELS leaves at most.
LEVELS = 3
BUCKET = FAN**LEVELS
#: Leaves of one DuckDB statement, which bounds a task's memory: whole buckets of about so many together.
AT_ONCE = 2 * BUCKET
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """How a value goes into its row's leaf: `-` for null, else its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row: lowercase hex sha256 of its fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(text: Column) -> Column:
    """text with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def group_key(value: Column) -> Column:
    """A string that orders groups as their values' bytes do, null first, and that is never null."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def positions(rows: DataFrame, order: list[Column], work: Workspace) -> DataFrame:
    """rows, which have a string column `key`, with `at` (long): their place in their key's order, from 0.

    Rows are range-partitioned by key and order, so that a key of any size spans partitions, and numbered within. A partition's first
    key goes on where the partitions before end, which one row for each partition tells; every other key starts there.
    """
    ranged = rows.repartitionByRange(F.col("key"), *order).sortWithinPartitions(F.col("key"), *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    place = rows.columns.index("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(place).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            local = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            if batch.column(place)[0].as_py() == last:
                local[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = batch.column(place)[-1].as_py(), int(local[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])

    ordered = work.staged(ranged.mapInArrow(run, f"{fields}, part int, local long"), "ordered")
    runs = ordered.groupBy("part", "key").agg(F.max("local").alias("last"))
    ends = work.staged(runs.groupBy("part").agg(F.min("key").alias("first"), F.max(F.struct("key", "last")).alias("end")), "ends")
    events = ends.select("part", F.col("end.key").alias("key"), (F.col("end.last") + 1).alias("n"), F.lit(False).alias("asks"))
    events = events.unionByName(ends.select("part", F.col("first").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks")))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    starts = events.withColumn("before", before).where("asks").select("part", F.col("key").alias("first"), F.coalesce("before", F.lit(0)).alias("before"))
    joined = ordered.join(F.broadcast(starts), "part")  # a row for each partition
    at = F.col("local") + F.when(F.col("key") == F.col("first"), F.col("before")).otherwise(0)
    return joined.select(*rows.columns, at.alias("at"))


@functools.cache
def _duck():
    import duckdb

    engine = duckdb.connect()
    for setting in ("threads = 1", "temp_directory = ''", "memory_limit = '800MB'"):
        engine.execute(f"SET {setting}")
    return engine


def _runs_sql() -> str:
    """Common tables: n0, the leaves of buckets k; for each level the runs (what each FAN nodes give, in order) and their digests."""
    out = ["n0 AS (SELECT k, levels, pos, digest FROM leaves)"]
    for level in range(1, LEVELS + 1):
        out.append(f"r{level} AS MATERIALIZED (SELECT k, levels, pos // {FAN} AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM n{level - 1} WHERE levels >= {level} GROUP BY k, levels, pos // {FAN})")
        out.append(f"n{level} AS (SELECT k, levels, pos, sha256(run) AS digest FROM r{level})")
    return "WITH " + ", ".join(out)


def _roots_sql() -> str:
    return f"{_runs_sql()} SELECT digest FROM ({' UNION ALL '.join(f'SELECT k, digest FROM n{level} WHERE levels = {level}' for level in range(LEVELS + 1))}) ORDER BY k"


def _proofs_sql(outer: int) -> str:
    """For each leaf, in order: the digest of all siblings on its way to the root, and what folding them to `start` gives. Digests are of
    64 letters, so a node's siblings are what its run has before and behind it. From step to step a leaf keeps its digest alone; runs
    and ways, which many leaves share, are looked up, so that a statement takes the same memory however high the tree is."""

    def met(level: int, leaves: str) -> str:
        return f" LEFT JOIN r{level} ON r{level}.k = {leaves}.k AND r{level}.pos = {leaves}.pos // {FAN**level}"

    sql, beside, joins = f"{_runs_sql()}, h0 AS (SELECT k, pos, start AS h FROM leaves)", [], ""
    for level in range(1, LEVELS + 1):
        at, run, last = f"64 * (l.pos // {FAN ** (level - 1)} % {FAN})", f"r{level}.run", f"h{level - 1}"
        before, behind = f"substr({run}, 1, {at})", f"substr({run}, {at} + 65)"
        beside.append(f"coalesce({before} || {behind}, '')")
        joins += met(level, "l")
        sql += f", h{level} AS MATERIALIZED (SELECT l.k, l.pos, CASE WHEN {run} IS NULL THEN h ELSE sha256({before} || h || {behind}) END AS h FROM {last} l{met(level, 'l')})"
    for j in range(1, outer + 1):
        last = f"h{LEVELS + j - 1}"
        sql += f", h{LEVELS + j} AS MATERIALIZED (SELECT l.k, l.pos, CASE WHEN len(lefts) < {j} THEN h ELSE sha256(lefts[{j}] || h || rights[{j}]) END AS h FROM {last} l JOIN outers o ON o.k = l.k)"
    sql += f", proofs AS MATERIALIZED (SELECT l.k, l.pos, sha256({' || '.join(beside)} || o.beyond) AS proof FROM leaves l{joins} JOIN outers o ON o.k = l.k)"
    return f"{sql} SELECT proof, h AS folded FROM proofs JOIN h{LEVELS + outer} AS last ON last.k = proofs.k AND last.pos = proofs.pos ORDER BY proofs.k, proofs.pos"


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive buckets of about AT_ONCE leaves together, one at least."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + AT_ONCE, "right")))
        yield start, stop
        start = stop


def _leaves(rows: pa.ListArray, numbers: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The leaves of some buckets as a table, and how many each has. A bucket that is not its group's first has all LEVELS levels,
    and a first one as many as its own leaves need."""
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    ends = np.cumsum(lengths)
    pos = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    needed = sum((lengths > FAN**level).astype(np.int32) for level in range(LEVELS))
    levels = np.where(numbers > 0, LEVELS, needed)
    digest, changed = flat.field("leaf"), flat.field("changed")
    table = {"k": np.repeat(np.arange(len(lengths)), lengths), "levels": np.repeat(levels, lengths), "pos": pos, "digest": digest, "start": pc.coalesce(changed, digest)}
    return pa.table(table), lengths


def _bucket_roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in _groups(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)):
            own = batch.slice(start, stop - start)
            engine = _duck()
            engine.register("leaves", _leaves(own.column(2), own.column(1).to_numpy())[0])
            roots = engine.sql(_roots_sql()).to_arrow_table().column(0).combine_chunks()
            engine.unregister("leaves")
            yield pa.RecordBatch.from_arrays([*own.columns, roots.cast(pa.string())], names=["key", "bucket", "rows", "digest"])


def _proofs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: rows, bucket, subroot, root, lefts, rights."""
    for batch in batches:
        for start, stop in _groups(pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)):
            own = batch.slice(start, stop - start)
            rows, lefts, rights = own.column(0), own.column(4), own.column(5)
            table, lengths = _leaves(rows, own.column(1).to_numpy())
            beyond = ["".join(a + b for a, b in zip(x, y, strict=True)) for x, y in zip(lefts.to_pylist(), rights.to_pylist(), strict=True)]
            most = pc.max(pc.list_value_length(lefts)).as_py()
            engine = _duck()
            engine.register("leaves", table)
            engine.register("outers", pa.table({"k": np.arange(len(rows)), "lefts": lefts, "rights": rights, "beyond": pa.array(beyond, pa.string())}))
            found = engine.sql(_proofs_sql(most)).to_arrow_table().combine_chunks()
            engine.unregister("leaves")
            engine.unregister("outers")
            flat, which = rows.flatten(), pa.array(np.repeat(np.arange(len(rows)), lengths))
            proof, folded = (found.column(name).chunk(0).cast(pa.string()) for name in ("proof", "folded"))
            yield pa.RecordBatch.from_arrays(
                [flat.field("id"), flat.field("leaf"), own.column(2).take(which), own.column(3).take(which), proof, folded], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            )


@dataclass
class Tree:
    """Runs of nodes level by level (key, idx of the run, digests: its nodes' digests) and the tops (key, digest, level)."""

    levels: list[DataFrame]
    tops: DataFrame


def tree(nodes: DataFrame, most: int, work: Workspace) -> Tree:
    """nodes: key, idx, digest and many (the number of nodes of the key), of which `most` is the largest. Each FAN consecutive nodes give
    one; a key whose nodes have come down to one is done."""
    level, levels, tops, depth = nodes, [], [], 0
    while True:
        tops.append(level.where("many = 1").select("key", "digest", F.lit(depth).alias("level")))
        if most <= 1:
            return Tree(levels, functools.reduce(DataFrame.unionByName, tops))
        runs = level.where("many > 1").groupBy("key", F.expr(f"idx div {FAN}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.max("many").alias("many"))
        runs = work.staged(runs.select("key", "idx", F.col("run.digest").alias("digests"), F.expr(f"(many + {FAN - 1}) div {FAN}").alias("many")), "runs")
        levels.append(runs)
        level = runs.select("key", "idx", F.sha2(F.array_join("digests", ""), 256).alias("digest"), "many")
        most, depth = -(-most // FAN), depth + 1


def ways(found: Tree, tops: DataFrame) -> DataFrame:
    """The way up from each lowest node: its key and idx, and of each level the siblings before (lefts) and behind (rights).

    tops: a row for each key with level, lefts and rights (the way that its top goes on) and whatever else its nodes get. Ways are made
    from the top down, a run at a time, so that each row meets one row."""
    more = [c for c in tops.columns if c not in ("key", "level", "lefts", "rights")]
    known = None
    for depth in range(len(found.levels), -1, -1):
        own = tops.where(F.col("level") == depth).select("key", F.lit(0).cast("long").alias("idx"), "lefts", "rights", *more)
        if known is not None:
            runs = known.join(found.levels[depth].select("key", "idx", "digests"), ["key", "idx"])
            each = runs.select("key", F.col("idx").alias("_run"), "digests", "lefts", "rights", *more, F.posexplode("digests").alias("_at", "_digest"))
            left, right = F.array_join(F.slice("digests", F.lit(1), F.col("_at")), ""), F.array_join(F.slice("digests", F.col("_at") + 2, F.lit(FAN)), "")
            below = each.select("key", (F.col("_run") * FAN + F.col("_at")).alias("idx"), F.concat(F.array(left), F.col("lefts")).alias("lefts"), F.concat(F.array(right), F.col("rights")).alias("rights"), *more)
            own = own.unionByName(below)
        known = own
    return known


def manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, changed: Column | None = None, workspace: Workspace | None = None) -> DataFrame:
    """The Merkle tree of a table, and the proof of each row.

    A row's leaf is the digest of `columns`. Leaves of one value of group_col ascend by id_col; each FAN consecutive nodes become the
    digest of theirs, level by level, until one remains, the group's subroot; subroots, by group (null first, by the bytes of its text),
    become the root in the same way. changed: what a row's leaf seems to be now (null: what it was), for which the proof is folded.

    Leaves are made where the texts are read, and only they move on. A group of any size is dealt out by ranges and numbered; aligned
    buckets of BUCKET leaves go to tasks as one row each, where DuckDB runs the level queries; their roots, a row for each bucket, meet
    in groups of FAN in Spark, and the ways up are joined back from the top down, one bucket to one way.

    Returns id_col, leaf, subroot, root, proof_sha256 (the digest of all siblings up to the root, level by level, left to right; of the
    empty string where there is none), folded_root (the root that `changed` leads to) and verified (whether it is the root). Null ids
    come first; rows of one id in one group are in the order of their leaves; an empty table has no rows; other columns do not pass,
    and a column of any name may be hashed. The result reads tables in the workspace (a folder of its own by default).
    """
    spark = docs.sparkSession
    work = workspace or Workspace(spark, "merkle")
    digest = leaf(*[F.col(c) for c in columns])
    rows = docs.select(group_key(F.col(group_col)).alias("key"), F.col(id_col).alias("id"), digest.alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    placed = positions(work.staged(rows, "leaves"), [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("changed")], work)
    parts = F.sort_array(F.collect_list(F.struct("at", "id", "leaf", "changed")))
    bucketed = placed.groupBy("key", F.expr(f"at div {BUCKET}").alias("bucket")).agg(parts.alias("rows"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key string, bucket long, rows array<struct<at: bigint, id: {kind}, leaf: string, changed: string>>, digest string"
    buckets = work.staged(bucketed.mapInArrow(_bucket_roots, schema), "buckets")
    work.remove("leaves", "ordered")
    sizes = work.staged(buckets.groupBy("key").agg(F.count("*").alias("many")), "sizes")
    most = sizes.agg(F.max("many")).first()[0] or 0
    hot = sizes.where(F.col("many") > max(5000, (sizes.agg(F.sum("many")).first()[0] or 0) / 1000)).select("key")
    nodes = join_unique(buckets.select("key", F.col("bucket").alias("idx"), "digest"), sizes, ["key"], hot)
    inner = tree(nodes, most, work)
    subroots = work.staged(inner.tops, "subroots")
    n_groups = sizes.count()
    top = positions(subroots.select(F.lit("=").alias("key"), F.col("key").alias("group"), "digest", "level"), [F.col("group")], work)
    top = work.staged(top.select("key", "group", F.col("at").alias("idx"), "digest", "level"), "top")
    outer = tree(top.select("key", "idx", "digest", F.lit(n_groups).cast("long").alias("many")), n_groups, work)
    root = outer.tops.select("digest").first()
    none = F.array().cast("array<string>")
    up = ways(outer, outer.tops.select("key", "level", none.alias("lefts"), none.alias("rights")))
    starts = top.join(up.select("idx", "lefts", "rights"), "idx").select(F.col("group").alias("key"), "level", "lefts", "rights", F.col("digest").alias("subroot"))
    up = work.staged(ways(inner, work.staged(starts, "starts")), "ways")
    joined = buckets.select("key", F.col("bucket").alias("idx"), "rows").join(up, ["key", "idx"])
    given = joined.select("rows", "idx", "subroot", F.lit(root[0] if root else "").alias("root"), "lefts", "rights")
    found = given.mapInArrow(_proofs, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
