"""Prefix trie over conversations, with a count-min sketch in front of the exact grouping.

A node is a distinct sequence of first turns. Every turn of every conversation carries the
digest of the prefix that ends with it: a sum of hashes of (position, role, text) along the
conversation, so that prefixes of a long conversation are summed in parts by many tasks.
Equal prefixes have equal digests (two sums of 64-bit hashes).

Tasks count digests in count-min sketches of a fixed size, saturating at two, which are merged
block by block. Estimates are never too low, so an estimate of one proves a prefix that no
other conversation has: its node and those below it are a tail and leave from where they are.
Only prefixes that may be shared are shuffled and grouped exactly. A sketch that is too small
for the input sends more prefixes there, but changes no result.

Sums over subtrees (leaves, saved bytes) follow by doubling: in round k every node adds the sums
of the nodes 2**k levels below. That takes as many rounds as the depth has binary digits, on one
row per node. The ids of conversations that end at a node are written out in sorted slices
by many tasks; one task per node only hashes the slices.

Defined cases: turns are ordered by number, null first, equal numbers by role and text; null
roles and texts are empty; repeated rows are turns of their own; rows without a conv_id belong
to no conversation and are left out; an empty table has no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.llm.common import cut_lineage
from quadhap.operators.ranking import running_sums

ROWS = 3
#: Sketch cells per row, as a power of two: enough for four times the prefixes, within these bounds.
LEAST_BITS, MOST_BITS = 16, 25
_BLOCK = 1 << 15
_RUN = 4096
#: Ids in one slice of a node's list.
SLICE = 1 << 16


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, bytes``: position from 1, two hashes of role and text, UTF-8 length of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / _RUN), F.lit(-(1 << 62)))
    placed = running_sums(rows, ["conv_id"], part, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], {"pos": F.lit(1)})
    return placed.select("conv_id", "pos", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "text", "role").alias("t2"), F.octet_length("text").cast("bigint").alias("bytes"))


def lengths(turns: DataFrame) -> DataFrame:
    """``conv_id, len`` of every conversation."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("len"))


def regrow(turns: DataFrame, family: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first ``head`` turns (at most ``most``) of the conversation whose id is the next lower multiple of ``family`` (towards zero), then the own ones behind the first ``head``.

    Returns the turns and ``conv_id, len`` of all conversations, those without turns included.
    """
    own = lengths(turns).withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = own.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))
    convs = cut_lineage(convs)
    fronts = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "base")
    given = convs.where("given > 0").join(fronts, "base").where("pos <= given").select("conv_id", "pos", "t1", "t2", "bytes")
    kept = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "bytes")
    return given.unionByName(kept), convs.select("conv_id", "len")


def _key(depth: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    wide = [c.cast("decimal(38,0)") for c in (s1, s2)]
    return F.xxhash64(depth, *wide), F.xxhash64(wide[1], depth, wide[0])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, len, bytes, k1, k2, p1, p2``: digests of every prefix and of the one before it."""
    h = {n: F.xxhash64(F.lit(i), "pos", "t1", "t2").cast("decimal(20,0)") for i, n in ((3, "h1"), (4, "h2"))}
    placed = turns.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "bytes", *[c.alias(n) for n, c in h.items()])
    summed = running_sums(placed, ["conv_id"], F.floor(F.col("pos") / _RUN), [F.col("pos")], {"s1": F.col("h1"), "s2": F.col("h2")})
    k1, k2 = _key(F.col("pos"), F.col("s1"), F.col("s2"))
    p1, p2 = _key(F.col("pos") - 1, F.col("s1") - F.col("h1"), F.col("s2") - F.col("h2"))
    return summed.join(convs, "conv_id").select("conv_id", F.col("pos").alias("depth"), "len", "bytes", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))


def cells(k1: np.ndarray, k2: np.ndarray, bits: int) -> list[np.ndarray]:
    """One cell of each sketch row for every digest."""
    x, y = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    return [((x + np.uint64(j) * y) >> np.uint64(64 - bits)).astype(np.int64) for j in range(ROWS)]


def count_min(digests: DataFrame, bits: int) -> np.ndarray:
    """Which cells of the sketch over ``k1, k2`` were met at least twice, packed: ``ROWS`` rows of 2**bits bits."""
    per_row = (1 << bits) // _BLOCK

    def count(batches):
        held = np.zeros((ROWS, 1 << bits), np.uint8)
        for b in batches:
            for row, at in zip(held, cells(*(c.to_numpy() for c in b.columns), bits)):
                cell, n = np.unique(at, return_counts=True)
                row[cell] = np.minimum(row[cell] + np.minimum(n, 2), 2)
        blocks = held.reshape(-1, _BLOCK)
        for block in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "counts": [zlib.compress(blocks[block].tobytes(), 1)]})

    def merge(batches):
        at, held = None, np.zeros(_BLOCK, np.uint8)
        packed = lambda: pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "twice": [np.packbits(held >= 2).tobytes()]})
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != at:
                    if at is not None:
                        yield packed()
                    at, held = block, np.zeros(_BLOCK, np.uint8)
                held = np.minimum(held + np.frombuffer(zlib.decompress(counts), np.uint8), 2)
        if at is not None:
            yield packed()

    parts = digests.select("k1", "k2").mapInArrow(count, "block bigint, counts binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, twice binary")
    twice = np.zeros((ROWS * per_row, _BLOCK // 8), np.uint8)
    for r in merged.toLocalIterator():  # 2**bits * ROWS / 8 bytes at most
        twice[r["block"]] = np.frombuffer(r["twice"], np.uint8)
    return twice.reshape(ROWS, -1)


def screen(digests: DataFrame, bits: int | None = None) -> DataFrame:
    """``may, parent_may`` added: whether the sketch allows that another conversation has the prefix, or the one before it."""
    spark = digests.sparkSession
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (4 * digests.count()).bit_length()))
    sketch = spark.sparkContext.broadcast(count_min(digests, bits))
    names = [*digests.columns, "may", "parent_may"]

    def run(batches):
        twice = sketch.value
        for b in batches:
            col = {n: c for n, c in zip(b.schema.names, b.columns)}
            out = []
            for keys in (("k1", "k2"), ("p1", "p2")):
                may = np.ones(len(b), bool)
                for row, at in zip(twice, cells(*(col[k].to_numpy() for k in keys), bits)):
                    may &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                out.append(may)
            out[1] |= col["depth"].to_numpy() == 1  # the root is everyone's
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], names)

    schema = ", ".join(f"{n} {t}" for n, t in digests.dtypes) + ", may boolean, parent_may boolean"
    return digests.mapInArrow(run, schema)


def ids_sha256(ends: DataFrame, slice_ids: int = SLICE) -> DataFrame:
    """``k1, k2, ends_sha256`` of rows ``k1, k2, conv_id``: hash of each key's ids in ascending order, comma-joined."""

    def write(batches):
        at, held = None, []
        row = lambda: pa.RecordBatch.from_pydict({"k1": [at[0]], "k2": [at[1]], "first": [held[0]], "ids": [",".join(map(str, held))]})
        for b in batches:
            for a, c, i in zip(*(x.to_pylist() for x in b.columns)):
                if (a, c) != at or len(held) >= slice_ids:
                    if held:
                        yield row()
                    at, held = (a, c), []
                held.append(i)
        if held:
            yield row()

    def hash_all(batches):
        at, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"k1": [at[0]], "k2": [at[1]], "ends_sha256": [state.hexdigest()]})
        for b in batches:
            for a, c, ids in zip(*(b.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
                if (a, c) != at:
                    if at is not None:
                        yield row()
                    at, state = (a, c), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if at is not None:
            yield row()

    order = ["k1", "k2", "conv_id"]
    slices = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "k1 bigint, k2 bigint, first bigint, ids string")
    return slices.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hash_all, "k1 bigint, k2 bigint, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``k1, k2`` and each of ``sums`` added up over the node and everything below; ``a1, a2``: the parent's key, null at a top."""
    state = cut_lineage(nodes.select("k1", "k2", "a1", "a2", *sums))
    while state.where("a1 is not null").limit(1).count():
        below = state.where("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        above = state.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        grown = state.join(below, ["k1", "k2"], "left").join(above, ["a1", "a2"], "left")
        state = cut_lineage(grown.select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]))
    return state.drop("a1", "a2")


def trie(turns: DataFrame, convs: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    (conv_id, depth) names a node, so a join with the turns gives its last role and text.
    """
    screened = cut_lineage(screen(cut_lineage(prefixes(turns, convs)), bits))
    shared = screened.where("may and parent_may")
    tails = screened.where("not (may and parent_may)")
    zero = F.lit(0).cast("decimal(38,0)")
    r1, r2 = _key(F.lit(0).cast("bigint"), zero, zero)
    null = F.lit(None).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("len") == 0).alias("n_ends")).where("n_convs > 0").select(
        r1.alias("k1"), r2.alias("k2"), null.alias("p1"), null.alias("p2"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", "n_ends", F.lit(0).cast("bigint").alias("bytes"))
    grouped = shared.groupBy("k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"), F.min("bytes").alias("bytes"))
    nodes = cut_lineage(root.unionByName(grouped))
    # a node below a tail that only looked shared has no parent here and is a tail itself
    children = nodes.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(0).alias("tail")).unionByName(
        tails.where("parent_may").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("tail"))
    ).where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("n_children"), F.sum("tail").cast("bigint").alias("n_tails"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    known = nodes.join(children, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_tails": F.coalesce("n_tails", F.lit(0))})
    known = cut_lineage(known)
    start = known.select(
        "k1", "k2", F.when(F.col("above").isNotNull(), F.col("p1")).alias("a1"), F.when(F.col("above").isNotNull(), F.col("p2")).alias("a2"),
        (F.col("n_tails") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    ends = shared.where("depth = len").select("k1", "k2", "conv_id").unionByName(convs.where("len = 0").select(r1.alias("k1"), r2.alias("k2"), "conv_id"))
    nothing = F.sha2(F.lit(""), 256)
    exact = known.join(subtree_sums(start, ["n_leaves", "saved_tokens"]), ["k1", "k2"]).join(ids_sha256(ends), ["k1", "k2"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    exact = exact.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))).withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    one = F.lit(1).cast("bigint")
    last = F.col("depth") == F.col("len")
    alone = lambda rows, parent: rows.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    inner = alone(tails.where("not parent_may"), F.col("conv_id"))
    entries = alone(tails.where("parent_may").join(parents, ["p1", "p2"], "left"), F.coalesce("above", "conv_id"))
    return exact.select(*columns).unionByName(inner).unionByName(entries)


def spell(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of a trie over whole conversations with the ``role`` and ``text`` of their last turn, null at the root."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / _RUN), F.lit(-(1 << 62)))
    placed = running_sums(rows, ["conv_id"], part, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], {"depth": F.lit(1)})
    return nodes.join(placed.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


# The contract's rebuilt conversations.
FAMILY = 5
HEADS = 9


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie over conversations that begin like the first one of their family, for 0 to 8 turns."""
    turns = hashed_turns(conversations)
    head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("bigint")
    return trie(*regrow(turns, FAMILY, head, HEADS - 1))


def oracle() -> str:
    """The trie in DuckDB: every prefix spelled out, every node joined with all its ancestors."""
    crc = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(cast(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, sha256(concat(length(coalesce(role, '')), ':', role, text)) AS d, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS own, xor({crc}, 4294967295) % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS base FROM t GROUP BY conv_id),
c AS (SELECT n.*, least(n.h, coalesce(b.own, 0)) AS given FROM n LEFT JOIN n b ON n.base = b.conv_id),
r AS (SELECT c.conv_id, pos, d, bytes FROM c JOIN t ON t.conv_id = c.base AND pos <= given UNION ALL SELECT c.conv_id, given + pos - h, d, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, pos AS depth, bytes, list(d) OVER (PARTITION BY conv_id ORDER BY pos) AS path, count(*) OVER (PARTITION BY conv_id) AS len FROM r
  UNION ALL SELECT c.conv_id, 0, 0, []::VARCHAR[], given + greatest(own - h, 0) FROM c),
k AS (SELECT conv_id, depth, bytes, len, md5(array_to_string(path, ',')) AS key, list_transform(range(1, depth + 2), lambda i: md5(array_to_string(path[1:i - 1], ','))) AS up FROM p),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, min(up) AS up, sha256(coalesce(string_agg(CASE WHEN len = depth THEN cast(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM k GROUP BY key, depth),
kids AS (SELECT up[depth] AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, depth)),
over_ AS (SELECT key, depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM (SELECT unnest(up) AS key, unnest(range(0, depth + 1)) AS depth, n_children, n_convs, bytes FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN over_ USING (key, depth) LEFT JOIN nodes a ON f.depth > 0 AND a.key = f.up[f.depth] AND a.depth = f.depth - 1"""
