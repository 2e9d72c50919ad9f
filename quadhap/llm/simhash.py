"""Near-duplicates by SimHash fingerprints, linked through a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two embeddings never exceeds the number of differing bits, so a range join of
radius 4 under it loses no link. The grid of that join is laid over projections: a distance
of 4 touches at most 4 of 7 bands of segments, so on some 3 bands the two embeddings are
equal; cells are the 35 choices of 3 bands with their bit counts. The grid alone carries the bound: the
Manhattan distance itself is not computed again for the pairs of a cell, because the exact
distance of two fingerprints costs no more. Inside a cell, distances are verified on the fingerprints themselves.

Copies fold into one fingerprint first. Cells with more than ``dense`` fingerprints are
divided by a coarse grid over the bit counts of the two halves (cells of side 5, each
fingerprint also sent to its forward neighbours), so no cell has to be finished by one task.
A cell gives only links that join what is not joined yet, never all its pairs.

Defined cases: null and empty texts and texts of white space have fingerprint zero, which is
linked like any other; a null id gets a component like any other row, and is the component
only if no row of it has an id; repeated rows come back row by row; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.llm.common import cut_lineage
from quadhap.llm.components import components

WORDS = 4
SEED = 42
BITS = 4
BANDS = 7
DENSE = 4096
_PIECE = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the shingles' XXH64."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower and bytes.split are ASCII's
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = starts + sizes - 1
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _PIECE], last[at : at + _PIECE])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: fingerprints as signed 64-bit numbers."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits each."""
    upper, even = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    one, two = fp.bitwiseXOR(upper).bitwiseAND(even), fp.bitwiseAND(upper).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(two, 1))


def band_masks(bands: int = BANDS, differing: int = BITS) -> list[int]:
    """Masks over the embedding for every choice of bands that ``differing`` differences must leave alone, as signed numbers."""
    edges = [2 * (32 * i // bands) for i in range(bands + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = (sum(one[i] for i in pick) for pick in combinations(range(bands), bands - differing))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cell_links(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one cell as far as they are linked in it: a breadth-first search that compares each with those not reached yet."""
    open_, out = fps, []
    while len(open_) > 1:
        reached, open_ = [open_[0]], open_[1:]
        while reached and len(open_):
            x = reached.pop()
            near = np.bitwise_count(open_ ^ x) <= bits
            if near.any():
                reached.extend(open_[near])
                out += [(int(x), int(y)) for y in open_[near]]
                open_ = open_[~near]
    return out


def _links(batches, bits: int):
    """Links of the cells of a partition, whose rows come sorted by cell. Small cells are compared all at once, by distance in the sorted order."""
    small = 48
    held: list[np.ndarray] = []

    def solve(cells: np.ndarray, fps: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.append(starts, len(cells)))
        found: list[np.ndarray] = []
        left = np.repeat(sizes, sizes) - (np.arange(len(cells)) - np.repeat(starts, sizes)) - 1  # rows of the cell behind each row
        left[np.repeat(sizes, sizes) > small] = 0
        at, lag = np.flatnonzero(left > 0), 1
        while len(at):
            near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= bits
            if near.any():
                found.append(np.stack([fps[at[near]], fps[at[near] + lag]], axis=1))
            lag += 1
            at = at[left[at] >= lag]
        for i in np.flatnonzero(sizes > small):
            pairs = cell_links(np.unique(fps[starts[i] : starts[i] + sizes[i]]), bits)
            if pairs:
                found.append(np.array(pairs, np.uint64))
        if found:
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].view(np.int64)) for i in (0, 1)], ["a", "b"])

    for b in batches:
        cells, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if not len(cells):
            continue
        held.append((cells, fps))
        if cells[0] != cells[-1] or held[0][0][0] != cells[0]:
            cells, fps = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            cut = int(np.flatnonzero(cells != cells[-1])[-1]) + 1  # the last cell may go on
            yield from solve(cells[:cut], fps[:cut])
            held = [(cells[cut:], fps[cut:])]
    if held:
        yield from solve(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))


def links(fps: DataFrame, bits: int = BITS, dense: int = DENSE) -> DataFrame:
    """``a, b``: links between the distinct fingerprints of ``fps`` (column fp) that connect all within ``bits`` differing bits."""
    v = embedding(F.col("fp"))
    keys = F.array(*(F.xxhash64(F.lit(i), v.bitwiseAND(F.lit(m))) for i, m in enumerate(band_masks(differing=bits))))
    rows = fps.select("fp", F.explode(keys).alias("cell"))
    hot = cut_lineage(rows.groupBy("cell").count().where(F.col("count") > dense).select("cell", F.lit(True).alias("hot")))
    if not hot.isEmpty():
        half = lambda mask: F.floor(F.bit_count(F.col("fp").bitwiseAND(F.lit(mask))) / 5)
        low, high = half(0xFFFFFFFF), half(-0x100000000)
        around = F.array(*(F.xxhash64("cell", low + a, high + b) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))))
        rows = rows.join(hot, "cell", "left").select("fp", F.explode(F.when(F.col("hot"), around).otherwise(F.array("cell"))).alias("cell"))
    dealt = rows.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, bits), "a bigint, b bigint").distinct()


def classes(fingerprinted: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for rows ``doc_id, fp``."""
    marked = cut_lineage(fingerprinted)
    least = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(components(links(least)))
    joined = least.join(roots, least["fp"] == roots["node"]).select("fp", "root", "least")
    smallest = cut_lineage(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = joined.join(smallest, "root").select("fp", "component_id")
    of_fp = cut_lineage(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every whole text; the component is the smallest id reachable over links."""
    found = classes(fingerprints(docs))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a near-duplicate of smaller id. Rows of one id are one document and stay or go together; rows without an id stay."""
    found = classes(fingerprints(docs))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone_id"], "left_anti")
    return kept
