"""Near-duplicate vectors by int8 tile products with exact error bounds.

Vectors of one label are scaled to length one and to int8 row by row. The product of two int8
rows, times their scales, is off by at most the lengths of their rounding errors, so a pair is
settled from the tile where its bounds lie on one side of the threshold, and computed again in
double precision where they don't.

Equal vectors are folded first. The rest of a label is dealt by hash into slabs of about
``slab`` rows, and slabs into groups; each pair of groups is one tile, so a large label is many
tasks. A label of up to ``slab * LEAST_GROUPS`` vectors has a group per slab; above that, groups
grow to ``MOST_ROWS``, so that each vector is copied once per 65,536 others. A tile returns link
counts and a spanning forest, never its pairs: at most a row for each of its vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing and stay as their own component; rows of one id are
one vector, the usable one that is first by label and components; rows with a null id are left
out; vectors of unequal length do not link; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.llm.common import cut_lineage
from quadhap.llm.components import components
from quadhap.llm.nearest import quantise

THRESHOLD = 0.93
SLAB = 1024
LEAST_GROUPS = 64
MOST_ROWS = 1 << 16


class Forest:
    """Components of the rows of one tile, pairs given batch by batch."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision of the vectors as given."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine but keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def linked(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` with cosine of at least ``threshold``; ``qx, qy``: their unit rows quantised."""
    (qa, sa, ea, _), (qb, sb, eb, _) = qx, qy
    # products of int8 rows stay below 2**14, so float32 adds up to 1024 of them exactly
    kind = np.float32 if qa.shape[1] <= 1024 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    slack = ea[:, None] + (1 + ea)[:, None] * eb[None, :] + 1e-12 * qa.shape[1]
    i, j = np.nonzero(product + slack >= threshold)
    unsure = np.flatnonzero(product[i, j] - slack[i, j] < threshold)
    keep = np.ones(len(i), bool)
    for at in range(0, len(unsure), 1 << 16):
        some = unsure[at : at + (1 << 16)]
        keep[some] = exact_cosine(x[i[some]], y[j[some]]) >= threshold
    return i[keep], j[keep]


def tile_links(ids: list[np.ndarray], slabs: list[np.ndarray], pairs: list[tuple[int, int]], weights: list[np.ndarray], threshold: float):
    """``id, weighted links, root id`` of the vectors that have links, over the given pairs of slabs; a slab with itself counts each pair once."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in slabs])])
    forest, links = Forest(at[-1]), np.zeros(at[-1], np.int64)
    quantised = [quantise(s / np.sqrt(np.einsum("ij,ij->i", s, s))[:, None]) for s in slabs]
    for a, b in pairs:
        i, j = linked(slabs[a], slabs[b], quantised[a], quantised[b], threshold)
        if a == b:
            i, j = i[i < j], j[i < j]
        np.add.at(links, at[a] + i, weights[b][j])
        np.add.at(links, at[b] + j, weights[a][i])
        forest.link(at[a] + i, at[b] + j)
    some = np.flatnonzero(links)
    every = np.concatenate(ids)
    # the smallest id of a component stands for it
    least = np.full(at[-1], np.iinfo(np.int64).max)
    np.minimum.at(least, forest.root, every)
    return every[some], links[some], least[forest.root[some]]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector`` of the vectors that can link, one per id."""
    v = F.col(vector_col)
    whole = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    first = vectors.where(F.col(id_col).isNotNull() & whole).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(F.struct(F.col(label_col).alias("label"), v.alias("vector"))).alias("v"))
    return first.select("id", "v.label", "v.vector")


def _tiles(reps: DataFrame, slab: int, least_groups: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """Slabs of vectors with the tiles they belong to, for the left and the right side of the tile join."""
    kind = "<f4" if dict(reps.dtypes)["vector"] == "array<float>" else "<f8"
    label = dict(reps.dtypes)["label"]
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("size"))
    slabs = F.greatest(F.lit(1), F.ceil(F.col("size") / slab)).cast("bigint")
    groups = F.least(F.col("slabs"), F.greatest(F.lit(least_groups), F.ceil(F.col("size") / most_rows))).cast("bigint")
    sizes = sizes.withColumn("slabs", slabs).withColumn("groups", groups).drop("size")
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("slab", F.pmod(F.xxhash64("id"), F.col("slabs"))).drop("slabs")

    def pack(rows: pa.Table) -> pa.Table:
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        one = rows.slice(0, 1)
        return pa.table({
            **{c: one.column(c) for c in ("label", "dim", "groups", "slab")}, "ids": [rows.column("id").to_numpy().astype("<i8").tobytes()],
            "weights": [rows.column("n").to_numpy().astype("<i8").tobytes()], "data": [flat.astype(kind).tobytes()],
        })

    packed = dealt.groupBy("label", "dim", "slab").applyInArrow(pack, f"label {label}, dim int, groups bigint, slab bigint, ids binary, weights binary, data binary")
    packed = cut_lineage(packed.withColumn("g", F.col("slab") % F.col("groups")))
    right = packed.withColumn("i", F.explode(F.expr("sequence(0L, g)"))).withColumnRenamed("g", "j")
    left = packed.withColumn("j", F.explode(F.expr("sequence(g, groups - 1)"))).withColumnRenamed("g", "i")
    return left, right


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    slab: int = SLAB, least_groups: int = LEAST_GROUPS, most_rows: int = MOST_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector: cosine links at ``threshold`` or above between vectors of one label."""
    usable = _usable(vectors, id_col, vector_col, label_col).withColumn("dim", F.size("vector"))
    # equal vectors have cosine one: the smallest id stands for its copies
    reps = cut_lineage(usable.groupBy("label", "vector", "dim").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    left, right = _tiles(reps, slab, least_groups, most_rows)
    kind = "<f4" if dict(reps.dtypes)["vector"] == "array<float>" else "<f8"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, slabs, weights, number = [], [], [], {}
        for t in (a, b):
            for slab, dim, i, w, d in zip(*(t.column(c).to_pylist() for c in ("slab", "dim", "ids", "weights", "data"))):
                if slab not in number:
                    number[slab] = len(ids)
                    ids.append(np.frombuffer(i, "<i8"))
                    weights.append(np.frombuffer(w, "<i8"))
                    slabs.append(_scaled(np.frombuffer(d, kind).reshape(-1, dim).astype(np.float64)))
        sides = [[number[s] for s in t.column("slab").to_pylist()] for t in (a, b)]
        pairs = sorted({(min(x, y), max(x, y)) for x in sides[0] for y in sides[1]})
        return pa.table(list(tile_links(ids, slabs, pairs, weights, threshold)), ["id", "links", "root"])

    key = ["label", "dim", "i", "j"]
    found = cut_lineage(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "id bigint, links bigint, root bigint"))
    between = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    each = reps.join(between, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    member = usable.join(each, ["label", "vector"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    every = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id")).distinct()
    out = every.join(member, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def oracle(threshold: float = THRESHOLD) -> str:
    """All pairs of a label and everything reachable, in DuckDB."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, min({{'l': label, 'x': embedding}}) AS s FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0 GROUP BY vec_id),
u AS (SELECT vec_id, s.l AS l, s.x::DOUBLE[] AS x FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.l = b.l AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= {threshold}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT DISTINCT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, b) AS component_id, e.vec_id = least(e.vec_id, b) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.a LEFT JOIN degree ON e.vec_id = degree.a WHERE e.vec_id IS NOT NULL"""
