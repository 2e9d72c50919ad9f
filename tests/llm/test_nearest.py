"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadhap.llm import nearest


def brute(rows, k, picked):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = []
    for q in sorted(best):
        if picked(q):
            scored = []
            for c, v in best.items():
                if c != q and len(v) == len(best[q]):
                    s = 0.0
                    for x, y in zip(best[q], v):
                        s += x * y
                    scored.append((-s, c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("k", "block", "slices"), [(5, 3, 4), (20, 1000, 1)])
def test_against_brute_force(spark, k, block, slices):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, base[i % 60 if i < 60 else i % 3].tolist()) for i in range(150)]  # many copies of three vectors
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0] * 7 + [None]), (204, [1.0] * 7 + [float("nan")]), (205, [float("inf")] * 8), (None, [1.0] * 8), (206, [1.0, 2.0]), (207, [3.0, 4.0]), (10, base[10].tolist()), (20, base[3].tolist()), (208, [1e-30] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vector", F.lit("x"))
    got = [tuple(r) for r in nearest.nearest(df, F.col("id") % 5 == 0, k, block, slices).orderBy("query_id", "rank").collect()]
    plain = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got == brute(plain, k, lambda q: q % 5 == 0)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (1e-3, 1.0, 1e4):
        a, b = rng.normal(size=(40, 16)) * scale, rng.standard_cauchy(size=(300, 16))
        i, j, _ = nearest.tile_survivors(*nearest.quantise(a), *nearest.quantise(b), 5, np.full(40, -np.inf))
        kept = set(zip(i.tolist(), j.tolist()))
        top = np.argsort(-(a @ b.T), axis=1)[:, :5]
        assert all((q, c) in kept for q in range(40) for c in top[q]) and len(kept) < 40 * 300 / 3


def test_empty(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("id") % 5 == 0).count() == 0
