"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadhap.llm import near_vectors as nv
from quadhap.llm.nearest import quantise


def brute(rows, threshold):
    use = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            use[i] = min(use.get(i, (label, v)), (label, v))
    ids = sorted({i for i, _, _ in rows if i is not None})
    links = {i: set() for i in ids}
    for a in use:
        for b in use:
            (la, x), (lb, y) = use[a], use[b]
            if a < b and la == lb and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return out


@pytest.mark.parametrize(("slab", "groups", "most"), [(4, 3, 8), (7, 64, 100), (1000, 1, 1)])
def test_against_all_pairs(spark, slab, groups, most):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    near = lambda i, e: (base[i] + rng.normal(size=6) * e).astype(np.float32).tolist()
    rows = [(i, near(i % 40, 0.25), i % 3) for i in range(160)]
    rows += [(1000 + i, near(0, 0.02), 1) for i in range(60)]  # a large group of near copies
    rows += [(2000 + i, base[5].astype(np.float32).tolist(), 0) for i in range(30)]  # and of exact ones
    odd = [None, [], [0.0] * 6, [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] * 6]
    rows += [(3000 + i, v, 0) for i, v in enumerate(odd)] + [(None, [1.0] * 6, 0), (3010, [1.0] * 6, None), (3011, [1.0] * 6, None), (3012, [1.0, 2.0], 0), (3013, [2.0, 4.0], 0), (3014, [-2.0, -4.0], 0)]
    rows += [rows[0], rows[1], (2, near(7, 0.1), 2), (3015, [1e-20, 0.0], 2), (3016, [1e20, 0.0], 2), (3017, [-0.0, 3.0], 2), (3018, [0.0, 3.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("n", F.lit("y")).withColumn("slab", F.lit(1)).repartition(3)
    got = [tuple(r) for r in nv.near_duplicates(df, 0.93, slab=slab, least_groups=groups, most_rows=most).orderBy("vec_id").collect()]
    plain = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert got == brute(plain, 0.93)
    assert max(r[1] for r in got) > 50


def test_doubles_and_bounds(spark):
    rows = [(1, [1e-200, 2e-200], "a"), (2, [1e200, 2e200], "a"), (3, [1.0, -2.0], "a")]
    got = nv.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 24))
    a[150:] = a[:150] + rng.normal(size=(150, 24)) * 0.3
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    q = quantise(unit)
    i, j = nv.linked(a, a, q, q, 0.93)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.93))))


def test_no_pair_leaves_a_tile():
    x = np.ones((500, 4)) + np.random.default_rng(1).normal(size=(500, 4)) * 1e-3
    ids, links, root = nv.tile_links([np.arange(500) + 7], [x], [(0, 0)], [np.ones(500, np.int64)], 0.93)
    assert len(ids) == 500 and set(links.tolist()) == {499} and set(root.tolist()) == {7}


def test_empty(spark):
    assert nv.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
