"""EM: distributed loop, per-group solver and a plain loop agree."""

import random

import numpy as np
import pytest

from quadhap import session
from quadhap.operators import em


def cohort(n_groups=3, reads=60):
    rng = random.Random(1)
    rows = []
    for g in range(n_groups):
        for r in range(reads * (g + 1)):
            for c in rng.sample([f"c{i}" for i in range(6)], rng.randint(1, 4)):
                rows.append((f"s{g}", "A", f"r{r}", c, rng.choice([90, 95, 99, 100])))
    return rows


def plain(rows, group, iters, tol):
    reads = {}
    for s, _, r, c, a in rows:
        if s == group:
            reads.setdefault(r, {})[c] = a
    names = sorted({c for m in reads.values() for c in m})
    theta = {c: 1 / len(names) for c in names}

    def expect():
        x = dict.fromkeys(names, 0.0)
        for m in reads.values():
            top = max(m.values())
            u = {c: theta[c] * np.exp((a - top) / 2.0) for c, a in m.items()}
            z = sum(u.values())
            for c in u:
                x[c] += u[c] / z
        return x

    n = 0
    while n < iters:
        x = expect()
        tot = sum(v + 1e-12 for v in x.values())
        new = {c: (x[c] + 1e-12) / tot for c in names}
        delta, theta, n = sum(abs(new[c] - theta[c]) for c in names), new, n + 1
        if delta < tol:
            break
    return theta, expect(), n


@pytest.mark.parametrize("salts", [1, 8])
def test_em(spark, salts):
    rows = cohort()
    df = spark.createDataFrame(rows, "sample string, gene string, read string, contig string, score int")
    got = {}
    for r in em.em_abundance(df, max_iter=12, tol=1e-3, salts=salts, steps_per_cut=4).collect():
        got.setdefault(r["sample"], {})[r.contig] = r
    for g in ("s0", "s1", "s2"):
        theta, weight, n = plain(rows, g, 12, 1e-3)
        assert {r.iters for r in got[g].values()} == {n}
        assert sum(r.theta for r in got[g].values()) == pytest.approx(1.0)
        for c, t in theta.items():
            assert got[g][c].theta == pytest.approx(t, abs=1e-9)
            assert got[g][c].weight == pytest.approx(weight[c], abs=1e-6)


def test_unseen_contigs_keep_the_floor(spark):
    df = spark.createDataFrame([("s", "A", "r1", "x", 10), ("s", "A", "r2", "y", 10)], "sample string, gene string, read string, contig string, score int")
    contigs = spark.createDataFrame([("A", c) for c in "xyz"], "gene string, contig string")
    got = {r.contig: r.theta for r in em.em_abundance(df, contigs=contigs).collect()}
    assert got["z"] < 1e-9 and got["x"] == pytest.approx(0.5)


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    df = session.cut_lineage(spark.range(10).repartition(3))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10
