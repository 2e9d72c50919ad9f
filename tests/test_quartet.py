"""Quartet searches against exhaustive enumeration written from the definition."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quadhap.operators import quartet

SCHEMA = "sample string, gene string, family string, weight double"


def brute(counts, chi, grid=None, prior=0.0, top_n=25, min_frac=0.002, forced=()):
    total = sum(counts.values())
    names = [n for n, w in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top_n] if w / total > min_frac or n in forced]
    names += [f for f in forced if f not in names]
    obs = {n: counts.get(n, 0.0) / total for n in names}
    best = math.inf
    for r in itertools.combinations_with_replacement(names, 2):
        for d in itertools.combinations_with_replacement(names, 2):
            for c in grid if grid is not None else [chi]:
                s = sum(abs(obs[n] - r.count(n) * c / 2 - d.count(n) * (1 - c) / 2) for n in names) + prior * abs(c - chi)
                best = min(best, s)
    return best


@pytest.mark.parametrize("grid", [None, (0.05, 0.5, 0.15)])
def test_l1_is_exhaustive(spark, grid):
    rng = random.Random(7)
    rows, want, chis = [], {}, {}
    for i in range(30):
        chi = rng.choice([0.03, 0.13, 0.27, 0.45])
        fams = {f"A*{j:02d}:01": float(rng.choice([1, 5, 5, 20, 60, 200]) * rng.choice([1, 1, 1.5])) for j in range(rng.randint(2, 8))}
        rows += [(f"s{i}", "g", f, w) for f, w in fams.items()]
        chis[f"s{i}"] = chi
        g = None if grid is None else [grid[0] + k * grid[2] for k in range(int((grid[1] + 1e-9 - grid[0]) / grid[2]) + 1)]
        want[f"s{i}"] = brute(fams, chi, g, prior=0.5 if grid else 0.0)
    fit = quartet.fit_quartet_l1(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(chis.items()), "sample string, chi_r double"), chi_grid=grid, chi_prior=0.5 if grid else 0.0)
    got = {r.sample: r for r in fit.collect()}
    assert set(got) == set(want)
    for s, r in got.items():
        assert r.score == pytest.approx(want[s], abs=1e-9)
        assert r.quartet[0] <= r.quartet[1] and r.quartet[2] <= r.quartet[3]


def first_in_order(counts, chi, slot_order):
    """The first of the best quartets, slots of a side listed by name or by weight rank and ordered by the ranks as listed."""
    total = sum(counts.values())
    names = sorted(counts, key=lambda n: (-counts[n], n))
    listed = sorted(names) if slot_order == "name" else names
    rank = {n: i for i, n in enumerate(names)}
    found = []
    for r in itertools.combinations_with_replacement(listed, 2):
        for d in itertools.combinations_with_replacement(listed, 2):
            q = (*r, *d)
            s = sum(abs(counts[n] / total - r.count(n) * chi / 2 - d.count(n) * (1 - chi) / 2) for n in names)
            found.append((round(s, 12), [rank[n] for n in q], list(q)))
    return min(found)[2]


@pytest.mark.parametrize("slot_order", ["name", "rank"])
def test_ties_go_to_the_first_in_listed_order(spark, slot_order):
    """Names that run against weights, and observed shares at or above the expected ones, where many quartets tie."""
    rng = random.Random(11)
    rows, want, chis = [], {}, {}
    for i in range(25):
        n = rng.randint(3, 7)
        weights = sorted((float(rng.choice([10, 20, 30, 30, 40])) for _ in range(n)), reverse=i % 2 == 0)
        counts = {f"A*{j:02d}": w for j, w in enumerate(weights)}
        chis[f"s{i}"] = rng.choice([0.05, 0.1, 0.2, 0.5])
        rows += [(f"s{i}", "g", f, w) for f, w in counts.items()]
        want[f"s{i}"] = first_in_order(counts, chis[f"s{i}"], slot_order)
    fit = quartet.fit_quartet_l1(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(chis.items()), "sample string, chi_r double"), min_frac=-1.0, scope="all", slot_order=slot_order)
    assert {r.sample: r.quartet for r in fit.collect()} == want


def test_forced_and_restricted_pools(spark):
    fam = spark.createDataFrame([("s", "g", n, w) for n, w in (("a", 90.0), ("b", 9.0), ("c", 0.9), ("d", 0.1))] + [("s", "h", "a", 5.0)], SCHEMA)
    forced = spark.createDataFrame([("s", "g", "z"), ("s", "g", "d")], "sample string, gene string, family string")
    pool = quartet.candidate_pool(fam, 2, 0.002, forced)
    assert [(r.family, r.fraction) for r in pool.where("gene = 'g'").orderBy("ord").collect()] == [("a", 0.9), ("b", 0.09), ("d", 0.001), ("z", 0.0)]
    limited = quartet.candidate_pool(fam, 2, 0.002, None, forced)
    assert {r.family for r in limited.where("gene = 'g'").collect()} == {"z", "d"}
    assert {r.family for r in limited.where("gene = 'h'").collect()} == {"a"}
    chi = spark.createDataFrame([("s", 0.1)], "sample string, chi_r double")
    assert quartet.fit_quartet_l1(fam, chi).where("gene = 'h'").count() == 0  # one candidate is no search


def test_planted_quartets_are_found(spark):
    rows, chis, want = [], [], {}
    for i, (chi, q) in enumerate([(0.13, "abcd"), (0.27, "aabc"), (0.45, "abab"), (0.03, "abbc"), (0.13, "aacc")]):
        dose = {}
        for n, w in zip(q, [chi / 2, chi / 2, (1 - chi) / 2, (1 - chi) / 2]):
            dose[n] = dose.get(n, 0) + w * 1e4
        rows += [(f"s{i}", "g", n, w) for n, w in dose.items()] + [(f"s{i}", "g", "noise", 1.0)]
        chis.append((f"s{i}", chi))
        want[f"s{i}"] = list(q)
    fit = quartet.fit_quartet_l1(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(chis, "sample string, chi_r double"), min_frac=0.001)
    assert {r.sample: r.quartet for r in fit.collect()} == want


@pytest.mark.parametrize("dose_prior,grid", [(0.0, None), (0.3, (0.1, 0.4, 0.1))])
def test_likelihood(spark, dose_prior, grid):
    rng = random.Random(3)
    reads = [("s", "g", f"r{i}", f, rng.choice([0.0, -0.5, -1.0, -3.0])) for i in range(200) for f in rng.sample("abcde", rng.randint(1, 3))]
    counts = {}
    for *_, f, _w in reads:
        counts[f] = counts.get(f, 0) + 1.0
    counts = {f: counts[f] for f in sorted(counts, key=lambda f: (-counts[f], f))}
    names = list(counts)[:4]
    mat = {}
    for *_, r, f, w in reads:
        mat.setdefault(r, {})[f] = w
    total = sum(counts.values())
    scores = []
    chis = [0.2] if grid is None else [grid[0] + i * grid[2] for i in range(4)]
    for r in itertools.combinations_with_replacement(names, 2):
        for d in itertools.combinations_with_replacement(names, 2):
            for c in chis:
                w = {n: r.count(n) * c / 2 + d.count(n) * (1 - c) / 2 for n in names}
                nll = -sum(math.log(sum(w[n] * math.exp(m.get(n, -25.0)) for n in names)) for m in mat.values())
                nll += dose_prior * len(mat) * sum(abs(counts[n] / total - w.get(n, 0.0)) for n in counts)
                scores.append((nll, r + d))
    scores.sort(key=lambda x: x[0])
    df = spark.createDataFrame(reads, "sample string, gene string, read string, family string, logw double")
    fam = spark.createDataFrame([("s", "g", f, w) for f, w in counts.items()], SCHEMA)
    # The prior's residual covers the pool and the rest of the families alike.
    chi = spark.createDataFrame([("s", 0.2)], "sample string, chi_r double")
    got = quartet.fit_quartet_likelihood(df, fam, chi, top_n=4, chi_grid=grid, dose_prior=dose_prior).first()
    assert got.nll == pytest.approx(scores[0][0], rel=1e-9)
    assert tuple(got.quartet) == scores[0][1]
    assert got.gap == pytest.approx(scores[1][0] - scores[0][0], abs=1e-6)
    assert got.n_reads == 200


@pytest.mark.parametrize("chi_r", [0.05, 0.5])
def test_likelihood_search_is_exhaustive(spark, chi_r):
    """Eight families, reads with none to all of them supported, several groups, a charge on the fraction; ties go to the first quartet."""
    rng = random.Random(8)
    names = [f"f{i}" for i in range(8)]
    grid, prior, rows, fam, want = (0.05, 0.5, 0.2), 0.01, [], [], {}
    for g in range(5):
        weight = {n: float(rng.randint(1, 9) * 10) for n in names}
        reads = [{n: rng.choice([0.0, -0.5, -4.0]) for n in rng.sample(names[: 2 + g] if i % 3 else names, rng.randint(1, 2 + g))} for i in range(60)]
        if g == 4:
            reads = [{n: v for n, v in zip(names, [0.0] * 8)} for _ in range(20)]  # all quartets tie
        rows += [(f"s{g}", "g", f"r{i}", n, w) for i, r in enumerate(reads) for n, w in r.items()] + [(f"s{g}", "g", "other", "unknown", 0.0)]
        fam += [(f"s{g}", "g", n, w) for n, w in weight.items()]
        pool = sorted(names, key=lambda n: (-weight[n], n))
        found = []
        for r in itertools.combinations_with_replacement(range(8), 2):
            for d in itertools.combinations_with_replacement(range(8), 2):
                for o, c in enumerate(grid[0] + x * grid[2] for x in range(3)):
                    e = lambda m, x: math.exp(m.get(pool[x], -25.0))  # noqa: B023, E731
                    nll = -sum(math.log(c / 2 * (e(m, r[0]) + e(m, r[1])) + (1 - c) / 2 * (e(m, d[0]) + e(m, d[1]))) for m in [*reads, {}])
                    found.append((round(nll + prior * (len(reads) + 1) * abs(c - chi_r), 6), *r, *d, o))
        found.sort()
        want[f"s{g}"] = ([pool[x] for x in found[0][1:5]], found[0][0], found[1][0] - found[0][0])
    chi = spark.createDataFrame([(f"s{g}", chi_r) for g in range(5)], "sample string, chi_r double")
    df = spark.createDataFrame(rows, "sample string, gene string, read string, family string, logw double")
    fit = quartet.fit_quartet_likelihood(df, spark.createDataFrame(fam, SCHEMA), chi, min_frac=0.0, chi_grid=grid, chi_prior=prior).collect()
    assert len(fit) == 5
    for r in fit:
        quartet_, nll, gap = want[r.sample]
        assert r.nll == pytest.approx(nll, abs=2e-6) and r.gap == pytest.approx(gap, abs=4e-6) and r.quartet == quartet_, r.sample


def test_forced_quartet_in_other_order_has_no_gap(spark):
    fit = spark.createDataFrame([("s", "g", ["a", "b", "c", "c"], 7.0), ("s", "h", ["a", "b", "c", "c"], 7.0)], "sample string, gene string, quartet array<string>, gap double")
    forced = spark.createDataFrame([("s", "g", ["b", "a", "c", "c"]), ("s", "h", ["a", "b", "c", "c"])], "sample string, gene string, forced array<string>")
    assert {r.gene: r.gap for r in quartet.forced_gap_zero(fit, forced).collect()} == {"g": 0.0, "h": 7.0}


def in_order(counts, chis, chi_r, prior, min_frac=0.002):
    """The first quartet of least score: slots run over the pool by weight, sides listed against name order are passed over."""
    total = sum(counts.values())
    pool = [n for n, w in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])) if w / total > min_frac]
    obs = {n: counts[n] / total for n in pool}
    best = None
    for q in itertools.product(pool, repeat=4):
        if q[0] > q[1] or q[2] > q[3]:
            continue
        s = min(round(sum(abs(obs[n] - q[:2].count(n) * c / 2 - q[2:].count(n) * (1 - c) / 2) for n in pool) + prior * abs(c - chi_r), 12) for c in chis)
        if best is None or s < best[0]:
            best = (s, list(q))
    return best


def test_equal_scores_fall_to_the_first_quartet(spark):
    rng = random.Random(11)
    rows, chis, counts = [], {}, {"s0": {"X1": 500.0, "X2": 315.0, "M": 70.0, "N": 60.0, "Z": 55.0}}
    chis["s0"] = 0.1
    for i in range(1, 220):
        n = rng.randint(2, 7)
        letters = rng.sample("ABCDEFGHIJ", n)
        counts[f"s{i}"] = {x: float(rng.choice([30, 30, 60, 90, 120, 400])) for x in letters}
        chis[f"s{i}"] = rng.choice([0.02, 0.05, 0.1, 0.2, 0.4, 0.5])
    rows = [(s, "g", f, w) for s, c in counts.items() for f, w in c.items()]
    chi = spark.createDataFrame(list(chis.items()), "sample string, chi_r double")
    for grid, prior in ((None, 0.0), ((0.05, 0.5, 0.15), 0.1)):
        fit = quartet.fit_quartet_l1(spark.createDataFrame(rows, SCHEMA), chi, chi_grid=grid, chi_prior=prior).collect()
        assert len(fit) == len(counts)
        for r in fit:
            tried = [chis[r.sample]] if grid is None else [grid[0] + k * grid[2] for k in range(4)]
            score, want = in_order(counts[r.sample], tried, chis[r.sample], prior)
            assert r.score == pytest.approx(score, abs=1e-11) and r.quartet == want, (r.sample, counts[r.sample], chis[r.sample])


def test_many_reads_do_not_meet_every_quartet_left(spark, monkeypatch):
    """Reads spread evenly leave nearly every quartet within its bound; their values come from folded terms and only a few quartets meet the reads."""
    rng = random.Random(5)
    names = [f"f{i}" for i in range(6)]
    rows = [("s", "g", f"r{i}", f, rng.choice([0.0, -0.5, -2.0])) for i in range(3000) for f in rng.sample(names, rng.randint(1, 2))]
    df = spark.createDataFrame(rows, "sample string, gene string, read string, family string, logw double")
    fam = df.groupBy("sample", "gene", "family").count().withColumnRenamed("count", "weight").withColumn("weight", F.col("weight").cast("double"))
    chi = spark.createDataFrame([("s", 0.2)], "sample string, chi_r double")
    exact, met, kept = quartet.quartet_nll, [], []

    def counted(classes, quartets, *floor):
        met.append(quartets.count())
        kept.append(classes)
        return exact(classes, quartets, *floor)

    monkeypatch.setattr(quartet, "quartet_nll", counted)
    monkeypatch.setattr(quartet, "FIRST_ROUND", 4)
    got = quartet.fit_quartet_likelihood(df, fam, chi).first()
    assert met[0] == 4 and met[1] <= 4
    listed = [(i, j, k, m) for i, j in itertools.combinations_with_replacement(range(6), 2) for k, m in itertools.combinations_with_replacement(range(6), 2)]
    every = spark.createDataFrame([("s", "g", *x, 0, 0.2) for x in listed], "sample string, gene string, i int, j int, k int, m int, chi_ord int, chi double")
    chis = spark.createDataFrame([("s", "g", 0, 0.2)], "sample string, gene string, chi_ord int, chi double")
    want = {(r.i, r.j, r.k, r.m): r.nll for r in exact(kept[0], every).collect()}
    folded = {(r.i, r.j, r.k, r.m): r.nll for r in quartet.folded_nll(quartet.quartet_terms(kept[0], chis), every).collect()}
    assert folded == pytest.approx(want, rel=1e-10) and len(want) == 441
    best = sorted(want.values())
    assert got.nll == pytest.approx(best[0]) and got.gap == pytest.approx(best[1] - best[0], abs=1e-5)
