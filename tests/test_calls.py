"""Copy fractions, masks, slots and haplotypes against definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadhap.operators import assembly, calls, class2, coverage, evaluate, gates, ranking


def copy_fit(families, support, chi):
    """Direct solution of one problem: best non-negative shares over all active sets."""
    have = {}
    for f, s in zip(families, support):
        if f != "NA" and s is not None:
            have[f] = max(have.get(f, 0.0), s)
    total = sum(have.values())
    if total <= 0:
        return None
    names = sorted(have)
    a = np.array([[1.0 if f == n else 0.0 for f in families] for n in names])
    y = np.array([have[n] / total for n in names])
    use = chi is not None and 0 < chi < 1
    d, t = (np.vstack([a, [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]]]), np.concatenate([y, [0.5 * chi, 0.5 * (1 - chi)]])) if use else (a, y)
    best = None
    for mask in range(1, 16):
        act = [i for i in range(4) if mask >> i & 1]
        sub, n = d[:, act], len(act)
        k = np.zeros((n + 1, n + 1))
        k[:n, :n] = 2 * sub.T @ sub + 1e-9 * np.eye(n)
        k[:n, n] = k[n, :n] = 1
        x = np.linalg.lstsq(k, np.concatenate([2 * sub.T @ t, [1.0]]), rcond=None)[0][:n]
        if (x < -1e-7).any():
            continue
        full = np.zeros(4)
        full[act] = np.maximum(x, 0)
        full /= full.sum()
        score = round(float(((a @ full - y) ** 2).sum()), 12)
        if best is None or score < best[0]:
            best = (score, full)
    return best, np.linalg.matrix_rank(a)


def test_copy_fractions(spark):
    rng = random.Random(5)
    rows = []
    for i, pattern in enumerate(itertools.product("abcN", repeat=4)):
        sup = [None if rng.random() < 0.15 else round(rng.random(), 3) for _ in range(4)]
        rows.append((i, ["NA" if p == "N" else p for p in pattern], sup, rng.choice([None, 0.1, 0.3, 1.5])))
    df = spark.createDataFrame(rows, "id int, families array<string>, support array<double>, chi_r double")
    got = {r.id: r for r in calls.fit_copy_fractions(df).collect()}
    assert len(got) == len(rows)
    for i, fam, sup, chi in rows:
        want, r = copy_fit(fam, sup, chi), got[i]
        if want is None:
            assert r.copy_identifiability == "no_read_support" and r.copies is None
            continue
        (score, x), rank = want
        assert sum(r.copies) == pytest.approx(1.0) and min(r.copies) >= 0
        assert r.copy_fit_error == pytest.approx(score, abs=1e-7)
        kind = "identifiable" if rank == 4 else "underdetermined_chi_regularized" if chi in (0.1, 0.3) else "underdetermined_min_norm"
        assert r.copy_identifiability.split(";")[0] == kind


def lowcov(cov, window, limit):
    masked = set()
    for i in range(window, len(cov)):
        if sum(cov[i - window:i]) / window < limit:
            masked |= set(range(i - window, i))
    return masked


def test_lowcov_mask(spark):
    rng = random.Random(2)
    covs = {f"s{i}": [rng.choice([0, 2, 5, 9, 30]) for _ in range(rng.choice([5, 20, 21, 60]))] for i in range(20)}
    df = spark.createDataFrame([(s, "g", p, d) for s, c in covs.items() for p, d in enumerate(c)], "sample string, gene string, pos0 int, depth int")
    got = {}
    for r in coverage.lowcov_mask(df, 20, 8).where("masked").collect():
        got.setdefault(r["sample"], set()).add(r.pos0)
    for s, c in covs.items():
        # The last window ends before the last base, as windows look at the bases before them.
        assert got.get(s, set()) == lowcov(c, 20, 8), s


def test_numbering_of_a_hot_key(spark):
    rng = random.Random(4)
    names = ["hot" if rng.random() < 0.6 else f"n{rng.randint(0, 30)}" for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rec long, name string")
    got = {r.rec: r.occurrence for r in ranking.occurrence_number(df, ["name"], "rec", width=64).collect()}
    seen = {}
    for i, n in enumerate(names):
        seen[n] = seen.get(n, 0) + 1
        assert got[i] == seen[n]


def test_build_and_stitch(spark):
    slices = spark.createDataFrame([("s", "g", 100, "ACGTACGTAC")], "sample string, gene string, start int, seq string")
    edits = spark.createDataFrame([("s", "g", 1, 101, "C", "TT"), ("s", "g", 1, 105, "CGT", ""), ("s", "g", 2, 108, "ACG", "x"), ("s", "g", 2, 50, "A", "x")],
                                  "sample string, gene string, hap int, pos0 int, ref string, alt string")
    got = {r.hap: r.seq for r in assembly.build_haplotypes(slices, edits).collect()}
    assert got == {1: "ATTGTAAC", 2: "ACGTACGTAC", 3: "ACGTACGTAC", 4: "ACGTACGTAC"}
    blocks = spark.createDataFrame([("s", "g", 1, 102, 104, "nn"), ("s", "g", 1, 106, 108, "m")], "sample string, gene string, hap int, lo int, hi int, seq string")
    refs = spark.createDataFrame([("g", 100, 110, "ACGTACGTAC")], "gene string, start int, end int, ref string")
    assert assembly.stitch(blocks, refs).first().seq == "ACnnACmAC"


def test_haplotype_scores(spark):
    alleles = {"x": "ACGTTGCAACGG", "y": "ACGTTGCATTTT", "z": "GGGGACGTTGCA"}
    hap, k = "ACGTTGCAACGA", 5
    words = lambda s: {s[i:i + k] for i in range(len(s) - k + 1)}
    df = assembly.score_haplotypes(spark.createDataFrame([("s", "g", 0, 1, hap)], "sample string, gene string, block int, hap int, seq string"),
                                   spark.createDataFrame([("g", a, s) for a, s in alleles.items()], "gene string, allele string, seq string"), k)
    want = {a: 2.0 * len(words(hap) & words(s)) - 3.0 * len(words(hap) - words(s)) for a, s in alleles.items()}
    assert {r.allele: r.score for r in df.collect()} == want


def test_assembly_is_exhaustive(spark):
    rng = random.Random(9)
    pool, rows, pen = "abcd", [], {}
    for b in range(3):
        pen[b] = [rng.random() * 5 for _ in range(6)]
        rows += [("s", "g", b, h, a, float(rng.randint(0, 50))) for h in range(1, 5) for a in pool]
    cell = {(b, h, a): v for _, _, b, h, a, v in rows}
    splits = [s for s, _ in assembly.SPLITS]

    def score(q):
        total = 0.0
        for b in range(3):
            total += max(sum(cell[b, h + 1, q[p[h]]] for h in range(4)) - pen[b][splits.index(tuple(h for h in range(4) if p[h] < 2))] for p in itertools.permutations(range(4)))
        return total

    pairs = list(itertools.combinations_with_replacement(pool, 2))
    best = max(score(r + d) for r in pairs for d in pairs)
    sc = spark.createDataFrame(rows, "sample string, gene string, block int, hap int, allele string, score double")
    pn = spark.createDataFrame([("s", "g", b, p) for b, p in pen.items()], "sample string, gene string, block int, penalty array<double>")
    got = assembly.assemble(sc, pn).first()
    assert got.score == pytest.approx(best) and score(tuple(got.quartet)) == pytest.approx(best)
    free = assembly.assemble(sc, None, paired=False).first()
    pen = {b: [0.0] * 6 for b in range(3)}
    assert free.score == pytest.approx(max(score(q) for q in itertools.combinations_with_replacement(pool, 4)))


def test_assembly_is_the_first_best_of_all_quartets(spark):
    """Ties, missing cells, negative scores and very unequal alleles; several genes at once."""
    rng = random.Random(4)
    rows, pens, want, free = [], [], {}, {}
    splits = [s for s, _ in assembly.SPLITS]
    for g in range(8):
        pool = [f"a{i}" for i in range(rng.randint(2, 7))]
        cell = {(b, h, a): float(rng.choice([-5, 0, 1, 2, 2, 9, 40])) * (0.1 if a == "a0" else 1) for b in range(rng.randint(1, 4)) for h in range(4) for a in pool if rng.random() < 0.8 or (b, h) == (0, 0)}
        blocks = sorted({b for b, _, _ in cell})
        pen = {b: [rng.choice([0.0, 1.0, 3.0]) for _ in range(6)] for b in blocks}
        rows += [("s", f"g{g}", b, h + 1, a, v) for (b, h, a), v in cell.items()]
        pens += [("s", f"g{g}", b, p) for b, p in pen.items()]

        def score(q, cost):
            return round(sum(max(sum(cell.get((b, h, q[p[h]]), 0.0) for h in range(4)) - cost[b][splits.index(tuple(h for h in range(4) if p[h] < 2))] for p in itertools.permutations(range(4))) for b in blocks), 9)

        pairs = list(itertools.combinations_with_replacement(pool, 2))
        want[f"g{g}"] = min((-score(r + d, pen), list(r + d)) for r in pairs for d in pairs)
        nothing = dict.fromkeys(blocks, [0.0] * 6)
        free[f"g{g}"] = min((-score(q, nothing), list(q)) for q in itertools.combinations_with_replacement(pool, 4))
    sc = spark.createDataFrame(rows, "sample string, gene string, block int, hap int, allele string, score double")
    pn = spark.createDataFrame(pens, "sample string, gene string, block int, penalty array<double>")
    for got, right in ((assembly.assemble(sc, pn), want), (assembly.assemble(sc, None, paired=False), free)):
        rows_ = got.collect()
        assert {r.gene: (-round(r.score, 9), r.quartet) for r in rows_} == right
        assert all(r.blocks == sorted(r.blocks) and len(r.splits) == len(r.blocks) for r in rows_)


def test_one_prediction_can_serve_two_levels(spark):
    gg = spark.createDataFrame([("A*01:01:01", "A*01:01:01G"), ("A*01:01:01G", "A*01:01:01G"), ("A*01:01:09", "A*01:01:09G")], "member string, grp string")
    truth = spark.createDataFrame([("s", "PATIENT", "HLA-A", "A*01:01"), ("s", "PATIENT", "HLA-A", "A*01:01:01G")], "sample string, side string, gene string, allele string")
    pred = spark.createDataFrame([("s", "PATIENT", "HLA-A", "A*01:01:01"), ("s", "PATIENT", "HLA-A", "A*09:09")], "sample string, side string, gene string, allele string")
    assert evaluate.evaluate_calls(pred, truth, gg, ("g_group",)).first().hits == 2
    assert evaluate.evaluate_calls(pred, truth, gg, ("g_group",), strict=True).first().hits == 1
    versions = pred.withColumn("version", F.lit("current")).unionByName(truth.withColumn("version", F.lit("truth")))
    delta = {(r.version, r.level): r.delta for r in evaluate.compare_versions(versions, truth, gg, "current").collect()}
    assert delta[("truth", "2field")] == 1 and delta[("current", "2field")] == 0


def test_proposed_dpb1_rules_and_choice(spark):
    fam = spark.createDataFrame([("s", "HLA-DPB1", f"DPB1*{n:02d}:01", w, w / 1000) for n, w in ((4, 500.0), (2, 300.0), (3, 150.0), (133, 50.0))],
                                "sample string, gene string, family string, weight double, fraction double")
    call = spark.createDataFrame([("s", "HLA-DPB1", ["DPB1*133:01", "DPB1*133:01", "DPB1*04:01", "DPB1*04:01"], 0.5)], "sample string, gene string, quartet array<string>, mask double")
    p = class2.propose_dpb1(call, fam).first()
    assert p.proposed == ["DPB1*02:01", "DPB1*02:01", "DPB1*04:01", "DPB1*04:01"] and p.rule == "dpb1_rare_collapse"
    long = lambda v: spark.createDataFrame([("s", "g1", v), ("s", "g2", v)], "sample string, gene string, allele string")
    gated = spark.createDataFrame([("s", "g1", "OVERRIDE"), ("s", "g2", "KEEP_BASELINE")], "sample string, gene string, action string")
    assert {r.gene: r.allele for r in gates.choose_calls(gated, long("b"), long("e")).collect()} == {"g1": "e", "g2": "b"}


def test_haplotype_scores_with_many_owners(spark, monkeypatch):
    """More alleles than one number has bits, k-mers that all, many or none of them have, and a task that hands its k-mers on in parts."""
    monkeypatch.setattr(assembly, "OWNERS", 5)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = text(30)
    alleles = [("g", f"a{i:02d}", common + "N" + text(60)) for i in range(13)] + [("h", "b", text(50)), ("g", "a03", text(40).lower())]
    haps = [("s", "g", b, h, common[: 10 + b] + "-" + text(20) + alleles[b][2][35:70]) for b in range(4) for h in (1, 2)] + [("s", "g", 0, 1, common), ("s", "h", 0, 1, "ACG"), ("s", "h", 1, 1, alleles[13][2]), ("t", "none", 0, 1, common)]
    words = lambda s, k: {s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")}
    made = lambda rows: {key: set().union(*(words(r[-1].upper(), 6) for r in rows if r[:-1] == key)) for key in {r[:-1] for r in rows}}
    own = made(alleles)
    want = {(*h, a): 2.0 * len(w & v) - 3.0 * len(w - v) for h, w in made(haps).items() for (g, a), v in own.items() if g == h[1] and w}
    got = assembly.score_haplotypes(spark.createDataFrame(haps, "sample string, gene string, block int, hap int, seq string"), spark.createDataFrame(alleles, "gene string, allele string, seq string"), 6)
    assert {(r["sample"], r.gene, r.block, r.hap, r.allele): r.score for r in got.collect()} == want
    met = got._jdf.queryExecution().optimizedPlan().toString()
    assert met.count("MapInArrow") == 2  # every sequence is read for its k-mers once
