"""Packed k-mers and super-k-mers against strings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadhap.operators import kmers as km
from quadhap.operators import packed

RC = str.maketrans("ACGT", "TGCA")
rc = lambda s: s.translate(RC)[::-1]
words = lambda s, k: [s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def sequences(seed, n=40):
    rng = random.Random(seed)
    core = "".join(rng.choice("ACGT") for _ in range(700))
    out = []
    for i in range(n):
        at = rng.randrange(500)
        s = core[at : at + rng.randrange(200)]
        s = rng.choice([s, rc(s), s + "N" + s, "A" * 90 + s, s.lower(), "ACGT" * 20 + s, s[:20] + "ä" + s[20:]])
        out.append((f"o{i % 7}", s))
    return out + [("o1", None), ("o2", ""), ("o3", "ACG"), ("o1", out[0][1]), ("o4", core * 5)]


@pytest.mark.parametrize("k", [1, 2, 9, 16, 31, 32, 51, 62, 63, 71])
def test_kmers_are_the_strings(spark, k):
    rows = sequences(k)
    df = spark.createDataFrame(rows, "owner string, seq string").repartition(3)
    each = km.explode_kmers(df, "seq", k, ["owner"], spread=k % 2 == 0)
    back = packed.with_reverse(each, k).select("owner", packed.spell("kmer", k).alias("s"), packed.spell("reverse", k).alias("r")).collect()
    want = sorted((o, w) for o, s in rows for w in words((s or "").upper(), k))
    assert sorted((r["owner"], r["s"]) for r in back) == want
    assert all(r["r"] == rc(r["s"]) for r in back)
    if want:
        low = each.agg(packed.spell(F.min("kmer"), k), packed.spell(F.max("kmer"), k)).first()
        assert tuple(low) == (min(w for _, w in want), max(w for _, w in want))


def brute_index(rows, k, strands):
    owners = {}
    for o, s in rows:
        for w in words((s or "").upper(), k):
            for x in {w, rc(w)} if strands == "both" else {w}:
                owners.setdefault(x, set()).add(o)
    kept = {(w, *o) for w, o in owners.items() if len(o) == 1}
    return kept | {(rc(w), o) for w, o in kept} if strands == "forward_then_both" else kept


@pytest.mark.parametrize(("k", "strands"), [(4, "both"), (9, "forward"), (16, "both"), (16, "forward_then_both"), (31, "both"), (51, "both"), (51, "forward_then_both"), (71, "both")])
def test_index(spark, k, strands):
    rows = sequences(k + 1)
    df = spark.createDataFrame(rows, "owner string, seq string").repartition(4)
    index = km.unique_kmer_index(df, k, strands=strands)
    got = [(r["s"], r["owner"]) for r in index.select(packed.spell("kmer", k).alias("s"), "owner").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_index(rows, k, strands)


def test_scopes_and_within(spark, monkeypatch):
    monkeypatch.setattr(packed, "SLICE", 300)
    monkeypatch.setattr(packed, "HELD", 50)
    rows = sequences(5)
    df = spark.createDataFrame([(i % 3, i % 2 == 0, o, s) for i, (o, s) in enumerate(rows)], "gene int, even boolean, owner string, seq string")
    index = km.unique_kmer_index(df, 12, scope=("gene", "even"))
    got = {(r["gene"], r["even"], r["s"], r["owner"]) for r in index.withColumn("s", packed.spell("kmer", 12)).collect()}
    want = {(g, e, *x) for g in range(3) for e in (True, False) for x in brute_index([r for i, r in enumerate(rows) if (i % 3, i % 2 == 0) == (g, e)], 12, "both")}
    assert got == want
    small = km.unique_kmer_index(df.where("gene = 0"), 12)
    both = km.unique_kmer_index(df, 12, within=small)
    keep = {w for w, _ in brute_index([r for i, r in enumerate(rows) if i % 3 == 0], 12, "both")}
    assert {(r["s"], r["owner"]) for r in both.withColumn("s", packed.spell("kmer", 12)).collect()} == {x for x in brute_index(rows, 12, "both") if x[0] in keep}


def test_runs_travel_light():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 20_000).astype(np.uint8)
    mini, start, count, w = packed.runs_of(codes, 31, packed.minimiser_size(31), 2)
    assert count.sum() == 20_000 - 30 and (np.diff(start) == count[:-1]).all()
    assert count.mean() > 6  # one run of two numbers for so many k-mers
    back = packed.runs_of((3 - codes)[::-1].copy(), 31, packed.minimiser_size(31), 2)[0]
    assert set(mini.tolist()) == set(back.tolist())  # both strands meet


@pytest.mark.parametrize("k", [5, 21, 31, 33])
def test_counted_kmers(spark, monkeypatch, k):
    """Counts in parts add up to the occurrences, also where a task hands on what it holds several times."""
    for name, value in (("OPEN_KMERS", 50), ("FOLDED_KMERS", 60), ("SLICE", 40)):
        monkeypatch.setattr(packed, name, value)
    rng = random.Random(k)
    rows = [(f"o{i % 7}", i % 3, "".join(rng.choice("ACGTacgtN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.randint(0, 200)))) for i in range(40)] + [("o1", 1, None), ("o2", 0, "ACGT" * 60)]
    df = spark.createDataFrame(rows, "owner string, part int, seq string").coalesce(1)
    got = km.counted_kmers(df, "seq", k, ["owner", "part"]).groupBy("owner", "part", "kmer").agg(F.sum("n").alias("n"))
    want = Counter((o, p, w) for o, p, s in rows for w in words((s or "").upper(), k))
    assert {(r.owner, r.part, r.s): r.n for r in got.withColumn("s", packed.spell("kmer", k)).collect()} == want


def test_equal_kmers_leave_their_task_once(spark):
    df = spark.createDataFrame([("a", "ACGT" * 500), ("a", "CGTA" * 500), ("b", "A" * 900)], "owner string, seq string").coalesce(1)
    assert sorted((r.owner, r.n) for r in km.counted_kmers(df, "seq", 21, ["owner"]).collect()) == [("a", 990)] * 4 + [("b", 880)]
