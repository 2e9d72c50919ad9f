"""Edits of haplotypes: results against one edit after the other, and no shuffle of edits."""

import random

from quadhap.operators import assembly
from quadhap.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().toString()


def edited(start, seq, edits):
    """Edits one after the other; one that begins inside an earlier one, or leaves the slice, is skipped."""
    out, at = "", 0
    for pos, ref, alt in sorted(edits, key=lambda e: (e[0], len(e[1]), e[2])):
        if at <= pos - start and pos - start + len(ref) <= len(seq):
            out, at = out + seq[at:pos - start] + alt, pos - start + len(ref)
    return out + seq[at:]


def test_edited_haplotypes(spark):
    rng = random.Random(3)
    slices, edits, want = [], [], {}
    for i in range(40):
        start, seq = rng.randint(0, 50), "".join(rng.choice("ACGTNé") for _ in range(rng.randint(0, 60)))
        slices.append((f"s{i}", "g", start, seq))
        for h in range(1, 5):
            mine = [(rng.randint(start - 3, start + 62), "A" * rng.randint(0, 4), rng.choice(["", "T", "GG", "ßT"])) for _ in range(rng.choice([0, 1, 9]))]
            edits += [(f"s{i}", "g", h, *e) for e in mine]
            want[f"s{i}", h] = edited(start, seq, mine)
    s = spark.createDataFrame(slices, "sample string, gene string, start int, seq string")
    e = spark.createDataFrame(edits, "sample string, gene string, hap int, pos0 int, ref string, alt string")
    assert {(r["sample"], r.hap): r.seq for r in assembly.build_haplotypes(s, e).collect()} == want


def test_built_haplotypes_travel_nowhere(spark):
    plan = plan_of(spark, "built_haplotypes")
    assert "Join" not in plan and "Aggregate" not in plan  # edits met their slices again by a shuffle, a row each
