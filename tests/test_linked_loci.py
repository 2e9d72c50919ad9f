"""Linked loci: replacement in order of weight, and no plan of its own for the candidates."""

from quadhap.operators import drb345
from quadhap.plans import REGISTRY


def test_heaviest_unused_linked_family(spark):
    fams = [("s", f"DRB1*04:{i:02d}", float(w)) for i, w in enumerate([5, 9, 9, 1, 7, 3, 8])] + [("s", "DRB1*01:01", 99.0), ("u", "DRB1*01:01", 1.0)]
    old = ["DRB1*01:01", "DRB1*04:01", "DRB1*01:02", "DRB1*01:03"]
    quartets = spark.createDataFrame([("s", old), ("u", old)], "sample string, quartet array<string>")
    want = spark.createDataFrame([("s", ["DRB4*01:01"] * 3 + ["NA"]), ("u", ["DRB4*01:01"] * 4)], "sample string, quartet array<string>")
    out = drb345.drb345_consistency(quartets, want, spark.createDataFrame(fams, "sample string, family string, weight double")).collect()
    assert [(r["sample"], r.new) for r in out] == [("s", ["DRB1*04:02", "DRB1*04:01", "DRB1*04:06", "DRB1*01:03"])]


def test_locus_consistency_has_no_window(spark):
    plan = REGISTRY["locus_consistency"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
