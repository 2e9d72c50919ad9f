"""Masked bases of haplotypes, without a row per base."""

from pyspark.sql import functions as F

from quadhap.operators import coverage
from quadhap.plans import REGISTRY


def test_masked_sequences(spark):
    rows = [("a", "ACGT", [True, False]), ("b", "AéGT", [False, True, False, True, True]), ("c", "", [True]), ("d", None, [True]), ("e", "AC", None)]
    df = spark.createDataFrame(rows, "sample string, seq string, flags array<boolean>").withColumn("gene", F.lit("g"))
    got = {r["sample"]: r.seq for r in coverage.mask_haplotypes(df).collect()}
    assert got == {"a": "NCGT", "b": "ANGN", "c": "", "d": None, "e": "AC"}
    dense = spark.createDataFrame([("a", "g", 7, False), ("a", "g", 5, True), ("a", "g", 6, None), ("b", "g", 1, True)], "sample string, gene string, pos0 int, masked boolean")
    assert {r["sample"]: r.seq for r in coverage.mask_haplotypes(df.drop("flags"), dense).collect()} == {"a": "NCGT", "b": "NéGT", "c": "", "d": None, "e": "AC"}


def test_masked_haplotypes_have_no_row_per_base(spark):
    assert "Generate" not in REGISTRY["masked_haplotypes"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
