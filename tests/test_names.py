"""Name expressions on the spellings that trap."""

import pytest
from pyspark.sql import functions as F

from quadhap.functions import alignment, dose, names, sequence


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("mode,allele,want", [
    ("report", "HLA-A*24:09N", "A*24:09"), ("report", "A*01:01:01G", "A*01:01"), ("report", "A*01:01P", "A*01:01"), ("report", None, "NA"), ("report", "blank", "blank"),
    ("em", "A*24:09N", "A*24:09N"), ("em", "A*24", "A*24"), ("gate", " HLA-A*24:09N", "A*24:09N"), ("gate", "A*01:01:01G", "A*01:01"), ("gate", "A*24:02P", "A*24:02"),
    ("rescue", "HLA-DPB1*04:01P", "DPB1*04:01"), ("rescue", "A*24:09N", "A*24:09N"), ("rescue", "A*24:NQ", "A*24:N"),
])
def test_two_field(spark, mode, allele, want):
    assert one(spark, names.two_field("a", mode), a=allele) == want


@pytest.mark.parametrize("bare,allele,want", [("keep", "HLA-X", "HLA-X"), ("strip", "HLA-X", "X"), ("keep", "", "NA"), ("keep", "A*01:01:01G", "A*01:01:01G"), ("keep", "HLA-B*07:02L", "B*07:02")])
def test_clean(spark, bare, allele, want):
    assert one(spark, names.clean_allele("a", bare), a=allele) == want


@pytest.mark.parametrize("gene,allele,want", [("DRB345", "03:01:01", "DRB3*01:01"), ("DPB345", "5:02", "DRB5*02"), ("DRB345", "-", "NA"), ("DRB345", "07:01", "DRB345*07:01"), ("DRB345", "04:", "DRB345*04:"), ("A", "01:01", "A*01:01")])
def test_truth(spark, gene, allele, want):
    assert one(spark, names.truth_allele("g", "a"), g=gene, a=allele) == want


@pytest.mark.parametrize("allele,want", [("DRB1*13:02", "DRB3"), ("DRB1*09:01", "DRB4"), ("DRB1*15:01", "DRB5"), ("DRB1*01:01", "absent"), ("DQB1*03:01", "absent")])
def test_linked_locus(spark, allele, want):
    assert one(spark, names.linked_locus("a"), a=allele) == want


def test_read_names(spark):
    assert one(spark, names.read_name("h"), h="@r1/1 comment") == "r1"
    assert one(spark, names.read_name("h", "dedup"), h="@abc/2") == "abc"
    assert one(spark, names.read_name("h", "slash"), h="x/1/2") == "x"


def test_quartets(spark):
    key = names.quartet_key(F.split("a", ","))
    assert one(spark, key, a="b,a,d,c") == one(spark, key, a="a,b,c,d")
    assert one(spark, names.quartet_distance(F.split("a", ","), F.split("b", ",")), a="x,y,u,u", b="y,x,u,v") == 0.25
    got = one(spark, names.parse_support("t"), t="A*01:01:12;bad;A*02:01:7")
    assert [(r.allele, r.support, r["rank"]) for r in got] == [("A*01:01", 12, 1), ("A*02:01", 7, 3)]


def test_sequences(spark):
    assert one(spark, sequence.revcomp("s"), s="acgTN") == "NACGT"
    assert one(spark, sequence.kmers("s", 3), s="ACGNTTTT") == ["ACG", "TTT", "TTT"]
    assert one(spark, sequence.kmers("s", 9), s="ACGT") == []
    parts = one(spark, sequence.pieces("s", 3, 4), s="ACGTACGTAC")
    whole = [f"ACGTACGTAC"[i:i + 3] for i in range(8)]
    assert [p[i:i + 3] for p in parts for i in range(len(p) - 2)] == whole
    assert one(spark, sequence.apply_mask("s", "m"), s="ACGT", m="010") == "ANGT"
    assert one(spark, sequence.n_fraction("s"), s="NNAC") == 0.5


def test_alignment(spark):
    assert one(spark, alignment.match_bases("c", "n"), c="5S20M2I3D10M", n=2) == 28
    assert one(spark, alignment.focus_length("c"), c="5S20M2I3D10M") == 35
    runs = one(spark, alignment.aligned_blocks("c"), c="5S8M2I8M3N4M1D2M")
    assert [(r.offset, r.len) for r in runs] == [(0, 8), (8, 8), (19, 4), (24, 2)]


def test_dose(spark):
    assert one(spark, dose.dose_genotype(F.col("r"), F.col("d")), r=1, d=2) == "1/0/1/1"
    assert one(spark, dose.render(F.col("x"), 4), x=0.5) == "0.5000"
    assert one(spark, dose.render(F.lit(None).cast("double"), 4), x=1) == "NA"
