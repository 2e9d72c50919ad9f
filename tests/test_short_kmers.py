"""Indexes of short k-mers are folded one by one, several k from one shuffle."""

import random

import pytest

from pyspark.sql import functions as F

from quadhap.operators import kmers as km
from quadhap.operators import packed
from quadhap.plans.registry import BASES, LETTERS, as_sequence
from tests.test_packed import brute_index, rc, sequences, words


@pytest.mark.parametrize("strands", ["forward", "both", "forward_then_both"])
def test_several_k_in_parts(spark, monkeypatch, strands):
    for name, value in (("OPEN_KMERS", 90), ("OWNED_KMERS", 60), ("MET_KMERS", 50), ("SLICE", 40), ("BLOCK_BITS", 6)):
        monkeypatch.setattr(packed, name, value)
    rows = sequences(8)
    df = spark.createDataFrame(rows, "owner string, seq string").repartition(3)
    for k, index in km.short_kmer_indexes(df, (1, 5, 6, 14, 15), strands=strands).items():
        got = [(r["s"], r["owner"]) for r in index.select(packed.spell("kmer", k).alias("s"), "owner").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_index(rows, k, strands)


@pytest.mark.parametrize("strands", ["forward", "both", "forward_then_both"])
def test_only_what_is_asked(spark, strands):
    rng = random.Random(9)
    rows = sequences(9) + [(f"o{i}", "".join(rng.choice("ACGT") for _ in range(90))) for i in range(7)]
    df = spark.createDataFrame(rows, "owner string, seq string")
    reads = [r[rng.randrange(40):][:60] for _, r in rng.sample(rows[:40], 3) + rows[-3:]] + [None, "ACG", rc(rows[-4][1][-30:])]
    index = km.unique_kmer_index(df, 11, strands=strands, asked=spark.createDataFrame([(r,) for r in reads], "seq string"))
    got = [(r["s"], r["owner"]) for r in index.select(packed.spell("kmer", 11).alias("s"), "owner").collect()]
    met = {w for r in reads for w in words((r or "").upper(), 11)}
    want = brute_index(rows, 11, strands)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) < len(want)
    assert {x for x in got if x[0] in met} == {x for x in want if x[0] in met} != set()
    assert not list(km.unique_kmer_index(df, 11, strands=strands, asked=spark.createDataFrame([("ACG",)], "seq string")).collect())


def test_letters_in_one_pass(spark):
    texts = [None, "", "Ab cJ-z", "ſtraße Kelvin\u212a é\U0001f600q\0Z\n", " 12 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS + LETTERS.upper(), BASES + BASES)
    rows = df.select(as_sequence().alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
