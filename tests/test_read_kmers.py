"""Hits of reads are counted from k-mers that the task which reads them has folded."""

import random
from collections import Counter

from quadhap.operators import kmers as km
from quadhap.operators.packed import spell


def test_hits_of_repeated_kmers(spark):
    rng = random.Random(6)
    owners = {o: "".join(rng.choice("ACGT") for _ in range(60)) for o in "xyz"}
    index = km.unique_kmer_index(spark.createDataFrame(list(owners.items()), "owner string, seq string"), 9, strands="forward")
    own = {r.word: r.owner for r in index.select(spell("kmer", 9).alias("word"), "owner").collect()}
    reads = [(i, (lambda a, b: owners[b][a:a + 25] * rng.randint(1, 3) + "N" + owners["x"][a:a + 12].lower())(rng.randint(0, 30), rng.choice("xyz"))) for i in range(20)] + [(20, None), (21, "ACG")]
    hits = km.kmer_hits(spark.createDataFrame(reads, "rec int, seq string"), index, 9, ["rec"])
    assert "MapInArrow" in hits.select("n")._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    want = Counter()
    for rec, seq in reads:
        s = (seq or "").upper()
        want.update((rec, own[s[i:i + 9]]) for i in range(len(s) - 8) if s[i:i + 9] in own)
    assert {(r.rec, r.owner): r.n for r in hits.collect()} == dict(want)
