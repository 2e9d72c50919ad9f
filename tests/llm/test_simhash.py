"""SimHash classes against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from quadhap.llm import simhash
from quadhap.llm.components import components
from tests.llm.conftest import ODD_TEXTS


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_classes(rows):
    distinct = sorted(set(rows.values()))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows.items():
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in rows.items()}


def test_queries_rows(documents, make):
    docs = documents.select("doc_id", "text").unionByName(make([(9000 + i, t) for i, t in enumerate(ODD_TEXTS)]).select("doc_id", "text"))
    rows = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = plain_classes(rows)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{f:016x}", want[d]) for d, f in rows.items()}
    assert len(got) == len(rows) and any(r["doc_id"] != r["component_id"] for r in got)


@pytest.mark.parametrize("dense", [2, 4096])
def test_links_of_crowded_cells(spark, dense):
    """Clouds of near fingerprints, chains and lone ones, also with every cell divided."""
    rng = random.Random(3)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))))
        for _ in range(30):  # a chain
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            values.add(centre)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(signed))], "doc_id bigint, fp bigint")
    found = simhash.links(fps.select("fp"), dense=dense).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
    want = plain_classes({i: v & (1 << 64) - 1 for i, v in enumerate(sorted(signed))})
    assert {r["doc_id"]: r["component_id"] for r in simhash.classes(fps).collect()} == want


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(50)]
    got = spark.createDataFrame([(v,) for v in values], "fp bigint").select("fp", simhash.embedding(simhash.F.col("fp"))).collect()
    for fp, v in got:
        assert [(v >> 2 * i) & 3 for i in range(32)] == [((fp >> 2 * i) & 3).bit_count() for i in range(32)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(-5, -6), (-6, -7), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, -5: -7, -6: -7, -7: -7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one(make):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d e f"), (9, "other words stand here now"), (4, None), (5, ""), (None, "nothing else is like this"), (9, "other words stand here now")]
    kept = simhash.keep_one(make(rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 9), (False, 9), (True, 0)]
    assert simhash.near_duplicates(make([(1, "a")]).where("doc_id > 5")).count() == 0


def test_fingerprint_of_long_texts():
    text = " ".join(str(i * i) for i in range(70_000))
    assert np.uint64(simhash.fingerprint(text)) == plain_fingerprint(text)
