"""The prefix trie against a trie of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadhap.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, regrow=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = plain.get(base, [])[:h] + own[h:] if regrow else own
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    for node, cs in members.items():
        tree = list(below(node))
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), sum(not children[n] for n in tree),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in tree if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("x")).withColumn("k1", F.lit("y")).withColumn("depth", F.lit(1)).repartition(3)


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -4, -7, 5000]:
        for turn in range(rng.randrange(13)):
            rows.append((c, turn * 3, rng.choice(["user", "assistant"]), rng.choice(["hi", "hé", "", "a longer text", None])))
    rows += [(c, t, "system" if t else None, f"copy {t}") for c in range(200, 240) for t in range(12)]  # a group of copies
    rows += [(3, None, "user", "first"), (3, None, None, None), (4, 2, "user", "tie"), (4, 2, "user", "tie"), (4, 2, "a", "tie"), (None, 1, "user", "nobody's")]
    rows += [(c, t, "u", "deep") for c in (300, 305, 301) for t in range(70 + c % 7)] + [(310, 9000 - t, "u", f"t{t}") for t in range(40)]
    return rows


@pytest.mark.parametrize(("seed", "bits"), [(1, None), (2, 15)])
def test_against_tuples(spark, seed, bits):
    rows = made(seed)
    t = table(spark, rows)
    if bits is None:
        got = pt.rebuilt_trie(t)
    else:
        turns = pt.hashed_turns(t)
        got = pt.trie(turns, pt.lengths(turns), bits)
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=str) == brute(rows, bits is None)


def test_full_sketch_changes_nothing(spark, monkeypatch):
    """With every cell met twice all prefixes are grouped exactly; with cells at random tails may lie above nodes that look shared."""
    rows = made(3, 30)
    turns = pt.hashed_turns(table(spark, rows))
    real = pt.count_min
    for fill in (255, 0b10110111):
        monkeypatch.setattr(pt, "count_min", lambda d, bits: real(d, bits) | np.uint8(fill))
        got = [tuple(r) for r in pt.trie(turns, pt.lengths(turns)).collect()]
        assert sorted(got, key=str) == brute(rows, False)


def test_estimates_are_never_too_low(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, size=(3000, 2))
    keys[::3] = keys[0]
    twice = pt.count_min(spark.createDataFrame(keys.tolist(), "k1 bigint, k2 bigint").repartition(5), 15)
    may = np.ones(3000, bool)
    for row, at in zip(twice, pt.cells(keys[:, 0].copy(), keys[:, 1].copy(), 15)):
        may &= np.unpackbits(row)[at].astype(bool)
    assert may[::3].all() and 0 < may.sum() < 1400


def test_ids_in_slices(spark):
    ends = [(1, 1, i) for i in range(1000)] + [(2, 5, 7), (1, 2, -3)]
    got = {(r[0], r[1]): r[2] for r in pt.ids_sha256(spark.createDataFrame(ends, "k1 bigint, k2 bigint, conv_id bigint").repartition(7), 64).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 1): sha(range(1000)), (2, 5): sha([7]), (1, 2): sha([-3])}


def test_spelled(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a"), (2, 1, "v", None)]
    t = table(spark, rows)
    turns = pt.hashed_turns(t)
    nodes = pt.trie(turns, pt.lengths(turns))
    assert sorted((r["conv_id"], r["depth"], r["role"], r["text"]) for r in pt.spell(nodes, t).where("depth > 0").collect()) == [(1, 1, "u", "a"), (1, 2, "v", "b"), (2, 2, "v", "")]


def test_empty(spark):
    assert pt.rebuilt_trie(table(spark, [])).count() == 0
    assert pt.rebuilt_trie(table(spark, [(None, 1, "u", "x")])).count() == 0
