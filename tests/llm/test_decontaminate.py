"""Benchmark passages against brute force."""

import hashlib
import random
import re

import pytest

from quadhap.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(text, items, window):
    w = plain_words(text)
    hit, ids = set(), set()
    for i, t in items:
        v = plain_words(t)
        size = min(len(v), window)
        for s in range(len(v) - size + 1) if size else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[s : s + size]:
                    hit.update(range(at, at + size))
                    ids.add(i)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 12])
def test_random_texts_of_few_words(spark, make, shard_words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c1", "é", "a"]) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 2, 3, 4, 5, 8, 12]) if i % 4 else rng.randint(5, 12))) for i in range(3, 14)]
    items = [(i, t) for i, t in items if len(plain_words(t)) != 1] + [("99", None), ("98", ""), ("3", "é c1 b b b a")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(90, None), (91, ""), (5, "a b c1 é"), (5, "a b c1 é"), (None, text(20))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.judge(decontaminate.find_hits(make(rows), bench, 4, shard_words)).collect()
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in found) == sorted((d or -1, *plain(t, items, 4)) for d, t in rows)


def test_real_rows(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    rows = [tuple(r) for r in documents.select("doc_id", "text").where("length(text) < 3000").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.judge(decontaminate.find_hits(documents, bench)).collect()}
    assert {d: got[d] for d, _ in rows} == {d: plain(t, items, 13) for d, t in rows}
    assert any(r[4] for r in got.values()) and any(not r[4] for r in got.values())


def test_cutting_and_dropping(spark, make):
    passage = " ".join(f"word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage.upper())], "item_id bigint, text string")
    docs = make([(1, f"Before it, {passage}; after."), (2, "Clean text."), (3, None), (4, passage + " filler" * 900), (5, "")])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut == {1: "Before it, ; after.", 2: "Clean text.", 3: None, 4: " filler" * 900, 5: ""}
    spared = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, least_words=50).collect()}
    assert spared[1] == "Before it, ; after." and spared[4].startswith("word0")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 12])
def test_items_without_an_id(spark, make, shard_words):
    long, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    bench = spark.createDataFrame([(None, long), (None, "short one"), ("7", other), (None, other), (None, None)], "item_id string, text string")
    docs = make([(1, f"x {long} y"), (2, "a short one here"), (3, f"z {other}"), (4, "clean text")])
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.judge(decontaminate.find_hits(docs, bench, shard_words=shard_words)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (20, 0, sha(""), True), 2: (2, 0, sha(""), True), 3: (20, 1, sha("7"), True), 4: (0, 0, sha(""), False)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [4]


def test_empty_sides(spark, make):
    docs, none = make([(1, "a b"), (2, None)]), spark.createDataFrame([], "item_id bigint, text string")
    assert {r["contaminated"] for r in decontaminate.judge(decontaminate.find_hits(docs, none)).collect()} == {False}
    assert decontaminate.judge(decontaminate.find_hits(docs.where("doc_id > 9"), none)).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == 2
