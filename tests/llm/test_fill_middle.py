"""Fill-in-the-middle against a plain re-computation."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quadhap.llm import fill_middle as fim
from tests.llm.conftest import ODD_TEXTS

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(doc, text, rate=fim.RATE, first=fim.SUFFIX_FIRST):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if doc is None else doc}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc, len(units), "plain", None, None, sha(text), sha(text))
    p, m, s = parts
    spm = h[3] % 100 < first
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc, len(units), "spm" if spm else "psm", len(p), len(m), sha(out), sha(text))


TEXTS = [*ODD_TEXTS, "<P>", "a <S> b", "<M", "<<S", "a > b < c", "P> a <S", "$1 \\2 {3}+ (x", "\x1c\x85 a", "a\x0b\x0c b ", "wörter " * 40_000, " " * 50_000, "x" * 200_000, "\n"]


def test_against_plain_units(spark, make):
    rng = random.Random(5)
    words = ["a", "bb", "é", "😀", " ", "\n", "<", "S>", "<P", "$2"]
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "a b c d"), (7, "twice"), (7, "twice"), (-3, "minus one")]
    rows += [(1000 + i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(30)))) for i in range(300)]
    docs = make(rows).withColumn("output", F.lit("mine")).withColumn("n", F.lit("x")).withColumn("h", F.lit(1))
    got = [tuple(r) for r in fim.summarise(fim.fill_in_middle(docs)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_rates(make):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    changed = fim.fill_in_middle(make(rows).withColumn("h", F.lit(1)), rate=100, suffix_first=0)
    assert {"h", "output", "row", "spans"} <= set(changed.columns)
    got = {r["doc_id"]: (r["form"], r["output"]) for r in changed.collect()}
    assert {f for f, _ in got.values()} == {"plain", "psm"}
    assert all(sha(out) == brute(*rows[i], 100, 0)[5] for i, (_, out) in got.items())


def test_empty(make):
    assert fim.summarise(fim.fill_in_middle(make([]))).count() == 0
