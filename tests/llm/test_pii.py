"""Personal data: base spans against a plain reading of their patterns, checksums, scores."""

import hashlib
import re

import pytest

from quadhap.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


TEXTS = [
    None, "", "a@b.c", "x a@b.c_d@e.f y", "..@a.b-c.d.", "a@@b.c a@b c@d.e.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255 1.1.1.0256",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "41111111111111111111111", "12 4111111111111111", "4111  1111 1111 1111", "+1 (555) 010-9999", "+1 5", "++49 30 1234567 +49", "😀é +49 30 1234567, ü@ü.de b@ü.de",
    "1" * 4_000, "a" * 4_000 + "@", "1.2.3." * 3000, "+1" + " " * 5000, "k@l.mn " * 2000, "4111-1111-1111-1111 " * 300, "user%+-._@host.example.org", "a@b..c", "a@b.c.", "5500005555555559 5500 0055 5555 5559",
]


def test_base_spans(spark, make, documents):
    docs = make([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a@b.c")]).unionByName(documents.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "1L as row", "'' as spans"))
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted((i if i is not None else -1, hashlib.sha256(",".join(plain(t)).encode()).hexdigest(), *(sum(s.startswith(k + ":") for s in plain(t)) for k in PLAIN)) for i, t in texts)
    got = pii.summarise(pii.find_pii(docs)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    assert sum(r["n_email"] for r in got) > 2000
    for r in got:
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


@pytest.mark.parametrize(("text", "kinds"), [
    ("my iban is GB82 WEST 1234 5698 7654 32 thanks", ["iban"]),
    ("my iban is GB83 WEST 1234 5698 7654 32 thanks", []),
    ("DE89370400440532013000", ["iban"]),
    ("SSN 123-45-6789", ["ssn"]),
    ("part 123-45-6789", []),
    ("SSN 666-45-6789 and 123-00-6789", []),
])
def test_added_kinds(make, text, kinds):
    found = pii.find_pii(make([(1, text)])).first()["spans"]
    assert [s["kind"] for s in found if s["kind"] not in pii.BASE] == kinds
    assert all(text[s["start"] : s["end"]] == s["value"] and 0 <= s["score"] <= 1 for s in found)


@pytest.mark.parametrize(("text", "values"), [
    ("iban DE89370400440532013000 Bitte zahlen", ["DE89370400440532013000"]),
    ("iban DE89 3704 0044 0532 0130 00 Please pay", ["DE89 3704 0044 0532 0130 00"]),
    ("iban DE89 3704 0044 0532 0130 00 IN FULL", ["DE89 3704 0044 0532 0130 00"]),
    ("iban ES91 2100 0418 4502 0005 1332 BANK", ["ES91 2100 0418 4502 0005 1332"]),
    ("iban DE89 3704 0044 0532 0130 00 4711", ["DE89 3704 0044 0532 0130 00"]),
    ("iban DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ("iban NO9386011117947 A und BE68539007547034 B", ["NO9386011117947", "BE68539007547034"]),
    ("iban ZZ22 3704 0044 0532 0130 00 Please pay", ["ZZ22 3704 0044 0532 0130 00"]),
    ("iban DE89370400440532013000Bitte", []),
])
def test_account_number_before_other_words(make, text, values):
    found = pii.find_pii(make([(1, text)])).first()["spans"]
    assert [s["value"] for s in found if s["kind"] == "iban"] == values
    assert all(text[s["start"] : s["end"]] == s["value"] for s in found)


def test_context_raises_the_score(make):
    near, far = (pii.find_pii(make([(1, t)])).first()["spans"][0]["score"] for t in ("credit card 4111111111111111", "number 4111111111111111"))
    assert near > far


def test_redact_and_empty(make):
    assert pii.redact(make([(1, "mail a@b.co or c@d.io"), (2, None)])).orderBy("doc_id").collect()[0]["text"] == "mail [email] or [email]"
    assert pii.summarise(pii.find_pii(make([(1, "a")]).where("doc_id > 5"))).count() == 0
