"""Token counts and byte-pair encoding against the libraries they must equal."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quadhap.llm import bpe_encode, token_counts
from quadhap.llm.common import vocabulary_file
from quadhap.llm.pieces import find_words
from quadhap.llm.prefix_bpe import from_json, from_ranks
from tests.llm.conftest import ODD_TEXTS

JSON, RANKS = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "²", "x", "the", "!", "...", "中", "　", "\x85", "\x1c", "​", "Ⅷ", "😀", "aaa", "-", "\r\n", "ﬁ", "'ll", "S", "\xa0", "<|endoftext|>", " ", " "]
    return ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library():
    texts = [*odd(1, 4000), *ODD_TEXTS]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_counts.count_texts(texts, JSON) == want


def test_encoding_equals_the_library(library):
    texts = [*odd(2, 4000), *ODD_TEXTS]
    got = [[int(i) for i in b"".join(v).split(b",")[:-1]] for v in bpe_encode.splitter(RANKS).values(texts)]
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_every_token_of_the_vocabulary(library):
    bpe = from_ranks(RANKS)
    words = [t for t in bpe.ids if t.decode("utf-8", "ignore").encode() == t]
    for w in words:
        assert [bpe.encode(p.encode()) for p in find_words(w.decode())] == [library.encode_ordinary(p) for p in find_words(w.decode())]


@pytest.mark.parametrize("chunk", [4, 50, token_counts.CHUNK])
def test_count_rows(make, documents, chunk):
    texts = [t for t in odd(3, 150)] + ["".join(odd(4, 60)), *ODD_TEXTS] if chunk > 4 else [t for t in ODD_TEXTS if len(t or "") < 1000]
    docs = make([(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "a b c")]).select("doc_id", "text")
    if chunk == token_counts.CHUNK:
        docs = docs.unionByName(documents.selectExpr("doc_id + 5000 as doc_id", "text")).unionByName(make([(7000, ("some words, then more " * 9000)), (7001, "z" * 150_000), (7002, " \n" * 80_000)]).select("doc_id", "text"))
    t = Tokenizer.from_file(JSON)
    want = sorted((d if d is not None else -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in map(tuple, docs.collect()))
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in token_counts.count_tokens(docs, JSON, chunk).collect()) == want


def test_chunk_maps_compose_in_any_grouping():
    text = "".join(odd(5, 40)) + " some plain words here. " * 30
    want = len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids)
    for size in (3, 17, 64):
        maps = [token_counts.chunk_map(text[i : i + size], JSON) for i in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = token_counts.compose(left, m, JSON)
        assert token_counts.scan(maps, JSON) == token_counts.scan([left], JSON) == want


def test_transducer_emissions_add_up():
    machine = token_counts.Transducer(from_json(JSON))
    library, state, total = Tokenizer.from_file(JSON), 0, 0
    word = " tokenizations".encode()
    for at in range(len(word)):
        state, emitted = machine.step(state, word[at])
        total += emitted
        assert total == len(library.encode(word[: at + 1].decode(), add_special_tokens=False).ids)
    assert machine.count(word) == total


def test_transducer_states_are_shared_and_bounded():
    library = Tokenizer.from_file(JSON)
    rng = random.Random(9)
    words = {" " + "".join(rng.choice("etaoinsé") for _ in range(rng.randint(1, 14))) for _ in range(2000)} | {"e" * 5000, "né" * 300}
    want = {w: len(library.encode(w, add_special_tokens=False).ids) for w in words}
    machine, small = token_counts.Transducer(from_json(JSON)), token_counts.Transducer(from_json(JSON), limit=50)
    assert machine.words(words) == want == small.words(words)
    assert len(machine.transitions) < sum(len(w.encode()) for w in words) / 2
    stored = len(machine.transitions)
    assert machine.words(words) == want and len(machine.transitions) == stored


def test_appends_and_edits_are_exact():
    bpe, rng = from_ranks(RANKS), random.Random(6)
    for _ in range(150):
        word = bytes(rng.choice(b"abcdenrst") for _ in range(rng.randint(0, 300)))
        last = bpe.last_tokens(word)
        more = word + b"ation"
        grown = list(last)
        bpe.extend(more, grown, len(more))
        assert grown == bpe.last_tokens(more)
        a = rng.randint(0, len(word))
        b = rng.randint(a, min(len(word), a + 5))
        changed, edited = bpe.reencode(word, last, a, b, b"xyz"[: rng.randint(0, 3)])
        assert edited == bpe.last_tokens(changed)


def test_round_trip_rows(make, documents, library):
    docs = documents.select("doc_id", "text").unionByName(make([(9000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a b"), (9001, "again"), (9001, "again")]).select("doc_id", "text"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in map(tuple, docs.collect()):
        ids = library.encode_ordinary(t or "")
        want.append((d if d is not None else -1, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    got = [(r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in bpe_encode.round_trip(docs, RANKS).collect()]
    assert sorted(got) == sorted(want)
    back = bpe_encode.decode(bpe_encode.encode(docs.where("doc_id < 50"), RANKS), RANKS).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(bytes(r["bytes"]).decode() == (texts[r["doc_id"]] or "") for r in back) and back
    assert bpe_encode.round_trip(docs.where("doc_id < -5"), RANKS).count() == 0
