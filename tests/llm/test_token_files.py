"""Token files: exact round trips, random access, rows against the library."""

import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadhap.llm import token_files
from quadhap.llm.common import vocabulary_file
from tests.llm.conftest import ODD_TEXTS

PATH = vocabulary_file("byte_bpe_50k.json")


def opened(ids, sizes, docs):
    raw = b"".join(token_files.file_bytes(*(np.array(v, np.int64) for v in (ids, sizes, docs))))
    return token_files.TokenFile(lambda offset, size: raw[offset : offset + size]), raw


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(-(1 << 63), (1 << 63) - 1)), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_any_range_of_any_values(values, a, b):
    file, _ = opened(values, [len(values)], [1])
    assert file.values("ids").tolist() == values
    assert file.values("ids", a, b).tolist() == values[a:b]


def test_outliers_are_exceptions():
    values = [7] * 120 + [60_000] * 8
    small, raw = opened(values * 50, [1], [1])
    assert small.values("ids").tolist() == values * 50 and len(raw) < 50 * (10 + 8 * 9 + 8) + 400
    ids = list(range(1000))
    file, _ = opened(ids, [10, 0, 300, 690], [1, 2, 3, 4])
    assert file.document(2).tolist() == ids[10:310] and file.document(1).tolist() == []


def plain(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_rows_against_the_library(make, documents):
    docs = documents.select("doc_id", "text").unionByName(make([(9000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "x y"), (None, None), (9003, "b"), (9003, "b")]).select("doc_id", "text"))
    got = sorted((tuple(r) for r in token_files.encode_to_files(docs, PATH).collect()), key=lambda r: (r[1], r[2]))
    assert got == plain([tuple(r) for r in docs.collect()])


def test_several_files_of_a_task_and_empty(make, spark, tmp_path):
    docs = make([(i, f"text number {i} " * (i % 5)) for i in range(60)])
    manifest = token_files.write_token_files(docs, PATH, str(tmp_path), parts=2, file_ids=50)
    assert manifest.count() > 4
    got = sorted((tuple(r) for r in token_files.read_token_files(manifest, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert token_files.encode_to_files(docs.where("doc_id > 99"), PATH).count() == 0


def test_columns_equal_lists_and_the_library():
    rng = random.Random(5)
    bits = ["a", "é", " ", "  ", "\n", "\t", "'s", "1", "the", "...", "中", "　", "\x85", "<|endoftext|>", "\xa0", " ", " "]
    texts = [*ODD_TEXTS, *("".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000))]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 500, 1 << 24):
        got = []
        for data, ends in token_files.splitter(PATH).columns(pa.array(texts, pa.string()), size):
            ids = data.view("<u4").tolist()
            got += [ids[a // 4 : b // 4] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        assert got == want


def test_other_vocabularies_go_through_the_library(tmp_path):
    settings = json.loads(open(PATH).read())
    settings["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings))
    got = [ids.tolist() for ids, _ in token_files.encoded(pa.array(["Some TEXT", None, "x"]), str(other))]
    assert got == [Tokenizer.from_file(str(other)).encode(t, add_special_tokens=False).ids for t in ("Some TEXT", "", "x")]
    assert got[0] == Tokenizer.from_file(PATH).encode("some text", add_special_tokens=False).ids


def test_an_id_of_many_rows_is_split(make, tmp_path):
    docs = make([(1, f"{i % 7} {i}") for i in range(400)])
    manifest = token_files.write_token_files(docs, PATH, str(tmp_path), parts=4)
    assert len({r.part for r in manifest.collect()}) == 4
    got = sorted((tuple(r) for r in token_files.read_token_files(manifest, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
