"""Byte-level BPE encoding and decoding of a table of texts, by prefix dynamic programming (:mod:`prefix_bpe`).

Defined cases: null and empty texts have no tokens; repeated rows and ids are encoded row by
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.llm.pieces import Splitter, WordMemo, part_words
from quadhap.llm.prefix_bpe import from_ranks

IDS = "doc_id bigint, ids array<int>"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def part_encoder(path: str):
    """A function from text parts to their ids, written as decimals with a comma behind each."""
    bpe = from_ranks(path)

    def encoded(words: set[str]) -> dict[str, bytes]:
        ids = bpe.encode_all([w.encode() for w in words])
        return {w.decode(): b"".join([b"%d," % i for i in v]) for w, v in ids.items()}

    memo = WordMemo(encoded)

    def compute(parts: list[str]) -> list[bytes]:
        words = [part_words(p) for p in parts]
        text = memo.load({w for ws in words for w in ws})
        return [b"".join([text[w] for w in ws]) for ws in words]

    return compute


@functools.cache
def splitter(path: str) -> Splitter:
    """One per worker and vocabulary, so what is remembered serves all its tasks."""
    return Splitter(part_encoder(path), limit=500_000)


@functools.cache
def decoder(path: str) -> dict[bytes, bytes]:
    """Bytes of a token by its id in decimals."""
    return {b"%d" % i: t for t, i in from_ranks(path).ids.items()}


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: token ids of every whole text, in text order."""

    def run(batches):
        for b in batches:
            ids = [[int(i) for i in b"".join(v).split(b",")[:-1]] for v in splitter(path).values(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes``: the bytes that the ids of :func:`encode` stand for; a null list stands for none."""

    def run(batches):
        table = {int(k): v for k, v in decoder(path).items()}
        for b in batches:
            raw = [b"".join([table[i] for i in ids or []]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes every whole text and decodes its ids in the same task, so that neither leaves it."""

    def run(batches):
        table = decoder(path).__getitem__
        for b in batches:
            counts, coded, decoded = [], [], []
            for v in splitter(path).values(b.column(1).to_pylist()):
                ids = b"".join(v)[:-1]
                tokens = ids.split(b",") if ids else []
                counts.append(len(tokens))
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(table, tokens))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, DIGESTS)
