"""Token ids in binary files of patched frame-of-reference blocks.

A file holds three streams: token ids, tokens per document, and document ids. A stream is cut
into blocks of 128 values. A block stores its minimum and, for each value, the difference to
it in ``width`` bits, where ``width`` is what the 90th percentile of the differences needs; what
does not fit is stored whole in an exception list of (place, value). The block starts are
indexed, so any range of values is read from its own blocks only.

Layout, little-endian: magic ``PFR1``; per stream a directory of (n_values, n_blocks, byte
offset) as unsigned 64-bit numbers; then each stream as n_blocks + 1 block starts (unsigned
64-bit, relative to the end of the index) and the blocks: minimum (signed 64-bit), width
(8 bits), number of exceptions (8 bits), packed differences, places (8 bits each), values
(unsigned 64-bit differences).

Rows are dealt by ranges of doc_id and written in ascending order of (doc_id, text); each task
writes one file under a name of its own and only names it in its result, so a repeated task
leaves an unused file and no half-written one is read.

Defined cases: null and empty texts hold only the end id; rows with a null id come first;
repeated rows and ids are written row by row, in order of their texts; an empty table writes
no file and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import functools
import json
import os
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.llm.common import cut_lineage, local_path, shared_folder
from quadhap.llm.pieces import Splitter, WordMemo, part_words
from quadhap.llm.prefix_bpe import letters_to_bytes, special_strings
from quadhap.operators.ranking import running_sums

BLOCK = 128
PERCENTILE = 90
END = 0
MAGIC = b"PFR1"
_NULL_ID = -(1 << 63)


HEAD = 10  # bytes in front of a block's packed differences


def pack_stream(values: np.ndarray) -> bytes:
    """One stream of signed 64-bit values: index of block starts, then blocks."""
    n = len(values)
    if not n:
        return struct.pack("<Q", 0)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1])]).astype(np.int64).reshape(blocks, BLOCK)
    least = padded.min(axis=1)
    diff = (padded - least[:, None]).view(np.uint64)
    at = np.partition(diff, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.zeros(blocks, np.int64)
    while at.any():
        width += at > 0
        at = at >> np.uint64(1)
    over = (diff >> np.minimum(width, 63).astype(np.uint64)[:, None] > 0) & (width < 64)[:, None]
    where, place = np.nonzero(over)
    counts = np.bincount(where, minlength=blocks)
    starts = np.concatenate([[0], np.cumsum(HEAD + width * (BLOCK // 8) + 9 * counts)])
    out = np.zeros(starts[-1], np.uint8)
    out[starts[:-1, None] + np.arange(8)] = least.view(np.uint8).reshape(-1, 8)
    out[starts[:-1] + 8], out[starts[:-1] + 9] = width, counts
    for w in np.unique(width[width > 0]).tolist():
        size = -(-w // 8)  # bytes that hold the width
        for some in _in_turn(np.flatnonzero(width == w)):
            low = np.ascontiguousarray(diff[some].view(np.uint8).reshape(-1, BLOCK, 8)[:, :, :size])
            bits = np.unpackbits(low, axis=2, bitorder="little")[:, :, :w]
            out[starts[some][:, None] + HEAD + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
    base = starts[where] + HEAD + width[where] * (BLOCK // 8)
    nth = np.arange(len(where)) - (np.cumsum(counts) - counts)[where]
    out[base + nth] = place
    out[(base + counts[where] + 8 * nth)[:, None] + np.arange(8)] = diff[where, place].view(np.uint8).reshape(-1, 8)
    return starts.astype("<u8").tobytes() + out.tobytes()


def _in_turn(blocks: np.ndarray, most: int = 4096):
    """Block numbers in groups whose bits fit into a cache."""
    return (blocks[i : i + most] for i in range(0, len(blocks), most))


def unpack_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Values of neighbouring blocks; ``starts``: their starts in ``raw`` and the last one's end."""
    head = np.frombuffer(raw, np.uint8)
    at = starts[:-1].astype(np.int64)
    least = head[at[:, None] + np.arange(8)].copy().view("<i8").ravel()
    width, counts = head[at + 8].astype(np.int64), head[at + 9].astype(np.int64)
    out = np.zeros((len(at), BLOCK, 8), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        size = -(-w // 8)
        for some in _in_turn(np.flatnonzero(width == w)):
            bits = np.unpackbits(head[at[some][:, None] + HEAD + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            out[some, :, :size] = np.packbits(bits, axis=2, bitorder="little")
    diff = out.view("<u8")[:, :, 0]
    where = np.repeat(np.arange(len(at)), counts)
    base = at[where] + HEAD + width[where] * (BLOCK // 8)
    nth = np.arange(len(where)) - (np.cumsum(counts) - counts)[where]
    diff[where, head[base + nth]] = head[(base + counts[where] + 8 * nth)[:, None] + np.arange(8)].copy().view("<u8").ravel()
    return (diff.view(np.int64) + least[:, None]).ravel()


class TokenFile:
    """Random access to one file; ``read(offset, size)`` gives bytes."""

    STREAMS = ("ids", "sizes", "docs")

    def __init__(self, read):
        self.read = read
        head = read(0, 4 + 24 * len(self.STREAMS))
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        self.directory = {s: struct.unpack_from("<QQQ", head, 4 + 24 * i) for i, s in enumerate(self.STREAMS)}

    def values(self, stream: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Values ``start:stop`` of a stream, from the blocks that hold them."""
        n, blocks, offset = self.directory[stream]
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        starts = np.frombuffer(self.read(offset + 8 * first, 8 * (last - first + 1)), "<u8")
        raw = self.read(offset + 8 * (blocks + 1) + int(starts[0]), int(starts[-1] - starts[0]))
        return unpack_blocks(raw, starts - starts[0])[start - first * BLOCK : stop - first * BLOCK]

    def document(self, nth: int) -> np.ndarray:
        """The ids of the ``nth`` document of the file."""
        begin = int(self.values("sizes", 0, nth).sum())
        return self.values("ids", begin, begin + int(self.values("sizes", nth, nth + 1)[0]))


def file_bytes(ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
    """The parts of a file, in order."""
    streams = [(len(v), pack_stream(v)) for v in (ids, sizes, docs)]
    head, offset = MAGIC, 4 + 24 * len(streams)
    for n, raw in streams:
        head += struct.pack("<QQQ", n, -(-n // BLOCK), offset)
        offset += len(raw)
    return [head, *(raw for _, raw in streams)]


@functools.cache
def splitter(path: str) -> Splitter:
    """Ids of text parts as unsigned 32-bit numbers, from the tokenizers library; one per worker and vocabulary.

    The vocabulary's model encodes each distinct word of the split pattern, written in the
    letters that byte-level vocabularies use for bytes. Parts that hold a special string go
    through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, special = Tokenizer.from_file(path), special_strings(path)
    model, letter_of = tokenizer.model, {b: c for c, b in letters_to_bytes().items()}
    letters = "".join(letter_of[b] for b in range(256))

    def word_ids(word: str) -> bytes:
        return array("I", [t.id for t in model.tokenize(codecs.charmap_decode(word.encode(), "strict", letters)[0])]).tobytes()

    memo = WordMemo(lambda words: {w: word_ids(w) for w in words})

    def compute(parts: list[str]) -> list[bytes]:
        together = " ".join(parts)
        held = [s for s in special if s in together]
        words = [None if held and any(s in p for s in held) else part_words(p) for p in parts]
        known = memo.load({w for ws in words if ws for w in ws})
        whole = lambda p: array("I", tokenizer.encode(p, add_special_tokens=False).ids).tobytes()
        return [whole(p) if ws is None else known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for p, ws in zip(parts, words)]

    return Splitter(compute, special, limit=1_600_000)


@functools.cache
def splits_by_pattern(path: str) -> bool:
    """Whether a vocabulary file cuts texts as :mod:`pieces` does: no normaliser, bytes as letters, the pattern of the byte-level vocabularies."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    cut = settings.get("pre_tokenizer") or {}
    return settings.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


def encoded(texts: pa.Array, path: str):
    """Ids of a column of texts in slices of it, each as (ids end to end, number of ids per text); other vocabularies than :func:`splits_by_pattern` go through the library text by text."""
    if splits_by_pattern(path):
        for data, ends in splitter(path).columns(texts):
            yield data.view("<u4"), np.diff(ends, prepend=0) // 4
        return
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for text in texts.to_pylist():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")
        yield ids, np.array([len(ids)], np.int64)


#: Documents of one file are encoded into memory up to this many ids; then the next file begins.
FILE_IDS = 2_000_000


def write_token_files(docs: DataFrame, path: str, folder: str, parts: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text and write its ids and the end id to files under ``folder``; returns the stored manifest ``part, nth, file, n_docs, n_ids, start``.

    (part, nth) is the files' order, ``start`` the ids in files before. The manifest has one row per file.
    """
    fs, _ = local_path(folder)
    fs.create_dir(local_path(folder)[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the beginning of the text orders as the text does and splits an id that many rows share
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches):
        files, base = local_path(folder)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, nth = 0, 0

        def store():
            nonlocal held, size, nth
            ids, sizes, doc_ids = (np.concatenate([h[i] for h in held]).astype(np.int64) for i in range(3))
            name = f"{base}/{uuid.uuid4().hex}.pfr"
            with files.open_output_stream(name) as f:
                for raw in file_bytes(ids, sizes, doc_ids):
                    f.write(raw)
            row = pa.RecordBatch.from_pydict({"nth": pa.array([nth], pa.int32()), "file": [name], "n_docs": [len(sizes)], "n_ids": [len(ids)]})
            held, size, nth = [], 0, nth + 1
            return row

        for b in batches:
            doc_ids, done = b.column(0).fill_null(_NULL_ID).to_numpy(), 0
            for ids, counts in encoded(b.column(1), path):
                ids, sizes = np.insert(ids, np.cumsum(counts), END), counts + 1
                ends, begin, taken = np.cumsum(sizes), 0, 0
                while begin < len(sizes):
                    # up to the document that fills the file
                    stop = min(int(np.searchsorted(ends, taken + file_ids - size)) + 1, len(sizes))
                    upto = int(ends[stop - 1])
                    held.append((ids[taken:upto], sizes[begin:stop], doc_ids[done + begin : done + stop]))
                    size += upto - taken
                    begin, taken = stop, upto
                    if size >= file_ids:
                        yield store()
                done += len(sizes)
        if held:
            yield store()

    written = ordered.mapInArrow(run, "nth int, file string, n_docs bigint, n_ids bigint").select(F.spark_partition_id().alias("part"), "*")
    stored = cut_lineage(written)
    summed = running_sums(stored, [], F.col("part"), [F.col("nth")], {"upto": F.col("n_ids")})
    return summed.withColumn("start", F.col("upto") - F.col("n_ids")).drop("upto")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the manifest's files, a file at a time."""

    def run(batches):
        files, _ = local_path(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_input_file(name) as f:
                    file = TokenFile(lambda offset, size, f=f: f.read_at(size, offset))
                    sizes, docs = file.values("sizes"), file.values("docs")
                    ids = file.values("ids").astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NULL_ID), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = manifest.select("file", "start")
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(n, 1)).mapInArrow(run, READ)


def encode_to_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write token files under ``folder`` (by default one of its own in the shared folder) and read every document back from them."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, path, folder), folder)
