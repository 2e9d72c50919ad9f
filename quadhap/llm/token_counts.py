"""Token counts by a finite-state transducer that is compiled as texts need it.

A state holds what of the bytes read so far can still matter: the longest suffix that some
token begins with and, for each place in it where a token may begin, the last token before
that place and how many tokens ago it is. Words with different beginnings come to the same
states. A transition, from a state and a byte to a state and the change in the number of tokens
(a merge with earlier tokens makes it zero or negative), is worked out once, stored and
walked from then on; emissions along a word add up to its token count. States are numbers in
a table with a bound, behind which it is compiled anew. Whole parts of text are jumps from the
start state, remembered once their bytes were walked.

A text beyond ``chunk`` characters is cut into chunks that different tasks count. The state a
chunk starts in is unknown, so its map from start state to end state and count is kept in
closed form: what stands before the first place where the transducer returns to its start
state whatever came before, the count from there to the last such place, and what stands
behind it. These maps compose associatively; a prefix scan over a text's chunks gives its
count.

Defined cases: null and empty texts have no bytes and no tokens; rows are counted one by one,
repeated ids too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.llm.pieces import WHITE, Splitter, WordMemo, find_words, part_words
from quadhap.llm.prefix_bpe import PrefixBpe, from_json, special_strings

CHUNK = 1 << 15


_SHIFT, _ZERO = 20, 1 << 19


class Transducer:
    """The counting transducer of one vocabulary; state 0 is the start of a word.

    ``limit``: states that are held; a word never loses those it walks through.
    """

    def __init__(self, bpe: PrefixBpe, limit: int = 300_000):
        self.bpe, self.limit = bpe, limit
        self.begins = {t[:i] for t in bpe.ids for i in range(1, len(t))}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(b"", ((0, None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.transitions: dict[int, int] = {}

    def compile(self, state: int, byte: int) -> int:
        """Store and return the transition of a state by a byte, as next state and emission in one number."""
        suffix, places = self.states[state]
        grown, bpe = suffix + bytes((byte,)), self.bpe
        # places from the longest suffix to the shortest; exactly one of their tokens is valid
        for length, last, ago in places:
            token = bpe.ids.get(grown[len(grown) - length - 1 :])
            if token is not None and (bpe.edges(token) is not None if last is None else bpe.agree(last, token)):
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        emitted = 1 - ago
        after = tuple((n + 1, before, gone + emitted) for n, before, gone in places if grown[len(grown) - n - 1 :] in self.begins) + ((0, token, 0),)
        key = (grown[len(grown) - after[0][0] :], after)
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        out = self.transitions[state << 8 | byte] = number << _SHIFT | (emitted + _ZERO)
        return out

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the emission."""
        to = self.transitions.get(state << 8 | byte)
        if to is None:
            to = self.compile(state, byte)
        return to >> _SHIFT, (to & (1 << _SHIFT) - 1) - _ZERO

    def count(self, word: bytes) -> int:
        """The emissions along a word, as :meth:`step` gives them."""
        state, total, get = 0, 0, self.transitions.get
        for byte in word:
            to = get(state << 8 | byte)
            if to is None:
                to = self.compile(state, byte)
            state = to >> _SHIFT
            total += (to & (1 << _SHIFT) - 1) - _ZERO
        return total

    def words(self, words: set[str]) -> dict[str, int]:
        """Counts of many words."""
        out = {}
        for word in words:
            if len(self.states) > self.limit:
                self.reset()
            out[word] = self.count(word.encode())
        return out


@functools.cache
def splitter(path: str) -> Splitter:
    """Counts of text parts; one per worker and vocabulary."""
    memo, special = WordMemo(Transducer(from_json(path)).words), special_strings(path)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def compute(parts: list[str]) -> list[int]:
        fixed, words = [], []
        for p in parts:
            if cut is not None and cut.search(p):
                sections = cut.split(p)
                fixed.append(len(sections) // 2)
                words.append([w for s in sections[::2] for w in find_words(s)])
            else:
                fixed.append(0)
                words.append(part_words(p))
        count = memo.load({w for ws in words for w in ws})
        return [n + sum([count[w] for w in ws]) for n, ws in zip(fixed, words)]

    return Splitter(compute, special)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Token counts of whole texts."""
    return [sum(v) for v in splitter(path).values(texts)]


_NO_WHITE = f"[^{re.escape(WHITE)}]"
_RESET = re.compile(f"(?<={_NO_WHITE}) ")


def chunk_map(piece: str, path: str) -> tuple[str, int, str | None]:
    """(head, count, tail) of one chunk; tail None: no place in it is certain to be a start state, head is all of it."""
    first = _RESET.search(piece)
    if first is None:
        return piece, 0, None
    start = end = first.start()
    for place in _RESET.finditer(piece, start):
        end = place.start()
    return piece[:start], count_texts([piece[start:end]], path)[0], piece[end:]


def compose(a: tuple, b: tuple, path: str) -> tuple:
    """The map of two neighbouring chunks."""
    if a[2] is None:
        return a[0] + b[0], b[1], b[2]
    if b[2] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + b[1] + count_texts([a[2] + b[0]], path)[0], b[2]


def scan(maps: list[tuple], path: str) -> int:
    """Count of a whole text from its chunks' maps, composed pairwise in a logarithmic number of rounds."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], path) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    head, n, tail = maps[0]
    return n + sum(count_texts([head, tail], path))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > 4 * chunk

    def short_texts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(count_texts(b.column(2).to_pylist(), path), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches):
        for b in batches:
            for key, doc, size, text in zip(*(c.to_pylist() for c in b.columns)):
                for seq in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_pydict({"row": [key], "doc_id": pa.array([doc], pa.int64()), "n_bytes": [size], "seq": [seq // chunk], "piece": [text[seq : seq + chunk]]})

    def maps(batches):
        for b in batches:
            found = [chunk_map(p, path) for p in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))], ["row", "doc_id", "n_bytes", "seq", "head", "n", "tail"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        n = scan([(h, int(c), None if t is None or t is pd.NA or t != t else t) for h, c, t in zip(rows["head"], rows["n"], rows["tail"])], path)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "n_bytes": rows["n_bytes"].iloc[:1], "n_tokens": [n]})

    sized = texts.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    short = sized.where(~long).select("doc_id", "n_bytes", "text").mapInArrow(short_texts, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    pieces = sized.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text").mapInArrow(cut, "row bigint, doc_id bigint, n_bytes bigint, seq bigint, piece string")
    mapped = pieces.repartition("row", "seq").mapInArrow(maps, "row bigint, doc_id bigint, n_bytes bigint, seq bigint, head string, n bigint, tail string")
    return short.unionByName(mapped.groupBy("row").applyInPandas(total, "doc_id bigint, n_bytes bigint, n_tokens bigint"))
