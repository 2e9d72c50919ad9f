"""Benchmark passages in documents, found with a generalised suffix automaton of the benchmark's words.

Words are runs of ASCII letters, digits and non-ASCII characters, ``A-Z`` lower-cased. The
automaton of all items is built once per shard of at most ``shard_words`` benchmark words (the
bound on what is collected and broadcast; more shards follow one another, each over all
documents). Documents stream through it: at each word it knows the longest run that ends
there and occurs in an item. Runs of at least ``window`` words, and whole items that are shorter,
are hits. Stretches too short to hold a hit are skipped by a test for known neighbouring words,
which loses none.

Defined cases: null texts and texts without words have no hits; items with null or empty text
have no windows; items with a null id have windows, which count as hits but name no item; items are rows, so a repeated item id counts once in the list of ids but its
rows' texts all count; repeated documents are judged row by row; empty tables on either side
give documents without hits, or no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHARD_WORDS = 2_000_000
#: A document is contaminated if hits make up at least one word in this many.
SHARE = 20

_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SLOTS = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _slot(a, b):
    return (a * 2654435761 + b * 40503) & (_SLOTS - 1)


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers (1, 2, …), with what each state means for hits."""

    window: int
    words: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: dict[int, set[str]] = field(default_factory=dict)  # state of exactly the last ``window`` words -> items
    short: dict[int, dict[int, set[str]]] = field(default_factory=dict)  # state -> length of a whole short item -> items
    least: int = 0
    near: np.ndarray | None = None

    def _append(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            to = nxt[last][w]
            return to if length[to] == length[last] + 1 else self._divide(last, w, to)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            to = nxt[p][w]
            link[new] = to if length[to] == length[p] + 1 else self._divide(p, w, to)
        return new

    def _divide(self, p: int, w: int, old: int) -> int:
        """Split off the part of ``old`` that also ends where ``p`` followed by ``w`` does."""
        twin = len(self.next)
        self.next.append(dict(self.next[old]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[old])
        self.link[old] = twin
        while p != -1 and self.next[p].get(w) == old:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The longest known run that ends with the next word: its state and length."""
        nxt, link, length = self.next, self.link, self.length
        while state and w not in nxt[state]:
            state = link[state]
            n = length[state]
        return (nxt[state][w], n + 1) if w in nxt[state] else (0, 0)

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a run that is at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Automaton:
    """The automaton of (item id, text) pairs; texts without an id have windows, but are in no list of items."""
    a = Automaton(window)
    texts = [(i, [a.words.setdefault(w, len(a.words) + 1) for w in words_of(t)]) for i, t in items]
    texts = [(i, t) for i, t in texts if t]
    for _, t in texts:
        state = 0
        for w in t:
            state = a._append(state, w)
    a.near = np.zeros(_SLOTS, bool)
    for i, t in texts:
        ids = () if i is None else (i,)
        state = n = 0
        for at, w in enumerate(t):
            state, n = a.step(state, n, w)
            if n >= window:
                a.items.setdefault(a.window_state(state), set()).update(ids)
            if at:
                a.near[_slot(t[at - 1], w)] = True
        if len(t) < window:
            a.short.setdefault(state, {}).setdefault(len(t), set()).update(ids)
    a.least = min((min(len(t), window) for _, t in texts), default=0)
    return a


def hits(words: list[bytes], a: Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans (end exclusive, merged) covered by windows of the automaton, and the items they belong to."""
    if not a.least or len(words) < a.least:
        return [], set()
    ids = np.fromiter(map(a.words.get, words, repeat(0)), np.int64, len(words))
    known = ids > 0
    pair = np.concatenate([[False], known[1:] & known[:-1] & a.near[_slot(ids[:-1], ids[1:])]])
    starts = np.flatnonzero(known & ~pair)  # a run goes on while neighbouring words are known neighbours
    if not len(starts):
        return [], set()
    ends = np.flatnonzero(known & ~np.append(pair[1:], False)) + 1
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    window, link, short = a.window, a.link, a.short
    for begin, end in zip(starts[ends - starts >= a.least].tolist(), ends[ends - starts >= a.least].tolist()):
        state = n = 0
        for at, w in enumerate(ids[begin:end].tolist(), begin):
            state, n = a.step(state, n, w)
            covered = 0
            if n >= window:
                covered = window
                items |= a.items.get(a.window_state(state), set())
            if short:
                s = state
                while s > 0:
                    for size, found in short.get(s, {}).items():
                        if size <= n:
                            covered = max(covered, size)
                            items |= found
                    s = link[s]
            if covered:
                if spans and spans[-1][1] >= at + 1 - covered:
                    spans[-1] = (min(spans[-1][0], at + 1 - covered), at + 1)
                else:
                    spans.append((at + 1 - covered, at + 1))
                while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                    last = spans.pop()
                    spans[-1] = (min(spans[-1][0], last[0]), last[1])
    return spans, items


def shards(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS):
    """Automata over the whole benchmark, each of at most ``shard_words`` words (or one item that is longer)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    group: list[tuple[str | None, str]] = []
    size = 0
    for row in rows.where("text is not null").toLocalIterator():
        n = len(words_of(row["text"]))
        if group and size + n > shard_words:
            yield build(group, window)
            group, size = [], 0
        group.append((row["id"], row["text"]))
        size += n
    yield build(group, window)


FOUND = "row bigint, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``row, doc_id, n_words, spans, items`` for every document row: covered words (first, last) and the items they come from."""
    automata = shards(benchmark, window, shard_words)

    def part(a: Automaton) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(a)

        def run(batches):
            for b in batches:
                counts, spans, items = [], [], []
                for text in b.column(2).to_pylist():
                    words = words_of(text)
                    s, i = hits(words, shared.value)
                    counts.append(len(words))
                    spans.append([{"first": x, "last": y - 1} for x, y in s])
                    items.append(sorted(i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    ["row", "doc_id", "n_words", "spans", "items"],
                )

        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, FOUND)

    parts = [part(a) for a in automata]
    if len(parts) == 1:
        return parts[0]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.withColumn("spans", _merged(F.col("spans")))


def _merged(spans):
    """Sorted spans with overlapping ones joined."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last")))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= s["first"] - 1), joined).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(spans), none, add)


def judge(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Counts, item digest and verdict from :func:`find_hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    sized = found.withColumn("n_hit", n_hit)
    return sized.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_spans(text: str | None, a: Automaton, least_words: int, share: int) -> str | None:
    """The text without its hit passages of at least ``least_words`` words, or without all of them if they make up one word in ``share``."""
    words = words_of(text)
    spans, _ = hits(words, a)
    covered = sum(y - x for x, y in spans)
    if not spans:
        return text
    gone = [s for s in spans if s[1] - s[0] >= least_words or covered * share >= len(words)]
    at = [m.span() for m in _WORD.finditer(text)]
    for x, y in reversed(gone):
        text = text[: at[x][0]] + text[at[y - 1][1] :]
    return text


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents, own columns and order of columns kept, with benchmark passages cut out of ``text``."""
    column, schema = docs.columns.index("text"), docs.schema
    for a in shards(benchmark, window):
        shared = docs.sparkSession.sparkContext.broadcast(a)

        def run(batches, shared=shared):
            for b in batches:
                texts = pa.array([clean_spans(t, shared.value, least_words, share) for t in b.column(column).to_pylist()], b.schema.field(column).type)
                yield b.set_column(column, b.schema.field(column), texts)

        docs = docs.mapInArrow(run, schema)
    return docs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated by all of the benchmark's shards together, columns kept."""
    column, schema = docs.columns.index("text"), docs.schema
    automata = [docs.sparkSession.sparkContext.broadcast(a) for a in shards(benchmark, window)]

    def clean(text: str | None) -> bool:
        words = words_of(text)
        covered = np.zeros(len(words), bool)
        for a in automata:
            for x, y in hits(words, a.value)[0]:
                covered[x:y] = True
        return not (covered.any() and share * int(covered.sum()) >= len(words))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([clean(t) for t in b.column(column).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
