"""k-mers packed into numbers, and super-k-mers.

A base takes two bits, A C G T in this order, so numbers compare like the k-mers they stand
for. A signed 64-bit number holds up to 31 bases: k-mers up to 31 are one ``bigint``, longer
ones a struct of as many as needed. Reverse complements and windows are bit arithmetic.

A super-k-mer is a run of bases whose k-mers share their minimiser, the least hash of their
m-mers over both strands. A k-mer and its reverse complement have the same minimiser, so all
occurrences of both meet in one partition when runs are dealt by it, at a few bytes per k-mer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 31
_FULL = (1 << 2 * WORD) - 1
#: Super-k-mers a task holds before it folds equal ones, and bases it packs at a time.
HELD = 1 << 19
SLICE = 1 << 18


def sizes(k: int) -> list[int]:
    """Bases in each number of a k-mer."""
    return [WORD] * ((k - 1) // WORD) + [(k - 1) % WORD + 1]


def minimiser_size(k: int) -> int:
    """Long enough that there are many minimisers, short enough that runs are long."""
    return max(1, min(13, k, (k + 2) // 2))


def pack_words(bases: Column) -> Column:
    """The 31-base numbers of a string of A C G T, and a zero behind them."""
    chunks = F.regexp_extract_all(bases, F.lit(f".{{1,{WORD}}}"), F.lit(0))
    digits = lambda c: F.rpad(F.translate(c, "ACGT", "0123"), WORD, "0")
    return F.array_append(F.transform(chunks, lambda c: F.conv(digits(c), 4, 10).cast("bigint")), F.lit(0).cast("bigint"))


def _shift(way: str, value: Column, by: Column) -> Column:
    return F.call_function(way, value, by.cast("int"))


def _window(words: Column, at: Column) -> Column:
    """31 bases from place ``at`` on."""
    q, r = F.floor(at / WORD).cast("int"), (at % WORD) * 2
    return _shift("shiftleft", F.get(words, q), r).bitwiseAND(F.lit(_FULL)).bitwiseOR(_shift("shiftright", F.get(words, q + 1), 2 * WORD - r))


def _joined(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"b{i}") for i, p in enumerate(parts)])


def _split(kmer: Column, k: int) -> list[Column]:
    return [kmer] if k <= WORD else [kmer[f"b{i}"] for i in range(len(sizes(k)))]


def kmer_at(words: Column, at: Column, k: int) -> Column:
    """The packed k-mer from place ``at`` on."""
    return _joined([F.shiftright(_window(words, at + WORD * i), 2 * (WORD - n)) for i, n in enumerate(sizes(k))])


_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def with_reverse(df: DataFrame, k: int, out: str = "reverse") -> DataFrame:
    """The reverse complement of ``kmer`` as column ``out``.

    Each step is a projection of its own: a step reads its input twice, so as one expression
    they would double five times, and the compiled code would be too long to be optimised.
    """
    last, names = sizes(k)[-1], [f"_{out}{i}" for i in range(len(sizes(k)))]
    flipped = {name: F.bitwise_not(p).bitwiseAND(F.lit((1 << 2 * n) - 1)) for name, p, n in zip(names, _split(F.col("kmer"), k), sizes(k))}
    df = df.withColumns(flipped)
    for step, mask in _SWAPS:
        m = F.lit(mask)
        df = df.withColumns({n: F.shiftrightunsigned(n, step).bitwiseAND(m).bitwiseOR(F.shiftleft(F.col(n).bitwiseAND(m), step)) for n in names})
    back = [F.shiftrightunsigned(name, 64 - 2 * n) for name, n in zip(names, sizes(k))][::-1]
    parts = []
    for a, b in zip(back, back[1:]):
        head = F.shiftleft(a, 2 * (WORD - last)).bitwiseAND(F.lit(_FULL))
        parts.append(head if last == WORD else head.bitwiseOR(F.shiftright(b, 2 * last)))
    return df.withColumn(out, _joined([*parts, back[-1].bitwiseAND(F.lit((1 << 2 * last) - 1))])).drop(*names)


def spell(kmer: Column | str, k: int) -> Column:
    """The letters of a packed k-mer."""
    c = F.col(kmer) if isinstance(kmer, str) else kmer
    letters = [F.translate(F.lpad(F.conv(p.cast("string"), 10, 4), n, "0"), "0123", "ACGT") for p, n in zip(_split(c, k), sizes(k))]
    return letters[0] if len(letters) == 1 else F.concat(*letters)


# ------------------------------------------------------------------ k-mers in tasks

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i


def _grown(one: np.ndarray, size: int, join) -> np.ndarray:
    """Values of all windows of ``size`` from those of single bases, by doubling; ``join(a, b, n)`` joins a window with the one behind its ``n`` bases."""
    value, n, out, done = one, 1, None, 0
    while True:
        if size & n:
            if out is None:
                out, done = value, n
            else:
                length = min(len(out), len(value) - done)
                out, done = join(out[:length], value[done : done + length], done, n), done + n
        if done == size:
            return out
        value = join(value[:-n], value[n:], n, n)
        n *= 2


def _ahead(a, b, _, n):
    return a << np.uint64(2 * n) | b


def _behind(a, b, n, _):
    return a | b << np.uint64(2 * n)


#: k-mers a task holds before it folds equal ones, and folded ones it holds before it hands them on.
OPEN_KMERS, FOLDED_KMERS = 1 << 21, 3 << 20


def _fold_counts(key: np.ndarray, kmer: np.ndarray, n: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, k-mer), sorted, and how often each occurs (``n``: how often each row counts)."""
    one = not len(key) or int(key.max()) >> max(0, 63 - 2 * k) == 0
    if one:
        both = key << (2 * k) | kmer
        if n is None:
            both = np.sort(both)
        else:
            order = np.argsort(both)
            both, n = both[order], n[order]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        key, kmer = both[at] >> (2 * k), both[at] & ((1 << 2 * k) - 1)
    else:
        order = np.lexsort((kmer, key))
        key, kmer = key[order], kmer[order]
        n = n if n is None else n[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kmer[1:] != kmer[:-1])))
        size, key, kmer = len(key), key[at], kmer[at]
    if n is not None:
        return key, kmer, np.add.reduceat(n, at) if len(at) else n
    return key, kmer, np.diff(np.append(at, len(both) if one else size))


def counted_kmers(df: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """``(*keep, kmer, n)``: the k-mers (up to 31 bases) of the sequences with equal ``keep``, folded inside a task: a k-mer that several tasks have, or that one hands on in parts, has several rows."""
    src = df.select(*keep, F.col(seq).alias("seq"))
    declared = dict(src.dtypes)

    def run(batches):
        keys: dict[tuple, int] = {}
        kinds: list[pa.DataType] = []
        raw: list[tuple[np.ndarray, np.ndarray]] = []
        chunks: list[tuple[np.ndarray, ...]] = []
        n_raw = n_folded = 0

        def fold():
            nonlocal raw, n_raw, n_folded
            if raw:
                chunks.append(_fold_counts(*(np.concatenate([r[i] for r in raw]) for i in (0, 1)), None, k))
                n_folded += len(chunks[-1][0])
                raw, n_raw = [], 0

        def merge():
            if len(chunks) > 1:
                chunks[:] = [_fold_counts(*(np.concatenate([c[i] for c in chunks]) for i in range(3)), k)]

        def out():
            listed = list(keys)
            key, kmer, n = chunks.pop()
            for at in range(0, len(key), 1 << 16):
                some = pa.array(key[at : at + (1 << 16)])
                cols = [pa.array([v[i] for v in listed], kinds[i]).take(some) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kmer[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], [*keep, "kmer", "n"])

        def add(parts):
            nonlocal n_raw
            codes = _CODE[np.frombuffer(b"-".join(p for _, p in parts), np.uint8)]
            if len(codes) < k:
                return
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            at = np.flatnonzero(bad[k:] == bad[:-k])
            of = np.searchsorted(np.cumsum([0, *(len(p) + 1 for _, p in parts[:-1])]), at, "right") - 1
            kmers = _grown((codes & 3).astype(np.uint64), k, _ahead)[at].view(np.int64)
            raw.append((np.array([i for i, _ in parts], np.int64)[of], kmers))
            n_raw += len(at)

        parts, bases = [], 0
        for b in batches:
            kinds[:] = [c.type for c in b.columns]
            *named, texts = (c.to_pylist() for c in b.columns)
            for i, text in enumerate(texts):
                coded = (text or "").encode()
                key = keys.setdefault(tuple(c[i] for c in named), len(keys))
                for at in range(0, len(coded) - k + 1, SLICE):
                    parts.append((key, coded[at : at + SLICE + k - 1]))
                    bases += len(parts[-1][1])
                    if bases >= SLICE:
                        add(parts)
                        parts, bases = [], 0
                        if n_raw < OPEN_KMERS:
                            continue
                        fold()
                        if n_folded >= 2 * FOLDED_KMERS:
                            merge()
                            n_folded = len(chunks[0][0])
                            if n_folded >= FOLDED_KMERS:
                                yield from out()
                                n_folded, keys, key = 0, {tuple(c[i] for c in named): 0}, 0
        if parts:
            add(parts)
        fold()
        merge()
        if chunks:
            yield from out()

    schema = ", ".join([*(f"`{c}` {declared[c]}" for c in keep), "kmer bigint, n bigint"])
    return src.mapInArrow(run, schema)


# ------------------------------------------------------------------ owners of short k-mers

#: Up to so many bases k-mers are fewer than what is read, so tasks fold them one by one, not as super-k-mers.
SHORT = 15
#: Groups that folded k-mers travel in (as bits), one row each; owned k-mers a task holds before it hands them on, and takes at a time behind the shuffle.
BLOCK_BITS, OWNED_KMERS, MET_KMERS = 13, 1 << 22, 1 << 20
_CODES = (1 << 32) - 1
#: Spreads k-mers evenly over the blocks: the least of a k-mer and its reverse complement times this number, as far as 2k bits go.
_SPREAD = 0x9E3779B97F4A7C15


def _flipped(x: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed k-mers."""
    x = ~x.astype(np.uint64) & np.uint64((1 << 2 * k) - 1)
    for step, mask in _SWAPS:
        m, n = np.uint64(mask), np.uint64(step)
        x = (x >> n & m) | (x & m) << n
    return (x >> np.uint64(64 - 2 * k)).view(np.int64)


def _owned(key: np.ndarray) -> np.ndarray:
    """One ``place << 32 | owner`` for each place, sorted (``key`` itself is, too); the owner is 0 where there are several."""
    key.sort()
    if not len(key):
        return key
    new = np.ones(len(key) + 1, bool)
    np.greater(key[1:] ^ key[:-1], _CODES, out=new[1:-1])
    first = key[new[:-1]]
    first[first != key[new[1:]]] &= ~_CODES
    return first


def _owner_rows(seqs: DataFrame, seq: str, number: str, ks: tuple[int, ...], both: bool) -> DataFrame:
    """``(k, block, places, owners, shared)``: the k-mers of one task in a block, those of one ``number`` beside it, and those of several; several rows where a task hands them on in parts.

    A place is the spread number of a k-mer or its reverse complement, the smaller one, and whether it was the other that was read (with ``both``, never).
    """
    src = seqs.select(F.col(number).alias("number"), F.col(seq).alias("seq"))

    def run(batches):
        numbers: dict[int, int] = {}
        raw: dict[int, list[np.ndarray]] = {k: [] for k in ks}
        held: dict[int, list[np.ndarray]] = {k: [] for k in ks}
        n_raw, n_held = dict.fromkeys(ks, 0), dict.fromkeys(ks, 0)

        def fold(k):
            if raw[k]:
                held[k].append(_owned(np.concatenate(raw[k])))
                n_held[k] += len(held[k][-1])
                raw[k], n_raw[k] = [], 0

        def merge(k):
            if len(held[k]) > 1:
                key, held[k] = np.concatenate(held[k]), []
                held[k].append(_owned(key))
                n_held[k] = len(held[k][0])

        def out(k):
            key, ids = held[k].pop(), np.array([0, *numbers], np.int64)
            n_held[k] = 0
            block = (key >> 33 + max(0, 2 * k - BLOCK_BITS)).astype(np.int32)
            ends = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            for at in range(0, len(ends) - 1, 1 << 10):
                rows = []
                for lo, hi in zip(ends[at : at + (1 << 10)], ends[at + 1 : at + 1 + (1 << 10)]):
                    place, code = (key[lo:hi] >> 32).astype(np.int32), key[lo:hi] & _CODES
                    one = code > 0
                    rows.append((k, int(block[lo]), place[one].tobytes(), ids[code[one]].tobytes(), place[~one].tobytes()))
                columns = zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["k", "block", "places", "owners", "shared"])

        def add(parts):
            codes = _CODE[np.frombuffer(b"-".join(p for _, p in parts), np.uint8)]
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            base, ends = (codes & 3).astype(np.uint64), np.cumsum([len(p) + 1 for _, p in parts])
            of = np.repeat(np.array([i for i, _ in parts], np.int64), np.diff(ends, prepend=0))
            for k in ks:
                if len(codes) < k:
                    continue
                at = np.flatnonzero(bad[k:] == bad[:-k])
                kmer, back = _grown(base, k, _ahead)[at], _grown(np.uint64(3) - base, k, _behind)[at]
                place = (np.minimum(kmer, back) * np.uint64(_SPREAD) & np.uint64((1 << 2 * k) - 1)) << np.uint64(1)
                if not both:
                    place |= back < kmer
                raw[k].append(place.view(np.int64) << 32 | of[at])
                n_raw[k] += len(at)

        parts, bases = [], 0
        for b in batches:
            for one, text in zip(*(c.to_pylist() for c in b.columns)):
                coded, code = (text or "").encode(), numbers.setdefault(one, len(numbers) + 1)
                for at in range(0, len(coded) - min(ks) + 1, SLICE):
                    parts.append((code, coded[at : at + SLICE + max(ks) - 1]))
                    bases += len(parts[-1][1])
                    if bases < SLICE:
                        continue
                    add(parts)
                    parts, bases = [], 0
                    for k in ks:
                        if n_raw[k] >= OPEN_KMERS:
                            fold(k)
                        if n_held[k] >= 2 * OWNED_KMERS:
                            merge(k)
                            if n_held[k] >= OWNED_KMERS:
                                yield from out(k)
        if parts:
            add(parts)
        for k in ks:
            fold(k)
            merge(k)
            if held[k]:
                yield from out(k)

    return src.mapInArrow(run, "k int, block int, places binary, owners binary, shared binary")


def owner_blocks(seqs: DataFrame, seq: str, number: str, ks: tuple[int, ...], both: bool, asked: DataFrame | None = None) -> DataFrame:
    """k-mers of all ``ks`` (up to :data:`SHORT`) folded where they are read, dealt in blocks that a k-mer and its reverse complement share.

    ``asked``: ``(seq)`` whose k-mers are the only ones that :func:`owned_kmers` returns.
    """
    none = F.lit(None).cast("binary")
    rows = _owner_rows(seqs, seq, number, ks, both).withColumn("asked", none)
    if asked is not None:
        wanted = _owner_rows(asked.select(F.lit(0).cast("bigint").alias("number"), "seq"), "seq", "number", ks, False)
        rows = rows.unionByName(wanted.select("k", "block", none.alias("places"), none.alias("owners"), none.alias("shared"), F.col("places").alias("asked")))
    return rows.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def owned_kmers(blocks: DataFrame, k: int, strands: str, narrowed: bool) -> DataFrame:
    """``(kmer, number)`` of the k-mers with one owner, from :func:`owner_blocks`; over both strands unless ``strands`` is ``forward``."""
    back = np.uint64(pow(_SPREAD, -1, 1 << 2 * k))

    def met(parts):
        kinds = (np.int32, np.int64, np.int32, np.int32)
        places, owners, shared, asked = (np.concatenate([np.frombuffer(x or b"", t) for x in c]) for c, t in zip(zip(*parts), kinds))
        ids = np.unique(owners)
        key = _owned(np.concatenate([places.astype(np.int64) << 32 | np.searchsorted(ids, owners) + 1, shared.astype(np.int64) << 32]))
        key = key[key & _CODES > 0]
        place, code = key >> 32, key & _CODES
        if strands != "forward":
            # a k-mer and its reverse complement may both be kept, or be one
            once = np.append(True, (place[1:] >> 1 != place[:-1] >> 1) | (code[1:] != code[:-1]))[: len(key)]
            place, code = np.concatenate([place[once] & -2, place[once] | 1]), np.tile(code[once], 2)
        if narrowed:
            have = np.append(np.unique(asked).astype(np.int64), -1)
            here = have[np.searchsorted(have[:-1], place)] == place
            place, code = place[here], code[here]
        least = ((place >> 1).view(np.uint64) * back & np.uint64((1 << 2 * k) - 1)).view(np.int64)
        other = _flipped(least, k)
        kmer, number = np.where(place & 1, other, least), ids[code - 1] if len(code) else ids[:0]
        one = (place & 1 == 0) | (least != other)
        kmer, number = kmer[one], number[one]
        for at in range(0, len(kmer), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(kmer[at : at + (1 << 16)]), pa.array(number[at : at + (1 << 16)])], ["kmer", "number"])

    def run(batches):
        parts, size, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != k:
                    continue
                if size >= MET_KMERS and row[1] != last:
                    yield from met(parts)
                    parts, size = [], 0
                last = row[1]
                parts.append(row[2:])
                size += sum(len(row[i] or b"") for i in (2, 4, 5)) // 4
        if parts:
            yield from met(parts)

    # The filter by k is in the kernel, so that several k read one shuffle.
    return blocks.select("k", "block", "places", "owners", "shared", "asked").sortWithinPartitions("block").mapInArrow(run, "kmer bigint, number bigint")


# ------------------------------------------------------------------ super-k-mers

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(1)


def runs_of(codes: np.ndarray, k: int, m: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``minimiser, start, k-mers, words`` of the super-k-mers in an array of base codes (4: no base)."""
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return none.astype(np.uint64), none, none, np.zeros((0, n_words), np.int64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    ok = bad[k:] == bad[:-k]
    base = (codes & 3).astype(np.uint64)
    mers = np.minimum(_grown(base, m, _ahead), _grown(np.uint64(3) - base, m, _behind))
    least, width, have = _mixed(mers), k - m + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    new = np.ones(len(ok), bool)
    new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(ok)))
    start, count = start[ok[start]], count[ok[start]]
    most = WORD * n_words - k + 1
    pieces = -(-count // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, count = np.repeat(start, pieces) + nth * most, np.minimum(np.repeat(count, pieces) - nth * most, most)
    padded = np.concatenate([base, np.zeros(WORD * (n_words + 1), np.uint64)])
    value = _grown(padded, WORD, _ahead)
    words = np.empty((n_words, len(start)), np.int64)
    for w in range(n_words):
        held = np.clip(count + k - 1 - WORD * w, 0, WORD).astype(np.uint64)
        gone = (np.uint64(WORD) - held) * np.uint64(2)
        words[w] = (value[np.minimum(start + WORD * w, len(value) - 1)] >> gone << gone).view(np.int64)
    return least[start], start, count, words.T


def _folded(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, mini: np.ndarray, count: np.ndarray, words: np.ndarray):
    """Equal super-k-mers of one scope as one, with their smallest and largest owner; sorted by a hash, so the few whose hash others share may stay apart."""
    key = mini + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64)
    for w in words.T:
        key = _mixed(key) + w.view(np.uint64)
    order = np.argsort(_mixed(key))
    owner, lo, hi, mini, count, words = owner[order], lo[order], hi[order], mini[order], count[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (mini[1:] != mini[:-1]) | (count[1:] != count[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    kept = owner[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), mini[at], count[at], words[at]
    back = np.argsort(order[at])  # neighbours alike, which packs better
    return tuple(x[back] for x in kept)


def super_kmers(seqs: DataFrame, seq: str, number: str, k: int, scope: tuple[str, ...] = (), m: int | None = None) -> DataFrame:
    """``(*scope, mini, n, words, lo, hi)``: runs of ``n`` k-mers with a common minimiser, and the smallest and largest ``number`` that have them.

    Equal runs are folded inside a task, so copies and repeats do not travel.
    """
    m = m or minimiser_size(k)
    n_words = -(-(2 * k - m) // WORD)
    src = seqs.select(*scope, F.col(number).alias("number"), F.col(seq).alias("seq"))
    declared = dict(src.dtypes)
    names = [*scope, "mini", "n", *[f"w{i}" for i in range(n_words)], "lo", "hi"]

    def run(batches):
        held: list[tuple] = []
        scopes: dict[tuple, int] = {}
        kinds: list[pa.DataType] = []
        size = 0

        def out():
            rows = _folded(*(np.concatenate([h[i] for h in held]) for i in range(6)))
            listed, picked = list(scopes), rows[0].tolist()
            cols = [pa.array([listed[s][i] for s in picked], kinds[i]) for i in range(len(scope))]
            arrays = [*cols, pa.array(rows[3].view(np.int64)), pa.array(rows[4].astype(np.int32)), *map(pa.array, rows[5].T), pa.array(rows[1]), pa.array(rows[2])]
            for at in range(0, len(picked), 1 << 16):
                yield pa.RecordBatch.from_arrays([a.slice(at, 1 << 16) for a in arrays], names)

        def packed(parts: list[tuple[tuple, int, bytes]]) -> tuple | None:
            codes = _CODE[np.frombuffer(b"-".join(p for _, _, p in parts), np.uint8)]
            first = np.cumsum([0, *(len(p) + 1 for _, _, p in parts[:-1])])
            mini, start, count, words = runs_of(codes, k, m, n_words)
            if not len(start):
                return None
            of = np.searchsorted(first, start, "right") - 1
            number = np.array([n for _, n, _ in parts], np.int64)[of]
            return np.array([scopes.setdefault(s, len(scopes)) for s, _, _ in parts])[of], number, number, mini, count, words

        def slices():
            parts, bases = [], 0
            for b in batches:
                kinds[:] = [c.type for c in b.columns]
                *keys, numbers, texts = (c.to_pylist() for c in b.columns)
                for i, (number, text) in enumerate(zip(numbers, texts)):
                    raw = (text or "").encode()
                    for at in range(0, len(raw) - k + 1, SLICE):
                        parts.append((tuple(c[i] for c in keys), number, raw[at : at + SLICE + k - 1]))
                        bases += len(parts[-1][2])
                        if bases >= SLICE:
                            yield parts
                            parts, bases = [], 0
            if parts:
                yield parts

        for parts in slices():
            rows = packed(parts)
            if rows is not None:
                held.append(rows)
                size += len(rows[0])
            if size >= HELD:
                yield from out()
                held, size = [], 0
                scopes.clear()
        if held:
            yield from out()

    schema = ", ".join([*(f"`{c}` {declared[c]}" for c in scope), "mini bigint, n int", *(f"w{i} bigint" for i in range(n_words)), "lo bigint, hi bigint"])
    made = src.mapInArrow(run, schema)
    words = F.array(*[F.col(f"w{i}") for i in range(n_words)], F.lit(0).cast("bigint"))
    return made.select(*scope, "mini", "n", words.alias("words"), "lo", "hi")


def owners_of_kmers(runs: DataFrame, k: int, scope: tuple[str, ...] = (), both: bool = False) -> DataFrame:
    """``(*scope, kmer, lo, hi)``: smallest and largest owner of every k-mer, or with ``both`` of the smaller one of each k-mer and its reverse complement.

    Runs are dealt by their minimiser; the grouping by k-mer that follows needs no shuffle of
    its own. The stated number of parts keeps AQE from merging them by a size from before the
    k-mers are spelled out.
    """
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = runs.repartition(parts, *scope, "mini").select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("at"))
    kmers = each.select(*scope, "mini", "lo", "hi", kmer_at(F.col("words"), F.col("at"), k).alias("kmer"))
    if both:
        kmers = with_reverse(kmers, k).withColumn("kmer", F.least("kmer", "reverse")).drop("reverse")
    return kmers.groupBy(*scope, "mini", "kmer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("mini")


def both_strands(index: DataFrame, k: int) -> DataFrame:
    """Each k-mer and its reverse complement, once if they are equal."""
    return with_reverse(index, k).withColumn("kmer", F.explode(F.when(F.col("kmer") == F.col("reverse"), F.array("kmer")).otherwise(F.array("kmer", "reverse")))).drop("reverse")
