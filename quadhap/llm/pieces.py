"""Cutting text into parts that a byte-level tokenizer encodes independently of each other.

The split pattern of the byte-level vocabularies puts a token boundary before every space
that follows a character other than white space. So ``text.split(" ")`` gives parts that can
be encoded alone (each with its space in front) and remembered: natural text repeats few of
them. Only runs of white space that hold a space break this rule; such texts are cut by the
full pattern instead.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quadhap.llm.common import class_ranges

# The white space that the pattern's \s means (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def word_pattern() -> re.Pattern:
    """The vocabularies' split pattern with its Unicode classes written out, which the standard library matches fast."""
    letters = class_ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = class_ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = re.escape(WHITE)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def find_words(text: str) -> list[str]:
    """The matches of the split pattern, in order; joined they give the text."""
    return (_ASCII if text.isascii() else word_pattern()).findall(text)


def part_words(part: str) -> list[str]:
    """:func:`find_words` of a part between spaces; most are a word, or a word and a punctuation mark, and need no search."""
    body = part[1:] if part[:1] == " " else part
    if body.isalpha():
        return [part]
    if body[-1:] in ".,;:!?" and body[:-1].isalpha():
        return [part[:-1], part[-1]]
    return find_words(part)


_QUICK = ["   ", *(c + " " for c in "\t\n\x0b\x0c\r"), *("  " + c for c in "\t\n\x0b\x0c\r")]
_BROKEN = re.compile(f"[{re.escape(WHITE)}] (?:[{re.escape(WHITE)}]|\\Z)")


def splits_at_spaces(text: str) -> bool:
    """Whether every part between spaces can be encoded alone: no space stands between white space and white space (or the end)."""
    if text.isascii() and not text.endswith("  ") and not any(q in text for q in _QUICK):
        return True
    return _BROKEN.search(text) is None


class Memo:
    """Values of text parts, computed once per worker and kept up to a bound.

    Keys are parts without the space that ``front`` puts in front of them. When ``limit``
    parts are held the older half goes (two generations), so memory is bounded and common
    parts stay.
    """

    def __init__(self, compute: Callable[[list[str]], list], front: str, limit: int):
        self.compute, self.front, self.limit = compute, front, limit
        self.new: dict = {}
        self.old: dict = {}

    def load(self, parts: set[str]) -> None:
        """Make ``new`` hold these parts, none of which it holds yet."""
        if len(self.new) + len(parts) > self.limit // 2:
            self.old, self.new = self.new, {}
        known = parts.intersection(self.old)
        for p in known:
            self.new[p] = self.old[p]
        missing = list(parts.difference(known))
        if missing:
            self.new.update(zip(missing, self.compute([self.front + p for p in missing])))


class WordMemo:
    """Values of words behind a memory of parts: one word is in many parts, with other marks around it. Bounded as :class:`Memo` is."""

    def __init__(self, compute: Callable[[set[str]], dict], limit: int = 600_000):
        self.compute, self.limit = compute, limit
        self.new: dict = {}
        self.old: dict = {}

    def load(self, words: set[str]) -> dict:
        """A table that holds all of ``words``, until the next call."""
        missing = words.difference(self.new)
        if len(self.new) + len(missing) > self.limit // 2:
            self.old, self.new, missing = self.new, {}, words
        known = missing.intersection(self.old)
        self.new.update((w, self.old[w]) for w in known)
        rest = missing.difference(known)
        if rest:
            self.new.update(self.compute(rest))
        return self.new


_EDGE = frozenset(WHITE) | {""}


class Splitter:
    """Values of the parts of texts, by memos over whole parts.

    ``special``: strings that the tokenizer cuts out before its pattern applies.
    """

    def __init__(self, compute: Callable[[list[str]], list], special: tuple[str, ...] = (), limit: int = 800_000):
        self.spaced, self.plain = Memo(compute, " ", limit), Memo(compute, "", limit // 8)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def words(self, text: str) -> list[str]:
        """Parts by the full pattern."""
        if self.special is None:
            return find_words(text)
        out: list[str] = []
        for i, section in enumerate(self.special.split(text)):
            out += [section] if i % 2 else find_words(section)
        return out

    def values(self, texts: list[str | None], slice_chars: int = 1 << 21):
        """The values of each text's parts, as an iterator of lists; nulls count as empty."""
        todo: list[tuple[list[str], list[str]]] = []
        size = 0
        for text in texts:
            if not text:
                todo.append(([], []))
            elif splits_at_spaces(text):
                first, *rest = text.split(" ")
                todo.append(([first] if first else [], rest))
            else:
                todo.append((self.words(text), []))
            size += len(text or "")
            if size >= slice_chars:
                yield from self._values(todo)
                todo, size = [], 0
        yield from self._values(todo)

    def _values(self, todo: list[tuple[list[str], list[str]]]):
        front = self._looked_up(self.plain, [t[0] for t in todo])
        for plain, spaced in zip(front, self._looked_up(self.spaced, [t[1] for t in todo])):
            spaced[:0] = plain
            yield spaced

    @staticmethod
    def _looked_up(memo: Memo, lists: list[list[str]]) -> list[list]:
        get = memo.new.get
        out = [list(map(get, parts)) for parts in lists]
        holes = [[i for i, v in enumerate(values) if v is None] for values in out]
        wanted = {parts[i] for parts, at in zip(lists, holes) for i in at}
        if wanted:
            memo.load(wanted)
            found = memo.new
            for parts, values, at in zip(lists, out, holes):
                for i in at:
                    values[i] = found[parts[i]]
        return out

    def columns(self, texts: pa.Array, slice_bytes: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The values (bytes) of a column of texts, slice by slice: all texts' bytes end to end, and where each text ends in them.

        Arrow cuts a slice at its spaces, numbers its distinct parts and strings their values
        together; Python meets each distinct part of a slice once. Nulls count as empty.
        """
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            stop = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + slice_bytes, "right"))
            stop = max(stop, begin + 1)
            yield self._column(texts.slice(begin, stop - begin))
            begin = stop

    def _column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat, first, n_parts = lists.flatten(), bounds[:-1], np.diff(bounds)
        rest, heads = flat.dictionary_encode(), flat.take(pa.array(first)).dictionary_encode()
        parts, codes = rest.dictionary.to_pylist(), rest.indices.to_numpy().astype(np.int64)
        broken = self._broken(parts, codes, bounds)
        codes[first] = len(parts) + heads.indices.to_numpy()
        head_parts = heads.dictionary.to_pylist()
        values = self._looked_up(self.spaced, [parts])[0] + [b"" if v is None else v for v in self._heads(head_parts)]
        if len(broken):
            whole = self._looked_up(self.plain, [self.words(texts[i].as_py()) for i in broken.tolist()])
            codes[first[broken]] = len(values) + np.arange(len(broken))
            values += [b"".join(v) for v in whole]
            # of a broken text only its first part's place stays, which now stands for all of it
            keep = np.ones(len(codes), bool)
            keep[np.repeat(np.isin(np.arange(len(n_parts)), broken), n_parts)] = False
            keep[first[broken]] = True
            codes, n_parts = codes[keep], n_parts.copy()
            n_parts[broken] = 1
        out = pa.array(values, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(codes) + 1]
        data = np.frombuffer(out.buffers()[2] or b"", np.uint8)[: ends[-1]]
        return data, ends[np.cumsum(n_parts)]

    def _heads(self, parts: list[str]) -> Iterator:
        """Values of parts that begin a text; an empty one has none."""
        found = iter(self._looked_up(self.plain, [[p for p in parts if p]])[0])
        return (next(found) if p else None for p in parts)

    @staticmethod
    def _broken(parts: list[str], codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Numbers of the texts for which :func:`splits_at_spaces` does not hold, from their parts."""
        begins = np.fromiter((p[:1] in _EDGE for p in parts), bool, len(parts))[codes]
        ends = np.fromiter((p[-1:] in _EDGE for p in parts), bool, len(parts))[codes]
        empty = np.fromiter((not p for p in parts), bool, len(parts))
        ends[bounds[:-1]] &= ~empty[codes[bounds[:-1]]]  # nothing stands before a text
        ends[bounds[1:] - 1] = False
        at = np.flatnonzero(ends[:-1] & begins[1:])
        return np.unique(np.searchsorted(bounds, at, "right") - 1)
