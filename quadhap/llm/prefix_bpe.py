"""Byte-pair encoding by dynamic programming over prefixes.

A sequence of tokens is what byte-pair merging gives exactly when each pair of neighbours is
what merging gives for the two alone. Hence every prefix of a word has one valid last token,
and the one for a longer prefix follows from those of the shorter: the token t that ends
there and agrees with the last token of the prefix before t. Storing the last token of each
prefix makes appending exact without merging again, and after an edit only the prefixes
behind it are computed anew.
"""

from __future__ import annotations

import base64
import functools
import json

NEVER = 1 << 60


def letters_to_bytes() -> dict[str, int]:
    """The printable letters in which byte-level vocabulary files write bytes: printable Latin-1 stays, the rest follows from 256 on."""
    keep = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Last tokens of prefixes for one vocabulary.

    ``ids``: token bytes to id. ``pairs``: ``left id << 20 | right id`` to the order in which the
    two merge. ``whole``: a word that is a token is that token, whatever merging would give.
    Tokens that merging never gives are no candidates otherwise.
    """

    def __init__(self, ids: dict[bytes, int], pairs: dict[int, int], whole: bool):
        self.ids, self.pairs, self.whole = ids, pairs, whole
        self.longest = max(map(len, ids), default=1)
        self.bytes_of = {i: t for t, i in ids.items()}
        self.size = {i: len(t) for t, i in ids.items()}
        self._edges: dict[int, tuple | None] = {}
        self._agree: dict[int, bool] = {}

    def edges(self, token: int) -> tuple | None:
        """(left, right) spines of a token's own merge tree: the parts at its edge, each with the merge that absorbs it. None: merging never gives this token."""
        if token not in self._edges:
            raw = self.bytes_of[token]
            parts = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
            left, right = [(parts[0], NEVER)], [(parts[-1], NEVER)]
            while len(parts) > 1:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.pairs.get(parts[i] << 20 | parts[i + 1])) is not None]
                if not ranked:
                    break
                r, i = min(ranked)
                made = self.ids[self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]]]
                if i == 0:
                    left[-1:] = [(parts[0], r), (made, NEVER)]
                if i == len(parts) - 2:
                    right[-1:] = [(parts[-1], r), (made, NEVER)]
                parts[i : i + 2] = [made]
            self._edges[token] = (left, right) if parts == [token] else None
        return self._edges[token]

    def agree(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between two tokens alone."""
        right, left = self.edges(a), self.edges(b)
        if right is None or left is None:
            return False
        get = self.pairs.get
        for x, gone in right[1]:
            x <<= 20
            for y, taken in left[0]:
                r = get(x | y)
                if r is not None and r < gone and r <= taken:  # at equal order the leftmost pair merges first
                    return False
        return True

    def extend(self, word: bytes, last: list[int], until: int) -> None:
        """Append the last tokens of prefixes ``len(last)+1 .. until`` to ``last`` (entry i is for the prefix of i+1 bytes)."""
        get, known, longest = self.ids.get, self._agree, self.longest
        for end in range(len(last) + 1, until + 1):
            for before in range(max(0, end - longest), end):
                token = get(word[before:end])
                if token is None:
                    continue
                if before:
                    pair = last[before - 1] << 20 | token
                    ok = known.get(pair)
                    if ok is None:
                        if len(known) > 300_000:
                            known.clear()
                        ok = known[pair] = self.agree(last[before - 1], token)
                else:
                    ok = self.edges(token) is not None
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")

    def last_tokens(self, word: bytes) -> list[int]:
        """The last token of every prefix."""
        last: list[int] = []
        self.extend(word, last, len(word))
        return last

    def backwards(self, last: list[int]) -> list[int]:
        """The encoding that a list of last tokens stands for."""
        out, at, size = [], len(last), self.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        """The encoding of one part."""
        if self.whole and word in self.ids:
            return [self.ids[word]]
        return self.backwards(self.last_tokens(word))

    def encode_all(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of many parts: in sorted order, each starts from the last tokens of the prefix it shares with the one before."""
        out, past, last = {}, b"", []
        for word in sorted(words):
            if self.whole and word in self.ids:
                out[word] = [self.ids[word]]
                continue
            shared, most = 0, min(len(past), len(word))
            while shared < most and past[shared] == word[shared]:
                shared += 1
            del last[shared:]
            self.extend(word, last, len(word))
            past = word
            out[word] = self.backwards(last)
        return out

    def reencode(self, word: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """``word`` with bytes ``start:end`` replaced, and its last tokens.

        Those in front of the edit are kept. Those behind it are computed until the last
        ``longest`` entries equal the old ones; from there on all are the old ones.
        """
        changed = word[:start] + new + word[end:]
        out, shift = last[:start], len(new) - (end - start)
        while len(out) < len(changed):
            self.extend(changed, out, len(out) + 1)
            at = len(out)
            if at - start - len(new) >= 2 * self.longest and out[-self.longest :] == last[at - shift - self.longest : at - shift]:
                out += last[at - shift :]
                break
        return changed, out


@functools.cache
def from_ranks(path: str) -> PrefixBpe:
    """A vocabulary of ranks: two tokens merge in the order of their joint token's rank; a whole part that is a token is that token."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pairs = {}
    for token, rank in ids.items():
        for i in range(1, len(token)):
            a, b = ids.get(token[:i]), ids.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = rank
    return PrefixBpe(ids, pairs, whole=True)


@functools.cache
def from_json(path: str) -> PrefixBpe:
    """A vocabulary with a list of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    table = letters_to_bytes()
    raw = lambda s: bytes(table[c] for c in s)
    ids = {raw(token): i for token, i in model["vocab"].items() if all(c in table for c in token)}
    merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    pairs = {ids[raw(a)] << 20 | ids[raw(b)]: i for i, (a, b) in enumerate(merges)}
    return PrefixBpe(ids, pairs, whole=False)


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the vocabulary file cuts out of texts as tokens of their own."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))
