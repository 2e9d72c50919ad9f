"""Sequence expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))


def kmers(seq: Column | str, k: int) -> Column:
    """All overlapping k-mers without ``N``, in order.

    A zero-width lookahead lists every start position in one native pass, where
    ``substring`` per position would rescan the string each time. Anything but
    ``A C G T`` breaks a k-mer.
    """
    return F.regexp_extract_all(seq, F.lit("(?=([ACGT]{%d}))" % k), F.lit(1))


def pieces(seq: Column | str, k: int, step: int) -> Column:
    """Overlapping pieces that hold every k-mer of ``seq`` exactly once."""
    s = F.col(seq) if isinstance(seq, str) else seq
    starts = F.sequence(F.lit(1), F.length(s) - (k - 1), F.lit(step))
    return F.when(F.length(s) >= k, F.transform(starts, lambda i: F.substr(s, i, F.lit(step + k - 1)))).otherwise(
        F.array().cast("array<string>")
    )


def lettered(text: Column, table: str, bases: str) -> Column:
    """The ASCII letters of ``table`` as the ones of ``bases`` in the same place; all else is dropped. One pass over each text."""
    to = bytes.maketrans(table.encode(), bases.encode())
    drop = bytes(i for i in range(256) if i not in table.encode())

    @F.arrow_udf(StringType())
    def translated(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else t.encode().translate(to, drop).decode() for t in texts.to_pylist()], pa.string())

    return translated(text)


def n_fraction(seq: Column | str) -> Column:
    s = F.upper(seq)
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit("N")) / F.length(s))


@F.arrow_udf(StringType())
def _masked(seq: pa.Array, flags: pa.Array) -> pa.Array:
    ends, marks, out = flags.offsets.to_numpy(), flags.values.to_numpy(zero_copy_only=False).astype(bool), []
    for text, lo, hi in zip(seq.to_pylist(), ends[:-1], ends[1:]):
        if text is not None:
            coding, width = ("ascii", np.uint8) if text.isascii() else ("utf-32-le", np.uint32)
            bases = np.frombuffer(text.encode(coding), width).copy()
            bases[: hi - lo][marks[lo : lo + len(bases)][: hi - lo]] = ord("N")
            text = bases.tobytes().decode(coding)
        out.append(text)
    return pa.array(out, pa.string())


def apply_flags(seq: Column | str, flags: Column | str) -> Column:
    """Replace bases by ``N`` where the array of flags says so; a shorter one leaves the tail. One pass of numpy over each sequence."""
    f = F.col(flags) if isinstance(flags, str) else flags
    return _masked(seq, F.coalesce(f, F.array().cast("array<boolean>")))


def apply_mask(seq: Column | str, mask: Column | str) -> Column:
    """Replace bases by ``N`` where the ``0/1`` mask string has a ``1``; a shorter mask leaves the tail."""
    return apply_flags(seq, F.transform(F.split(F.col(mask) if isinstance(mask, str) else mask, ""), lambda m: m == "1"))
