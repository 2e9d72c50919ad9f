"""CIGAR and SAM-flag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNMAPPED, FIRST, LAST, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x4, 0x40, 0x80, 0x100, 0x400, 0x800


def has_flag(flag: Column | str, bits: int) -> Column:
    f = F.col(flag) if isinstance(flag, str) else flag
    return f.bitwiseAND(F.lit(bits)) != 0


def primary(flag: Column | str) -> Column:
    return ~has_flag(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY | DUPLICATE)


def mate(flag: Column | str) -> Column:
    return F.when(has_flag(flag, FIRST), 1).when(has_flag(flag, LAST), 2).otherwise(0)


def cigar_ops(cigar: Column | str) -> Column:
    """``array<struct<len int, op string>>``."""
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))


def cigar_totals(cigar: Column | str) -> Column:
    """``struct(m, s, all)``: bases in ``M``, in ``S``, and in all operations, from one pass."""
    zero = F.struct(F.lit(0).alias("m"), F.lit(0).alias("s"), F.lit(0).alias("all"))

    def add(acc, x):
        return F.struct(
            (acc.m + F.when(x.op == "M", x.len).otherwise(0)).alias("m"),
            (acc.s + F.when(x.op == "S", x.len).otherwise(0)).alias("s"),
            (acc["all"] + x.len).alias("all"),
        )

    return F.aggregate(cigar_ops(cigar), zero, add)


def match_bases(cigar: Column | str, nm: Column | str) -> Column:
    """Bases in ``M`` minus the edit distance."""
    nm = F.col(nm) if isinstance(nm, str) else nm
    return cigar_totals(cigar).m - F.coalesce(nm, F.lit(0))


def soft_bases(cigar: Column | str) -> Column:
    return cigar_totals(cigar).s


def focus_length(cigar: Column | str) -> Column:
    t = cigar_totals(cigar)
    return t["all"] - t.s


def aligned_blocks(cigar: Column | str) -> Column:
    """``array<struct<offset int, len int>>`` of base-carrying runs, offset from the alignment start.

    ``D`` and ``N`` advance the reference without carrying a base.
    """
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,len:int>>").alias("runs"))

    def step(acc, x):
        carries = x.op.isin("M", "=", "X")
        run = F.array(F.struct(acc.at.alias("offset"), x.len.alias("len")))
        return F.struct(
            F.when(carries | x.op.isin("D", "N"), acc.at + x.len).otherwise(acc.at).alias("at"),
            F.when(carries, F.concat(acc.runs, run)).otherwise(acc.runs).alias("runs"),
        )

    return F.aggregate(cigar_ops(cigar), state, step, lambda acc: acc.runs)
