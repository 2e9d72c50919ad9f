"""Dose-model and numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_dose(n_r: Column, n_d: Column, chi: Column) -> Column:
    """Expected share of an allele carried by ``n_r`` recipient and ``n_d`` donor haplotypes."""
    return n_r * chi / 2 + n_d * (F.lit(1.0) - chi) / 2


def slot_fraction(side: Column | str, chi: Column | str) -> Column:
    s = F.col(side) if isinstance(side, str) else side
    c = F.col(chi) if isinstance(chi, str) else chi
    return F.when(s == "R", c / 2).when(s == "D", (F.lit(1.0) - c) / 2)


def dose_genotype(n_r: Column, n_d: Column) -> Column:
    """Unphased genotype text with ALT copies placed first inside each side."""
    zero, one = F.lit("0"), F.lit("1")
    slots = F.concat(
        F.array_repeat(one, n_r), F.array_repeat(zero, F.lit(2) - n_r),
        F.array_repeat(one, n_d), F.array_repeat(zero, F.lit(2) - n_d),
    )
    return F.array_join(slots, "/")


def folded_af(af: Column) -> Column:
    return F.least(af, F.lit(1.0) - af)


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def quartet_residual(quartet: Column, fraction_of, total: Column | float, chi: Column) -> Column:
    """Σ over all families of |observed − expected| for one quartet.

    Only the quartet's own members deviate from "expected 0", so the sum is the
    total of the observed fractions plus one correction per distinct member.
    ``fraction_of`` maps a family column to its observed fraction.
    """
    members = [F.get(quartet, F.lit(i)) for i in range(4)]
    score = total if isinstance(total, Column) else F.lit(total)
    for i, m in enumerate(members):
        first = F.lit(True)
        for earlier in members[:i]:
            first = first & (earlier != m)
        n_r = (members[0] == m).cast("int") + (members[1] == m).cast("int")
        n_d = (members[2] == m).cast("int") + (members[3] == m).cast("int")
        o = fraction_of(m)
        score = score + F.when(first, F.abs(o - expected_dose(n_r, n_d, chi)) - o).otherwise(0.0)
    return score


def fraction_lookup(entries: Column, name: str = "family", value: str = "fraction"):
    """Lookup into a short ``array<struct>`` of observed fractions; absent families are 0."""

    def of(family: Column) -> Column:
        hit = F.filter(entries, lambda s: s[name] == family)
        return F.coalesce(F.get(hit, F.lit(0))[value], F.lit(0.0))

    return of


def render(value: Column, digits: int) -> Column:
    """Fixed digits, ``NA`` for missing values; only for sinks."""
    return F.when(value.isNull(), F.lit("NA")).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))
