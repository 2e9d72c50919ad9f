"""Allele, gene and read-name expressions.

``two_field`` has four behaviours that differ in how suffix letters are treated;
the mode is a required argument because mixing modes silently loses families.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Locus codes used in truth tables, and the locus linked to a DRB1 family.
TRUTH_LOCUS_CODES = {"03": "DRB3", "3": "DRB3", "04": "DRB4", "4": "DRB4", "05": "DRB5", "5": "DRB5"}
LINKED_LOCUS = {
    "03": "DRB3", "11": "DRB3", "12": "DRB3", "13": "DRB3", "14": "DRB3",
    "04": "DRB4", "07": "DRB4", "09": "DRB4",
    "15": "DRB5", "16": "DRB5",
}
LINKED_LOCI = ("DRB3", "DRB4", "DRB5")

ALLELE_IN_HEADER = r"([A-Z0-9]+\*[0-9:]+[A-Z]?)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def gene_part(allele: Column | str) -> Column:
    return F.substring_index(_c(allele), "*", 1)


def field_part(allele: Column | str) -> Column:
    """Everything behind the ``*``."""
    return F.substring_index(_c(allele), "*", -1)


def has_star(allele: Column | str) -> Column:
    return F.contains(_c(allele), F.lit("*"))


def clean_allele(allele: Column | str, bare: str = "keep") -> Column:
    """Drop the ``HLA-`` prefix and one trailing letter of the last field, unless ``G``.

    Missing values become ``NA``. Names without ``*`` are left alone
    (``bare="keep"``, used for reports) or lose only the prefix (``bare="strip"``,
    used for evaluation).
    """
    a = _c(allele)
    stripped = F.replace(a, F.lit("HLA-"), F.lit(""))
    return (
        F.when(a.isNull() | a.isin("", "NA"), F.lit("NA"))
        .when(has_star(a), F.regexp_replace(stripped, "[A-FH-Za-z]$", ""))
        .otherwise(a if bare == "keep" else stripped)
    )


def first_fields(fields: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(fields, ":"), 1, n), ":")


def two_field(allele: Column | str, mode: str, bare: str = "keep") -> Column:
    """Family name of an allele.

    * ``report`` – cleaned, every ``G`` removed;
    * ``em``     – raw name, keeps ``24:09N``;
    * ``gate``   – strips trailing ``G``/``P`` only, keeps ``N``;
    * ``rescue`` – removes every ``G``, trailing ``P``, and one letter of the last
      field only when that field is entirely alphabetic.
    """
    a = _c(allele)
    bare_name = F.replace(F.trim(a), F.lit("HLA-"), F.lit(""))
    if mode == "report":
        # Same as cleaning first, written so that the cleaned name is not repeated in the expression.
        plain = F.replace(a, F.lit("HLA-"), F.lit(""))
        fields = F.replace(field_part(F.regexp_replace(plain, "[A-FH-Za-z]$", "")), F.lit("G"), F.lit(""))
        other = F.when(a.isNull() | a.isin("", "NA"), F.lit("NA")).otherwise(a if bare == "keep" else plain)
        gene = gene_part(plain)
    elif mode == "em":
        fields, other, gene = F.get(F.split(a, r"\*"), F.lit(1)), a, gene_part(a)
    elif mode == "gate":
        fields, other, gene = F.regexp_replace(field_part(bare_name), "[GP]+$", ""), bare_name, gene_part(bare_name)
    elif mode == "rescue":
        other = F.regexp_replace(F.replace(bare_name, F.lit("G"), F.lit("")), "P+$", "")
        fields, gene = F.regexp_replace(field_part(other), "(^|:)([A-Za-z]*)[A-Za-z]$", "$1$2"), gene_part(other)
    else:
        raise ValueError(f"unknown two_field mode: {mode}")
    return F.when(has_star(a), F.concat(gene, F.lit("*"), first_fields(fields))).otherwise(other)


def ggroup_candidates(cleaned: Column | str) -> Column:
    """Names to look up, in order, for the G group of a cleaned allele."""
    a = _c(cleaned)
    n = F.size(F.split(field_part(a), ":"))
    return (
        F.when(~has_star(a) | a.endswith("G"), F.array(F.lit(None).cast("string")))
        .when(n == 2, F.array(a, F.concat(a, F.lit(":01")), F.concat(a, F.lit(":01:01"))))
        .when(n == 3, F.array(a, F.concat(a, F.lit(":01"))))
        .otherwise(F.array(a))
    )


def field_count(allele: Column | str) -> Column:
    fields = F.replace(field_part(F.regexp_replace(_c(allele), "[A-FH-Za-z]$", "")), F.lit("G"), F.lit(""))
    return F.when(has_star(allele), F.size(F.split(fields, ":"))).otherwise(0)


def allele_number(allele: Column | str, default: int = 999999, needs_colon: bool = True) -> Column:
    """Number behind ``*``; class-II rules require a following ``:`` (default 999999)."""
    text = F.regexp_extract(_c(allele), r"\*(\d+):" if needs_colon else r"\*(\d+)", 1)
    return F.coalesce(text.try_cast("int"), F.lit(default))


def first_field(allele: Column | str) -> Column:
    return F.regexp_extract(_c(allele), r"\*(\d+):", 1)


def locus_of(allele: Column | str) -> Column:
    return F.when(has_star(allele), gene_part(allele)).otherwise(F.lit("absent"))


def has_expression_suffix(family: Column | str) -> Column:
    return F.rlike(_c(family), F.lit("[A-Za-z]$")) & ~_c(family).endswith("G")


def truth_gene(gene: Column | str) -> Column:
    g = F.trim(_c(gene))
    return F.when(g.isin("DRB345", "DPB345"), F.lit("HLA-DRB345")).otherwise(F.concat(F.lit("HLA-"), g))


def truth_allele(gene: Column | str, allele: Column | str) -> Column:
    """Normalise a truth cell; DRB3/4/5 columns carry the locus as a leading code."""
    g, a = F.trim(_c(gene)), F.trim(_c(allele))
    bare = F.replace(a, F.lit("HLA-"), F.lit(""))
    fields = F.filter(F.split(F.regexp_replace(bare, ":+$", ""), ":"), lambda x: x != "")
    codes = F.create_map(*[F.lit(x) for kv in TRUTH_LOCUS_CODES.items() for x in kv])
    locus = F.element_at(codes, F.coalesce(F.get(fields, F.lit(0)), F.lit("")))
    rest = F.array_join(F.slice(fields, 2, 20), ":")
    linked = (
        F.when(a.isNull() | a.isin("", "NA", "-", "."), F.lit("NA"))
        .when(has_star(bare), bare)
        .when(F.size(fields) == 0, F.lit("NA"))
        .when(locus.isNotNull() & (F.size(fields) >= 2), F.concat(locus, F.lit("*"), rest))
        .otherwise(F.concat(F.lit("DRB345*"), bare))
    )
    plain = F.when(has_star(a), bare).otherwise(F.concat(g, F.lit("*"), a))
    return F.when(g.isin("DRB345", "DPB345"), linked).otherwise(plain)


def linked_locus(allele: Column | str) -> Column:
    """DRB3/4/5 locus that travels with a DRB1 allele, else ``absent``."""
    a = clean_allele(allele)
    table = F.create_map(*[F.lit(x) for kv in LINKED_LOCUS.items() for x in kv])
    family = F.substring_index(field_part(a), ":", 1)
    return F.when(has_star(a) & (gene_part(a) == "DRB1"), F.coalesce(F.element_at(table, family), F.lit("absent"))).otherwise(
        F.lit("absent")
    )


def read_name(header: Column | str, style: str = "pair") -> Column:
    """Read name of a FASTQ header or alignment.

    ``pair`` drops ``@``, the comment and a ``/1``/``/2`` suffix; ``dedup`` drops the
    first and the last two characters whatever they are; ``slash`` keeps the text
    before the first ``/``.
    """
    h = _c(header)
    if style == "pair":
        return F.regexp_replace(F.regexp_extract(h, r"^@?(\S*)", 1), "/[12]$", "")
    if style == "dedup":
        return F.substring(h, F.lit(2), F.greatest(F.length(h) - 3, F.lit(0)))
    if style == "slash":
        return F.substring_index(h, "/", 1)
    raise ValueError(f"unknown read_name style: {style}")


def safe_name(allele: Column | str) -> Column:
    return F.translate(_c(allele), "*:", "__")


def short_gene(gene: Column | str) -> Column:
    return F.regexp_replace(_c(gene), "^HLA[-_]", "")


def long_gene(gene: Column | str) -> Column:
    return F.concat(F.lit("HLA-"), short_gene(gene))


def contig_name(gene: Column | str) -> Column:
    return F.replace(_c(gene), F.lit("-"), F.lit("_"))


def allele_prefix(gene: Column | str) -> Column:
    return F.concat(short_gene(gene), F.lit("*"))


def allele_from_header(header: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(header), ALLELE_IN_HEADER, 1), F.lit(""))


def split_quartet(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda x: x != "")


def quartet_key(quartet: Column | str) -> Column:
    """Order-free identity of a quartet: sorted R pair and sorted D pair."""
    q = _c(quartet)
    return F.struct(F.array_sort(F.slice(q, 1, 2)).alias("r"), F.array_sort(F.slice(q, 3, 2)).alias("d"))


def pair_overlap(left: Column, right: Column) -> Column:
    """Multiset overlap of two two-element arrays."""
    l1, l2, r1, r2 = (F.get(a, F.lit(i)) for a in (left, right) for i in (0, 1))
    direct = (l1 == r1).cast("int") + (l2 == r2).cast("int")
    crossed = (l1 == r2).cast("int") + (l2 == r1).cast("int")
    return F.greatest(direct, crossed)


def quartet_distance(a: Column, b: Column) -> Column:
    """Share of the four slots that differ, sides kept apart, order inside a side ignored."""
    same = pair_overlap(F.slice(a, 1, 2), F.slice(b, 1, 2)) + pair_overlap(F.slice(a, 3, 2), F.slice(b, 3, 2))
    return (F.lit(4) - same) / F.lit(4.0)


def parse_support(text: Column | str) -> Column:
    """``allele:count;…`` as an array of ``struct(allele, support, rank)``; bad items are dropped."""
    items = F.split(F.coalesce(_c(text), F.lit("")), ";")
    parsed = F.transform(
        items,
        lambda x, i: F.struct(
            two_field(F.regexp_extract(x, "^(.*):[^:]*$", 1), "gate").alias("allele"),
            F.regexp_extract(x, ":([^:]*)$", 1).try_cast("double").cast("int").alias("support"),
            (i + 1).alias("rank"),
        ),
    )
    return F.filter(parsed, lambda s: s.support.isNotNull() & (s.allele != ""))
