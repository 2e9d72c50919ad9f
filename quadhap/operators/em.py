"""Expectation–maximisation over multi-mapped reads, for all (sample, gene) problems at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import dose, names
from quadhap.operators.ranking import top_k
from quadhap.session import cut_lineage

FLOOR = 1e-12
GROUP = ["sample", "gene"]


def family_representatives(alleles: DataFrame, per_family: int = 5, mode: str = "em") -> DataFrame:
    """Longest alleles per family (input order on ties): ``(gene, allele, family, seq, len, rank)``.

    ``alleles``: ``(gene, allele, seq, ord)``.
    """
    a = alleles.withColumns({"family": names.two_field("allele", mode), "len": F.length("seq")})
    return top_k(a, ["gene", "family"], [F.desc("len"), F.asc("ord")], per_family)


def fold_reads(alignments: DataFrame) -> DataFrame:
    """``(sample, gene, sig, n)``: reads that hit the same contigs with the same score differences, counted.

    ``alignments``: competitive alignments ``(sample, gene, read, contig, score)``. This is
    the only pass over the alignments; everything later works on the folded rows.
    """
    w = Window.partitionBy(*GROUP, "read")
    gaps = alignments.withColumn("gap", F.col("score") - F.max("score").over(w))
    per_read = gaps.groupBy(*GROUP, "read").agg(F.array_sort(F.collect_list(F.struct("contig", "gap"))).alias("sig"))
    return per_read.groupBy(*GROUP, "sig").agg(F.count("*").alias("n"))


def contig_numbers(folded: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """``(sample, gene, contig, idx)``; with ``contigs (gene, contig)`` also those without reads."""
    if contigs is not None:
        seen = folded.select(*GROUP).distinct().join(contigs.select("gene", "contig").distinct(), "gene").select(*GROUP, "contig")
    else:
        seen = folded.select(*GROUP, F.explode("sig").alias("s")).select(*GROUP, "s.contig").distinct()
    return seen.withColumn("idx", F.row_number().over(Window.partitionBy(*GROUP).orderBy("contig")) - 1)


def read_classes(folded: DataFrame, numbered: DataFrame, temperature: float = 2.0) -> DataFrame:
    """``(sample, gene, idx array<int>, w array<double>, n)`` with the weight
    ``exp((score − best) / temperature)`` of every alignment of the class."""
    flat = folded.select(*GROUP, "sig", "n", F.explode("sig").alias("s")).select(*GROUP, "sig", "n", "s.contig", "s.gap")
    flat = flat.join(numbered, [*GROUP, "contig"]).groupBy(*GROUP, "sig", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "gap"))).alias("e"))
    return flat.select(
        *GROUP, F.transform("e", lambda s: s.idx).alias("idx"), F.transform("e", lambda s: F.exp(s.gap / temperature)).alias("w"), "n"
    )


def _salted(classes: DataFrame, numbered: DataFrame, salts: int) -> DataFrame:
    """Classes with a salt, plus one class of weight zero per group that names every contig,
    so that each iteration returns the whole abundance vector."""
    n = numbered.groupBy(*GROUP).agg(F.count("*").cast("int").alias("k"))
    every = n.select(*GROUP, F.sequence(F.lit(0), F.col("k") - 1).alias("idx"), F.array_repeat(F.lit(1.0), F.col("k")).alias("w"),
                     F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("salt"))
    return classes.withColumn("salt", F.pmod(F.xxhash64("idx", "w"), F.lit(salts)).cast("int")).unionByName(every)


def _expected(classes: DataFrame, state: DataFrame, salts: int) -> DataFrame:
    """``(sample, gene, i, x, theta, done, iters)``: expected reads per contig under the current abundances.

    The abundance vector is copied to every salt, so the classes of one deep group are
    worked on by many tasks. The state is read once, which keeps the plan of many
    iterations linear. Groups that are done only pass their vector on.
    """
    spread = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    j = classes.join(spread, [*GROUP, "salt"]).where("not done or n = 0")
    raw = F.zip_with("idx", "w", lambda i, w: F.struct(i.alias("i"), (F.get("theta", i) * w).alias("u"), F.get("theta", i).alias("theta")))
    j = j.withColumn("_raw", raw).withColumn("_den", F.greatest(F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + x.u), F.lit(1e-30)))
    hits = j.select(*GROUP, "done", "iters", "n", "_den", F.explode("_raw").alias("r"))
    return hits.groupBy(*GROUP, F.col("r.i").alias("i")).agg(
        F.sum(F.col("n") * F.col("r.u") / F.col("_den")).alias("x"), F.max("r.theta").alias("theta"), F.max("done").alias("done"), F.max("iters").alias("iters")
    )


def _step(classes: DataFrame, state: DataFrame, tol: float, salts: int) -> DataFrame:
    """One iteration; groups that converged keep their abundances."""
    got = _expected(classes, state, salts).groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.struct("i", "x", "theta"))).alias("v"), F.max("done").alias("done"), F.max("iters").alias("iters")
    )
    new = got.withColumn("tot", F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.x + FLOOR))
    new = new.withColumn("next", F.transform("v", lambda e: F.when(F.col("done"), e.theta).otherwise((e.x + FLOOR) / F.col("tot"))))
    delta = F.aggregate(F.zip_with("next", "v", lambda a, e: F.abs(a - e.theta)), F.lit(0.0), lambda acc, d: acc + d)
    return new.select(
        *GROUP, F.col("next").alias("theta"), (F.col("done") | (delta < tol)).alias("done"),
        (F.col("iters") + F.when(F.col("done"), 0).otherwise(1)).alias("iters"),
    )


def initial_state(numbered: DataFrame) -> DataFrame:
    n = numbered.groupBy(*GROUP).agg(F.count("*").cast("int").alias("n"))
    return n.select(*GROUP, F.array_repeat(F.lit(1.0) / F.col("n"), F.col("n")).alias("theta"), F.lit(False).alias("done"), F.lit(0).alias("iters"))


def em_steps(classes: DataFrame, numbered: DataFrame, steps: int, tol: float = 1e-6, salts: int = 8) -> DataFrame:
    """A fixed number of iterations and the final expected counts as one plan, without an action."""
    salted, state = _salted(classes, numbered, salts), initial_state(numbered)
    for _ in range(steps):
        state = _step(salted, state, tol, salts)
    return abundances(salted, state, numbered, salts)


def abundances(salted: DataFrame, state: DataFrame, numbered: DataFrame, salts: int = 8) -> DataFrame:
    """``(sample, gene, contig, theta, weight, iters)``; ``weight`` is the expected read count."""
    last = _expected(salted, state.withColumn("done", F.lit(False)), salts)
    return numbered.join(last.withColumnRenamed("i", "idx"), [*GROUP, "idx"]).select(
        *GROUP, "contig", "theta", F.col("x").alias("weight"), "iters"
    )


def em_abundance(alignments: DataFrame, temperature: float = 2.0, max_iter: int = 300, tol: float = 1e-6, contigs: DataFrame | None = None,
                 steps_per_cut: int = 5, salts: int = 8) -> DataFrame:
    """Abundances of all groups: ``(sample, gene, contig, theta, weight, iters, converged)``.

    One distributed loop for groups of any size, whose evidence classes are spread over
    salts; the lineage is cut every ``steps_per_cut`` iterations and each group stops by
    itself. ``converged`` is false for groups that ``max_iter`` stopped.
    """
    folded = cut_lineage(fold_reads(alignments))
    numbered = cut_lineage(contig_numbers(folded, contigs))
    salted = cut_lineage(_salted(read_classes(folded, numbered, temperature), numbered, salts))
    state = initial_state(numbered)
    for first in range(0, max_iter, steps_per_cut):
        for _ in range(min(steps_per_cut, max_iter - first)):
            state = _step(salted, state, tol, salts)
        state = cut_lineage(state)
        if state.where("not done").isEmpty():
            break
    finished = state.select(*GROUP, F.col("done").alias("converged"))
    return abundances(salted, state, numbered, salts).join(finished, GROUP)


def rollup_families(abundance: DataFrame, contig_family: DataFrame) -> DataFrame:
    """Family weights: ``(sample, gene, family, weight, fraction, contig)``; ``contig`` is the heaviest member.

    ``contig_family``: ``(gene, contig, family)``.
    """
    fam = abundance.join(contig_family, ["gene", "contig"]).groupBy(*GROUP, "family").agg(
        F.sum("weight").alias("weight"), F.min_by("contig", F.struct(-F.col("weight"), "contig")).alias("contig")
    )
    total = F.sum("weight").over(Window.partitionBy(*GROUP))
    return fam.withColumn("fraction", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


def em_summary(families: DataFrame, fit: DataFrame, n_reads: DataFrame) -> DataFrame:
    """Per (sample, gene): residual of the fit, reads, largest family share and fitted χ."""
    top = families.groupBy(*GROUP).agg(F.max("fraction").alias("top_frac"))
    return fit.join(top, GROUP).join(n_reads, GROUP, "left").select(
        *GROUP, F.col("score").alias("sum_abs_diff"), "n_reads", "top_frac", F.col("chi_fit").alias("chi_r_fit")
    )


def calls_from_quartet(fit: DataFrame, families: DataFrame, contig_name: DataFrame | None = None) -> DataFrame:
    """Long calls of a fitted quartet: one row per haplotype with dose fraction and read support.

    ``contig_name``: ``(gene, contig, allele)`` full names of representatives.
    """
    slots = fit.select(*GROUP, "chi_fit", F.posexplode("quartet").alias("p", "family"))
    side = F.when(F.col("p") < 2, "R").otherwise("D")
    out = slots.join(families, [*GROUP, "family"], "left")
    if contig_name is not None:
        out = out.join(contig_name, ["gene", "contig"], "left")
    full = F.coalesce(F.col("allele"), F.col("family")) if contig_name is not None else F.col("family")
    return out.select(
        *GROUP, (F.col("p") + 1).alias("global_hap"), side.alias("assignment"), full.alias("allele"), "family",
        dose.slot_fraction(side, F.col("chi_fit")).alias("hap_fraction"),
        F.coalesce("fraction", F.lit(0.0)).alias("allele_read_fraction"), F.coalesce("weight", F.lit(0.0)).alias("allele_read_count"),
    )
