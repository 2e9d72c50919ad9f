"""Read naming, competitive read-to-gene assignment and alignment summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import alignment as aln
from quadhap.operators.ranking import occurrence_number


def dedup_read_names(reads: DataFrame, keys: tuple[str, ...] = ("sample", "mate"), name: str = "name", rec: str = "rec",
                     width: int = 1 << 20) -> DataFrame:
    """Second and later uses of a name become ``name_2``, ``name_3`` …, in record order."""
    numbered = occurrence_number(reads, [*keys, name], rec, width)
    suffix = F.concat(F.col(name), F.lit("_"), F.col("occurrence"))
    return numbered.withColumn("unique_name", F.when(F.col("occurrence") > 1, suffix).otherwise(F.col(name)))


def assign_reads_to_genes(alignments: DataFrame, max_nm: int = 2, min_diff: float = 0.1, min_identity: float = 0.1) -> DataFrame:
    """``(sample, qname, gene, best, second, status)``, one row per aligned read.

    Only ends on the same contig as their mate, without soft clips and with at most
    ``max_nm`` edits count. Identity of a contig is Σ(matches − edits)/Σ(length); a
    contig with fewer than two ends scores 0. A gene scores its best contig.
    ``status``: ``assigned``, ``no_proper_alignment``, ``low_identity`` or ``ambiguous``
    (``gene`` is NULL unless assigned). A single candidate gene skips the margin test.
    """
    candidate = (
        ~aln.has_flag("flag", aln.UNMAPPED) & (F.col("contig") == F.col("mate_contig")) & (F.coalesce("nm", F.lit(0)) <= max_nm)
    )
    # The CIGAR is parsed once, and only where the cheap tests passed.
    ends = alignments.select("sample", "qname", "contig", "nm", F.when(candidate, aln.cigar_totals("cigar")).alias("c"))
    ends = ends.withColumn("ok", F.coalesce(F.col("c.s") == 0, F.lit(False))).select(
        "sample", "qname", "contig", F.col("ok").cast("int").alias("ok"),
        F.when(F.col("ok"), F.col("c.m") - F.coalesce("nm", F.lit(0))).otherwise(0).alias("match"),
        F.when(F.col("ok"), F.col("c.all")).otherwise(0).alias("focus"),
    )
    contigs = ends.groupBy("sample", "qname", "contig").agg(F.sum("ok").alias("ends"), F.sum("match").alias("match"), F.sum("focus").alias("focus"))
    identity = F.when((F.col("ends") >= 2) & (F.col("focus") > 0), F.col("match") / F.col("focus")).otherwise(0.0)
    scored = F.when(F.col("ends") > 0, F.struct(identity.alias("score"), F.substring_index("contig", "*", 1).alias("gene")))
    # One entry per contig of the reference, after ends were summed: bounded by the reference, not by depth.
    per_read = contigs.groupBy("sample", "qname").agg(F.sort_array(F.collect_list(scored), False).alias("s"))
    best = F.get("s", F.lit(0))
    rival = F.get(F.filter("s", lambda x: x.gene != F.get("s", F.lit(0)).gene), F.lit(0))
    out = per_read.select("sample", "qname", best.gene.alias("gene"), best.score.alias("best"), rival.score.alias("second"))
    status = (
        F.when(F.col("best").isNull(), "no_proper_alignment")
        .when(F.col("best") < min_identity, "low_identity")
        .when(F.col("second").isNull() | (F.col("best") - F.col("second") >= min_diff), "assigned")
        .otherwise("ambiguous")
    )
    return out.withColumn("status", status).withColumn("gene", F.when(F.col("status") == "assigned", F.col("gene")))


def split_reads_by_gene(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """Reads with the gene they were assigned to; write with ``partitionBy('gene')`` for per-gene bins."""
    chosen = assigned.where("gene is not null").select("sample", F.col("qname").alias("name"), "gene")
    return reads.join(chosen, ["sample", "name"])


def score_gate(target, best, min_frac: float):
    """Relative score gate that also works for negative scores, where a larger magnitude is worse."""
    if min_frac <= 0:
        return F.lit(True)
    return F.when(best > 0, target >= best * min_frac).when(best < 0, target >= best / min_frac).otherwise(target >= 0)


def extract_target_reads(alignments: DataFrame, prefixes: tuple[str, ...], min_as_frac: float = 0.9, min_as: int = -(10**9)) -> DataFrame:
    """Reads whose best alignment to a target contig comes close to their best alignment anywhere."""
    is_target = F.lit(False)
    for p in prefixes:
        is_target = is_target | F.col("contig").startswith(p)
    mapped = alignments.where(~aln.has_flag("flag", aln.UNMAPPED)) if "flag" in alignments.columns else alignments
    best = mapped.groupBy("sample", "qname").agg(F.max("score").alias("best"), F.max(F.when(is_target, F.col("score"))).alias("target_best"))
    return best.where((F.col("target_best") >= min_as) & score_gate(F.col("target_best"), F.col("best"), min_as_frac))


def competitive_alignments(alignments: DataFrame, group: tuple[str, ...] = ("sample", "gene"), min_as_frac: float = 0.95) -> DataFrame:
    """``(*group, read, contig, score)``: best score per contig, kept when within ``min_as_frac`` of the read's best.

    Reads whose best score is not positive are dropped. Duplicates per contig are
    folded before the per-read window, so a window holds at most one row per contig.
    """
    folded = alignments.groupBy(*group, "read", "contig").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*group, "read")
    top = folded.withColumn("best", F.max("score").over(w))
    return top.where((F.col("best") > 0) & (F.col("score") >= F.col("best") * min_as_frac)).drop("best")


def family_support(alignments: DataFrame, near: int = 5) -> DataFrame:
    """``(sample, family, alignments, distinct_reads, top_tie_reads, near_top_reads)`` from ``(sample, qname, family, score)``."""
    return _flagged(alignments, near).groupBy("sample", "family").agg(
        F.sum("n").alias("alignments"), F.count("*").alias("distinct_reads"),
        F.count_if("top").alias("top_tie_reads"), F.count_if("near").alias("near_top_reads"),
    )


#: Alignments that one task takes together; what it holds of them is many times their size in a shuffle.
TASK_ROWS = 1 << 18


def _dealt(alignments: DataFrame) -> DataFrame:
    """Alignments by read, in as many parts as their number asks for, so that a task's memory does not grow with the input."""
    least = int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return alignments.repartition(max(least, -(-alignments.count() // TASK_ROWS)), "sample", "qname")


def _flagged(alignments: DataFrame, near: int) -> DataFrame:
    per = _dealt(alignments).groupBy("sample", "qname", "family").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    best = F.max("score").over(Window.partitionBy("sample", "qname"))
    return per.withColumn("best", best).select(
        "sample", "qname", "family", "n", (F.col("score") == F.col("best")).alias("top"),
        (F.col("score") >= F.col("best") - near).alias("near"),
    )


def family_overlaps(alignments: DataFrame, pairs: DataFrame, near: int = 5) -> DataFrame:
    """Shared reads of the listed family pairs ``(a, b)``.

    Each read contributes one row per side of a listed pair and both sides are
    counted together, so reads are never paired with each other.
    """
    flagged = _flagged(alignments, near)
    sides = pairs.select("a", "b", F.col("a").alias("family"), F.lit(1).alias("is_a"), F.lit(0).alias("is_b")).unionByName(
        pairs.select("a", "b", F.col("b").alias("family"), F.lit(0).alias("is_a"), F.lit(1).alias("is_b"))
    )
    per_read = flagged.join(sides, "family").groupBy("sample", "a", "b", "qname").agg(
        F.sum("is_a").alias("in_a"), F.sum("is_b").alias("in_b"),
        F.count_if("top").alias("tops"), F.count_if("near").alias("nears"),
    )
    both = (F.col("in_a") > 0) & (F.col("in_b") > 0)
    return per_read.groupBy("sample", "a", "b").agg(
        F.sum("in_a").alias("reads_a"), F.sum("in_b").alias("reads_b"), F.count_if(both).alias("overlap"),
        F.count_if(both & (F.col("tops") == 2)).alias("top_overlap"),
        F.count_if(both & (F.col("nears") == 2)).alias("near_top_overlap"),
    ).withColumn("overlap_frac_of_b", F.when(F.col("reads_b") > 0, F.col("overlap") / F.col("reads_b")).otherwise(0.0))
