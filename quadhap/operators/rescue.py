"""Rescue of read pairs that gene binning lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.functions import names
from quadhap.operators import kmers as km
from quadhap.operators.ranking import top_k


@dataclass(frozen=True)
class BinRescue:
    """Thresholds of the gene-bin rescue. The two ``max_rescue`` limits apply only if set; the manifest then says which bins they stopped."""

    k: int = 31
    min_hits: int = 1
    min_margin: int = 1
    require_both_mates: bool = False
    min_mate_hits: int = 1
    max_rescue_fraction: float | None = None
    max_rescue_pairs: int | None = None
    retention_gate: bool = False
    min_full_pairs: int = 50
    max_retained_fraction: float = 0.10
    min_missing_fraction: float = 0.30
    min_rescue_pairs: int = 50


def choose_gene(pairs: DataFrame, index: DataFrame, p: BinRescue, spread: bool = False) -> DataFrame:
    """``(sample, rec, name, reason, gene, top_hits, second_hits)``, one row per input pair.

    ``pairs``: ``(sample, rec, name, seq1, seq2)`` with ``rec`` unique in the sample;
    ``index``: gene-specific k-mers ``(kmer, owner)``. Hits are distinct k-mers over
    both mates. Reasons are checked in a fixed order.
    """
    ends = pairs.select("sample", "rec", F.explode(F.array(
        F.struct(F.lit(1).alias("m"), F.col("seq1").alias("s")), F.struct(F.lit(2).alias("m"), F.col("seq2").alias("s"))
    )).alias("e")).select("sample", "rec", "e.m", "e.s")
    found = km.counted_kmers(ends, "s", p.k, ["sample", "rec", "m"], spread).join(index.hint("shuffle_hash"), "kmer")
    per_gene = found.groupBy("sample", "rec", "owner", "kmer").agg(
        F.max((F.col("m") == 1).cast("int")).alias("m1"), F.max((F.col("m") == 2).cast("int")).alias("m2")
    ).groupBy("sample", "rec", "owner").agg(F.count("*").alias("hits"), F.sum("m1").alias("h1"), F.sum("m2").alias("h2"))
    # At most one entry per gene, so the list is short whatever the read depth.
    ranked = per_gene.groupBy("sample", "rec").agg(
        F.sort_array(F.collect_list(F.struct("hits", "owner", "h1", "h2")), False).alias("g")
    )
    top, second = F.get("g", F.lit(0)), F.coalesce(F.get("g", F.lit(1))["hits"], F.lit(0))
    mates_missing = (top.h1 < p.min_mate_hits) | (top.h2 < p.min_mate_hits) if p.require_both_mates else F.lit(False)
    out = pairs.select("sample", "rec", "name").join(ranked, ["sample", "rec"], "left").select(
        "sample", "rec", "name", top.owner.alias("gene"), F.coalesce(top.hits, F.lit(0)).alias("top_hits"),
        F.when(F.col("g").isNull(), "no_gene_unique_kmer")
        .when(top.hits < p.min_hits, "below_min_hits")
        .when(top.hits - second < p.min_margin, "ambiguous_gene_hits")
        .when(mates_missing, "missing_mate_support")
        .otherwise("rescued").alias("reason"),
        F.when(F.col("g").isNull(), F.lit(0)).otherwise(second).alias("second_hits"),
    )
    return out.withColumn("gene", F.when(F.col("reason") == "rescued", F.col("gene")))


def rescue_binned_reads(pairs: DataFrame, binned: DataFrame, index: DataFrame, target_genes: list[str],
                        p: BinRescue = BinRescue(), spread: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs missing from their gene's bin, and a manifest per (sample, target gene).

    ``binned``: ``(sample, gene, name)``. Returns ``(status per pair, manifest)``.
    """
    chosen = choose_gene(pairs, index, p, spread)
    kept = binned.select("sample", "gene", "name").distinct()
    flagged = chosen.join(kept.withColumn("in_bin", F.lit(True)), ["sample", "gene", "name"], "left")
    first = flagged.where("in_bin is null and gene is not null").groupBy("sample", "gene", "name").agg(F.min("rec").alias("first_rec"))
    status = flagged.join(first, ["sample", "gene", "name"], "left").withColumn(
        "status",
        F.when(F.col("reason") != "rescued", F.col("reason"))
        .when(~F.col("gene").isin(*target_genes), "assigned_to_non_target_gene")
        .when(F.col("in_bin"), "already_in_target_gene")
        .when(F.col("rec") != F.col("first_rec"), "duplicate_rescue_candidate")
        .otherwise("rescued"),
    ).select("sample", "rec", "name", "gene", "status", "top_hits", "second_hits")

    counts = status.where(F.col("gene").isin(*target_genes)).groupBy("sample", "gene").agg(
        F.count("*").alias("full_gene_pairs"),
        F.count_if(F.col("status") == "already_in_target_gene").alias("retained_gene_pairs"),
        F.count_if(F.col("status") == "rescued").alias("rescued_pairs"),
    )
    sizes = kept.where(F.col("gene").isin(*target_genes)).groupBy("sample", "gene").agg(F.count("*").alias("original_pairs"))
    unique = km.index_sizes(index).withColumnRenamed("owner", "gene")
    genes = pairs.select("sample").distinct().withColumn("gene", F.explode(F.array(*[F.lit(g) for g in target_genes])))
    m = genes.join(counts, ["sample", "gene"], "left").join(sizes, ["sample", "gene"], "left").join(unique, "gene", "left").na.fill(0)
    share = lambda c: F.when(F.col("full_gene_pairs") > 0, F.col(c) / F.col("full_gene_pairs")).otherwise(0.0)
    ceiling = F.lit(p.max_rescue_pairs).cast("long")
    by_fraction = F.floor(F.col("original_pairs") * F.lit(p.max_rescue_fraction).cast("double"))
    m = m.withColumns({
        "retained_fraction": share("retained_gene_pairs"),
        "missing_fraction": share("rescued_pairs"),
        "allowed_pairs": F.when(by_fraction > 0, F.least(ceiling, by_fraction)).otherwise(ceiling),
    })
    gate = F.when(F.col("rescued_pairs") == 0, "no_rescues").when(F.col("rescued_pairs") > F.col("allowed_pairs"), "skipped_too_many_rescues")
    if p.retention_gate:
        gate = (
            gate.when(F.col("full_gene_pairs") < p.min_full_pairs, "skipped_low_full_gene_support")
            .when(F.col("rescued_pairs") < p.min_rescue_pairs, "skipped_low_rescue_pairs")
            .when((F.col("retained_fraction") > p.max_retained_fraction) & (F.col("missing_fraction") < p.min_missing_fraction), "skipped_retention_ok")
        )
    manifest = m.select(
        "sample", "gene", "unique_kmers", "original_pairs", "full_gene_pairs", "retained_gene_pairs", "retained_fraction",
        "missing_fraction", "rescued_pairs", "allowed_pairs", gate.otherwise("written").alias("status"),
    )
    return status, manifest


def accepted_rescues(status: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rescued pairs of the (sample, gene) bins whose manifest row passed."""
    ok = manifest.where(F.col("status") == "written").select("sample", "gene")
    return status.where(F.col("status") == "rescued").join(ok, ["sample", "gene"], "left_semi")


def rescue_family_reads(pairs: DataFrame, binned: DataFrame, index: DataFrame, k: int = 31, min_full: int = 2, min_missed: int = 1,
                        max_retained: float = 0.5, min_unique: int = 100, max_number: int = 100, max_add: int | None = None,
                        spread: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of under-binned families.

    ``pairs`` and ``binned``: ``(sample, rec, name, seq1, seq2)``; ``index``: family
    k-mers. Returns ``(added pairs, family table)``. With ``max_add`` only the first pairs by
    position are added, and ``add_rank`` counts them.
    """

    def read_sets(df: DataFrame) -> DataFrame:
        ends = df.select("sample", "name", F.explode(F.array("seq1", "seq2")).alias("seq"))
        return km.family_read_sets(ends, index, k, ["sample", "name"], spread)

    full = read_sets(pairs)
    sizes = km.index_sizes(index).withColumnRenamed("owner", "family")
    table = km.retention_by_family(full, read_sets(binned), ["sample"]).where("full_reads > 0").join(sizes, "family", "left")
    table = table.na.fill(0, ["unique_kmers"]).withColumn("retained_fraction", F.col("binned_reads") / F.col("full_reads"))
    table = table.withColumn(
        "candidate",
        (F.col("full_reads") >= min_full) & (F.col("missed_reads") >= min_missed) & (F.col("retained_fraction") <= max_retained)
        & (F.col("unique_kmers") >= min_unique) & (names.allele_number("family", 9999, needs_colon=False) <= max_number),
    )
    wanted = full.join(table.where("candidate").select("sample", "family"), ["sample", "family"], "left_semi").select("sample", "name").distinct()
    added = pairs.join(wanted, ["sample", "name"], "left_semi").join(binned.select("sample", "name"), ["sample", "name"], "left_anti")
    # A repeated name is one read: its last record is the one kept, its first one fixes the order.
    added = added.groupBy("sample", "name").agg(F.min("rec").alias("first_rec"), F.max_by(F.struct("rec", "seq1", "seq2"), "rec").alias("r"))
    added = added.select("sample", "name", "first_rec", "r.*")
    if max_add is not None:
        added = top_k(added, ["sample"], [F.col("first_rec")], max_add, "add_rank")
    return added, table
