"""k-mer set algebra: indexes of owner-specific k-mers and read support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import sequence as sq
from quadhap.operators import packed

PIECE = 2048


def explode_kmers(df: DataFrame, seq: str, k: int, keep: list[str], spread: bool = False) -> DataFrame:
    """One row per k-mer occurrence: ``keep`` columns and the packed ``kmer`` (:mod:`packed`).

    Long sequences are cut into overlapping pieces first. ``spread`` shuffles the
    pieces (one byte per base) before they grow k-fold, for inputs with few or
    very uneven files; short reads do not need it. A piece is packed once and its k-mers
    are windows of its numbers.
    """
    # Upper-casing happens before cutting; inside the cut it would run once per piece.
    whole = df.select(*keep, F.upper(seq).alias("_whole"))
    cut = whole.select(*keep, F.explode(sq.pieces("_whole", k, PIECE)).alias("_piece"))
    if spread:
        # A stated number keeps AQE from merging pieces by their size before they are expanded.
        cut = cut.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_piece")
    runs = cut.select(*keep, F.explode(F.regexp_extract_all("_piece", F.lit(f"[ACGT]{{{k},}}"), F.lit(0))).alias("_run"))
    words = runs.select(*keep, F.length("_run").alias("_len"), packed.pack_words(F.col("_run")).alias("_words"))
    each = words.select(*keep, "_words", F.explode(F.sequence(F.lit(0), F.col("_len") - k)).alias("_at"))
    return each.select(*keep, packed.kmer_at(F.col("_words"), F.col("_at"), k).alias("kmer"))


def counted_kmers(df: DataFrame, seq: str, k: int, keep: list[str], spread: bool = False) -> DataFrame:
    """``(*keep, kmer, n)``: occurrences of every k-mer, in parts that the caller adds up; equal ones are folded where they are read.

    Up to 31 bases, a numpy kernel makes and folds them in the task that has the sequence, so ``spread`` counts only beyond.
    """
    if k > packed.WORD:
        return explode_kmers(df, seq, k, keep, spread).groupBy(*keep, "kmer").agg(F.count("*").alias("n"))
    return packed.counted_kmers(df, seq, k, keep)


def _owner_names(src: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    # One row per owner of the nomenclature; two owners with one number would be an error, not a wrong index.
    owners = src.groupBy(*scope, "_id").agg(F.min("owner").alias("owner"), F.max("owner").alias("_other"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("owners with equal numbers:"), "owner", "_other")).cast("string")
    return owners.select(*scope, "_id", F.when(F.col("owner") == F.col("_other"), F.col("owner")).otherwise(clash).alias("owner"))


def short_kmer_indexes(seqs: DataFrame, ks: tuple[int, ...], owner: str = "owner", seq: str = "seq", strands: str = "both",
                       asked: DataFrame | None = None) -> dict[int, DataFrame]:
    """:func:`unique_kmer_index` of each of several k up to :data:`packed.SHORT`; the sequences are read and dealt once for all."""
    src = seqs.select(F.col(owner).alias("owner"), F.xxhash64(F.col(owner)).alias("_id"), F.col(seq).alias("_seq"))
    owners, blocks = _owner_names(src), packed.owner_blocks(src, "_seq", "_id", ks, strands == "both", asked)
    return {k: packed.owned_kmers(blocks, k, strands, asked is not None).withColumnRenamed("number", "_id").join(owners, "_id").select("kmer", "owner") for k in ks}


def unique_kmer_index(seqs: DataFrame, k: int, owner: str = "owner", seq: str = "seq", scope: tuple[str, ...] = (),
                      strands: str = "both", within: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``(*scope, kmer, owner)`` of k-mers that belong to exactly one owner inside the scope.

    ``strands``: ``forward``; ``both`` (ownership judged over both strands); or
    ``forward_then_both`` (ownership judged on the forward strand, the reverse
    complements of the kept k-mers are added afterwards). ``within`` restricts to
    the k-mers of another index. ``asked``, ``(seq)``, allows to leave out all k-mers but those
    of these sequences: whoever only meets them need not have the rest.

    A k-mer's smallest and largest owner number agree exactly when there is one owner.
    Sequences travel as super-k-mers, equal ones folded, and only the forward strand does:
    over both strands a k-mer and its reverse complement have the same owners. Short k-mers
    of one scope are folded one by one (:func:`packed.owner_blocks`).
    """
    if strands not in ("forward", "both", "forward_then_both"):
        raise ValueError(f"unknown strands: {strands}")
    if k <= packed.SHORT and not scope and within is None:
        return short_kmer_indexes(seqs, (k,), owner, seq, strands, asked)[k]
    src = seqs.select(*scope, F.col(owner).alias("owner"), F.xxhash64(F.col(owner)).alias("_id"), F.col(seq).alias("_seq"))
    owners = _owner_names(src, scope)
    found = packed.owners_of_kmers(packed.super_kmers(src, "_seq", "_id", k, scope), k, scope, strands == "both")
    index = found.where("lo = hi").withColumnRenamed("lo", "_id").join(owners, [*scope, "_id"]).select(*scope, "kmer", "owner")
    if strands == "both":
        index = packed.both_strands(index, k)
    if within is not None:
        shared = [c for c in (*scope, "kmer") if c in within.columns]
        index = index.join(within.select(*shared).distinct().hint("shuffle_hash"), shared, "left_semi")
    if strands == "forward_then_both":
        # distinct: a k-mer and its reverse complement may both be kept
        index = packed.both_strands(index, k).distinct()
    return index


def index_sizes(index: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return index.groupBy(*scope, "owner").agg(F.count("*").alias("unique_kmers"))


def kmer_hits(reads: DataFrame, index: DataFrame, k: int, keys: list[str], seq: str = "seq",
              scope: tuple[str, ...] = (), spread: bool = False, strategy: str = "shuffle_hash") -> DataFrame:
    """``(*keys, owner, n)``: occurrences of owner-specific k-mers per read record.

    ``keys`` identify a read record and include the ``scope`` columns. k-mers with
    several owners are already gone from the index, so a promiscuous k-mer never fans
    out. Spark sizes exploded k-mers by the unexploded input, so it must not choose a
    broadcast by itself: the index side is hashed part by part behind the shuffle.
    """
    ks = counted_kmers(reads, seq, k, keys, spread)
    return ks.join(index.hint(strategy), [*scope, "kmer"]).groupBy(*keys, "owner").agg(F.sum("n").alias("n"))


def kmer_support_rank(reads: DataFrame, index: DataFrame, k: int, group: tuple[str, ...] = ("sample", "gene"),
                      record: tuple[str, ...] = ("name", "mate"), scope: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    """Family ranking by read support: ``(*group, family, reads, kmers, unique_kmers, rank)``.

    Rank order: reads, then the family's unique k-mers, both descending, then the name.
    """
    per_read = kmer_hits(reads, index, k, [*group, *record], scope=scope, spread=spread)
    fam = per_read.groupBy(*group, "owner").agg(F.count("*").alias("reads"), F.sum("n").alias("kmers"))
    fam = fam.join(index_sizes(index, scope), [*scope, "owner"], "left").withColumnRenamed("owner", "family")
    w = Window.partitionBy(*group).orderBy(F.desc("reads"), F.desc("unique_kmers"), "family")
    return fam.withColumn("rank", F.row_number().over(w))


def top_refs(ranked: DataFrame, group: list[str], label: str, count: str, rank: str, k: int, out: str) -> DataFrame:
    """``label:count;…`` of the first ``k`` ranked rows per group."""
    item = F.concat(F.col(label), F.lit(":"), F.col(count).cast("string"))
    listed = ranked.where(F.col(rank) <= k).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(rank, item.alias("t")))).alias("_l"))
    return listed.select(*group, F.array_join(F.transform("_l", lambda s: s.t), ";").alias(out))


def family_read_sets(reads: DataFrame, index: DataFrame, k: int, keys: list[str], spread: bool = False) -> DataFrame:
    """Distinct ``(*keys, family)`` where some record of the read carries a family-specific k-mer."""
    return kmer_hits(reads, index, k, keys, spread=spread).select(*keys, F.col("owner").alias("family"))


def retention_by_family(full: DataFrame, binned: DataFrame, group: list[str]) -> DataFrame:
    """Per family: full, binned, retained (in both) and missed read counts.

    Inputs are distinct ``(*group, name, family)`` read sets. The two sets are
    tagged and counted in one shuffle rather than joined.
    """
    tagged = full.select(*group, "name", "family", F.lit(1).alias("f"), F.lit(0).alias("b")).unionByName(
        binned.select(*group, "name", "family", F.lit(0).alias("f"), F.lit(1).alias("b"))
    )
    per_name = tagged.groupBy(*group, "family", "name").agg(F.max("f").alias("f"), F.max("b").alias("b"))
    return per_name.groupBy(*group, "family").agg(
        F.sum("f").alias("full_reads"),
        F.sum("b").alias("binned_reads"),
        F.count_if((F.col("f") == 1) & (F.col("b") == 1)).alias("retained_reads"),
        F.count_if((F.col("f") == 1) & (F.col("b") == 0)).alias("missed_reads"),
    )


def binning_diagnosis(full: list[Column], binned: list[Column], missed: list[Column]) -> Column:
    """Four-way label over several k: was the family's evidence lost when reads were binned by gene?"""

    def total(cols: list[Column]) -> Column:
        return sum(cols[1:], cols[0])

    return (
        F.when(total(full) == 0, "not_in_full_fastq_by_unique_kmers")
        .when((total(missed) > 0) & (total(binned) == 0), "present_in_full_but_lost_by_binning")
        .when(total(missed) > 0, "partly_lost_by_binning")
        .otherwise("retained_by_binning_if_detectable")
    )


def retention_diagnosis(full_reads: DataFrame, binned_reads: DataFrame, families: DataFrame, ks: tuple[int, int] = (31, 51),
                        group: tuple[str, ...] = ("sample",), spread: bool = False) -> DataFrame:
    """Retention of every family at two k-mer lengths and the resulting diagnosis.

    ``families``: ``(owner, seq)`` used to build one index per k.
    """
    out = None
    g = list(group)
    asked = full_reads.select("seq").unionByName(binned_reads.select("seq"))
    short = short_kmer_indexes(families, ks, asked=asked) if max(ks) <= packed.SHORT else {}
    for k in ks:
        index = short[k] if short else unique_kmer_index(families, k)
        keys = [*g, "name"]
        one = retention_by_family(
            family_read_sets(full_reads, index, k, keys, spread), family_read_sets(binned_reads, index, k, keys, spread), g
        ).select(*g, "family", *[F.col(c).alias(f"{c}_k{k}") for c in ("full_reads", "binned_reads", "retained_reads", "missed_reads")])
        out = one if out is None else out.join(one, [*g, "family"], "full")
    counts = [f"{c}_k{k}" for k in ks for c in ("full_reads", "binned_reads", "retained_reads", "missed_reads")]
    out = out.na.fill(0, counts)
    cols = lambda c: [F.col(f"{c}_k{k}") for k in ks]
    for k in ks:
        out = out.withColumn(f"retained_fraction_k{k}", F.when(F.col(f"full_reads_k{k}") > 0, F.col(f"retained_reads_k{k}") / F.col(f"full_reads_k{k}")))
    return out.withColumn("diagnosis", binning_diagnosis(cols("full_reads"), cols("binned_reads"), cols("missed_reads")))


def choose_reference(records: DataFrame, support: DataFrame | None, group: list[str], fallback_group: list[str]) -> DataFrame:
    """Reference record per group: longest of the best-supported family, else longest overall.

    ``records``: ``(*fallback_group, family, allele, seq, len)``; ``support``:
    ``(*group, family, reads)``. Ties go to the larger name.
    """
    biggest = F.max_by(F.struct("allele", "seq", "len"), F.struct("len", "allele")).alias("ref")
    longest = records.groupBy(*fallback_group).agg(biggest)
    if support is None:
        return longest.select(*fallback_group, "ref.*", F.lit("longest").alias("mode"), F.lit(0).alias("support"))
    best = support.groupBy(*group).agg(F.max_by("family", F.struct("reads", "family")).alias("family"), F.max("reads").alias("reads"))
    in_family = records.groupBy(*fallback_group, "family").agg(biggest)
    out = best.join(in_family, [*fallback_group, "family"], "left").join(longest.withColumnRenamed("ref", "any"), fallback_group, "left")
    return out.select(
        *group, F.coalesce("ref", "any").alias("ref"), "reads", F.col("ref").isNotNull().alias("by_support"), "family"
    ).select(
        *group, "ref.*",
        F.when(F.col("by_support"), F.concat(F.lit("top-read-support:"), "family")).otherwise("longest").alias("mode"),
        F.when(F.col("by_support"), F.col("reads")).otherwise(0).alias("support"),
    )
