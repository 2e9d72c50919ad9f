"""Haplotype scoring against alleles, paired assembly and haplotype building."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadhap.operators import kmers as km
from quadhap.operators.ranking import top_k
from quadhap.operators.sites import R_SPLITS
from quadhap.session import cut_lineage

GROUP = ["sample", "gene"]
OWNERS = 62  # bits of owners in one number
SPLITS = [(s, tuple(h for h in range(4) if h not in s)) for s in R_SPLITS]


def score_haplotypes(haps: DataFrame, alleles: DataFrame, k: int = 31, match: float = 2.0, miss: float = 3.0, spread: bool = False) -> DataFrame:
    """k-mer containment score ``match·found − miss·missing`` of every haplotype against every allele of its gene.

    ``haps``: ``(sample, gene, block, hap, seq)``; ``alleles``: ``(gene, allele, seq)``.
    This ranks alleles; it does not reproduce base-level alignment scores. The owners of a k-mer
    are bits, so a haplotype's k-mer meets one row however many alleles have it, and k-mers
    of equal owners count together. The join is stated as a merge join because k-mers are
    larger than Spark assumes of the sequences.
    """
    keys = ["sample", "gene", "block", "hap"]
    names = alleles.select("gene", "allele").distinct()
    numbered = names.withColumn("number", F.row_number().over(Window.partitionBy("gene").orderBy("allele")) - 1)
    ak = km.counted_kmers(alleles.join(F.broadcast(numbered), ["gene", "allele"]), "seq", k, ["gene", "number"], spread)
    word, bit = F.floor(F.col("number") / OWNERS).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("number") % OWNERS)
    # a k-mer without owners among the first has a row for these too, so that each has one row of word 0
    placed = F.when(F.col("number") < OWNERS, F.array(F.struct(F.lit(0).alias("word"), bit.alias("bits")))).otherwise(
        F.array(F.struct(F.lit(0).alias("word"), F.lit(0).cast("bigint").alias("bits")), F.struct(word.alias("word"), bit.alias("bits"))))
    owners = ak.select("gene", "kmer", F.explode(placed).alias("o")).groupBy("gene", "kmer", "o.word").agg(F.bit_or("o.bits").alias("bits"))
    hk = km.counted_kmers(haps, "seq", k, keys, spread).select(*keys, "kmer").distinct()
    met = hk.join(owners.hint("merge"), ["gene", "kmer"], "left").select(*keys, "word", "bits").repartition(*keys)
    folded = met.groupBy(*keys, "word", "bits").agg(F.count("*").alias("n"))
    held = F.filter(F.sequence(F.lit(0), F.length(F.bin("bits")) - 1), lambda i: F.call_function("shiftright", F.col("bits"), i.cast("int")).bitwiseAND(F.lit(1)) == 1)
    found = F.coalesce(F.transform(held, lambda i: (i + F.col("word") * OWNERS).cast("int")), F.array().cast("array<int>"))
    every = F.when(F.coalesce("word", F.lit(0)) == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    each = folded.select(*keys, "n", F.explode(F.concat(every, found)).alias("number")).groupBy(*keys, "number").agg(F.sum("n").alias("n"))
    per = each.groupBy(*keys).agg(
        F.max(F.when(F.col("number") == -1, F.col("n"))).alias("total"),
        F.map_from_entries(F.collect_list(F.when(F.col("number") >= 0, F.struct("number", "n")))).alias("found"))
    hits = F.coalesce(F.element_at("found", F.col("number")), F.lit(0))
    return per.join(numbered, "gene").select(*keys, "allele", (hits * match - (F.col("total") - hits) * miss).alias("score"))


def adjust_baseline(scores: DataFrame, baseline: DataFrame, mode: str = "off", weight: float = 1.0) -> DataFrame:
    """Correct scores by what the plain reference of the block already scores: ``off``, ``sub`` or ``bonus``.

    ``baseline``: ``(sample, gene, block, allele, base)``.
    """
    if mode == "off":
        return scores
    j = scores.join(baseline, ["sample", "gene", "block", "allele"], "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    gain = F.col("score") - F.col("base")
    fixed = gain if mode == "sub" else F.col("score") + weight * F.greatest(F.lit(0.0), gain)
    return j.withColumn("score", fixed).drop("base")


def allele_pool(scores: DataFrame, top_n: int | None = None, cap: int | None = None) -> DataFrame:
    """``(sample, gene, allele)``: all scored alleles, or those in the top ``top_n`` of some haplotype, or of these the best ``cap`` by global score."""
    pool = scores
    if top_n is not None:
        pool = top_k(scores, [*GROUP, "block", "hap"], [F.desc("score"), F.asc("allele")], top_n)
    pool = pool.select(*GROUP, "allele").distinct()
    if cap is None:
        return pool
    per_block = scores.groupBy(*GROUP, "block", "allele").agg(F.max("score").alias("best"))
    total = per_block.groupBy(*GROUP, "allele").agg(F.sum("best").alias("total"))
    return top_k(pool.join(total, [*GROUP, "allele"]), GROUP, [F.desc("total"), F.asc("allele")], cap).select(*GROUP, "allele")


PAIR = ["a", "b"]
#: Scores equal to this many digits are ties; a bound must miss by more than this to exclude.
DIGITS, SURE = 9, 1e-6
#: Alleles, and pairs of each side, whose combinations give the totals that bounds are held against.
SEEDS = 4
PAIR_SEEDS = 8


def _pair_sides(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(sample, gene, block, a, b, side)``: for each two local haplotypes (in the order of ``R_SPLITS``) the better of both ways to give them the pair."""
    one, two = (cells.select(*GROUP, "block", F.col("allele").alias(n), F.col("h").alias(f"h{n}")) for n in PAIR)
    both = pairs.select(*GROUP, *PAIR).join(one, [*GROUP, "a"]).join(two, [*GROUP, "block", "b"])
    at = lambda n, i: F.get(f"h{n}", F.lit(i))
    side = F.array(*[F.greatest(at("a", x) + at("b", y), at("a", y) + at("b", x)) for x, y in R_SPLITS])
    return both.select(*GROUP, "block", *PAIR, side.alias("side"))


def _of_split(r: Column, d: Column, penalty: Column) -> Column:
    """A block's score under each of the six splits."""
    other = [R_SPLITS.index(rest) for _, rest in SPLITS]
    return F.array(*[F.get(r, F.lit(j)) + F.get(d, F.lit(other[j])) - F.get(penalty, F.lit(j)) for j in range(len(SPLITS))])


def _totals(r: DataFrame, d: DataFrame, blocks: DataFrame, paired: bool) -> DataFrame:
    """``(sample, gene, q, score)`` of every recipient pair with every donor pair; ``q``: the four alleles as a struct."""
    left = r.select(*GROUP, "block", F.col("a").alias("f1"), F.col("b").alias("f2"), F.col("side").alias("sr"))
    right = d.select(*GROUP, "block", F.col("a").alias("f3"), F.col("b").alias("f4"), F.col("side").alias("sd"))
    both = left.join(right, [*GROUP, "block"]).join(blocks.select(*GROUP, "block", "penalty"), [*GROUP, "block"])
    if not paired:  # a multiset of four, listed once: its sorted form
        both = both.where("f2 <= f3")
    best = F.array_max(_of_split(F.col("sr"), F.col("sd"), F.col("penalty")))
    return both.groupBy(*GROUP, F.struct("f1", "f2", "f3", "f4").alias("q")).agg(F.sum(best).alias("score"))


def _floor(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*GROUP).agg(F.max("score").alias("floor"))


def _pairs(alleles: DataFrame) -> DataFrame:
    """Unordered pairs of a group's alleles, which the bounds have made few."""
    one, two = (alleles.select(*GROUP, F.col("allele").alias(n)) for n in PAIR)
    return one.join(two, GROUP).where("a <= b")


def assemble(scores: DataFrame, penalties: DataFrame | None = None, top_n: int | None = None, cap: int | None = None, paired: bool = True) -> DataFrame:
    """Best allele quartet of every gene: ``(sample, gene, quartet, score, blocks, splits)``.

    ``scores``: ``(sample, gene, block, hap 1..4, allele, score)``; ``penalties``:
    ``(sample, gene, block, penalty array<double> of six)``. The score of a quartet sums,
    per block, the best assignment of the four local haplotypes; which two of them are
    the recipient's is one of six splits, and inside a side both orders are tried.
    ``paired=False`` treats the quartet as one multiset without sides. Of equal scores the
    first quartet in order of names wins.

    Quartets are not enumerated. In a block, the two haplotypes that a pair leaves can score
    at most the sum of their maxima over all alleles, and one allele at most what it scores on
    one haplotype plus the other three maxima. Summed over blocks this bounds every quartet of
    an allele, and every quartet of a recipient or a donor pair. Alleles, then pairs, whose bound
    is under a total already found are dropped; only the rest is combined and scored.
    """
    pool = allele_pool(scores, top_n, cap)
    listed = pool.groupBy(*GROUP).agg(F.count("*").alias("n_alleles")).where("n_alleles >= 2").select(*GROUP)
    pool = pool.join(listed, GROUP, "left_semi")
    wide = scores.join(pool, [*GROUP, "allele"], "left_semi").groupBy(*GROUP, F.col("block").cast("int").alias("block"), "allele").agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("hap") == h, F.col("score").cast("double"))), F.lit(0.0)) for h in range(1, 5)]).alias("h"))
    wide = cut_lineage(wide)
    pool = wide.select(*GROUP, "allele").distinct()
    none = F.array(*[F.lit(0.0)] * 6)
    blocks = wide.select(*GROUP, "block").distinct()
    if penalties is None:
        blocks = blocks.withColumn("penalty", none)
    else:
        blocks = blocks.join(penalties, [*GROUP, "block"], "left").withColumn("penalty", F.coalesce("penalty", none))
    # an allele without scores in a block has zeros there
    cells = cut_lineage(blocks.select(*GROUP, "block").join(pool, GROUP).join(wide, [*GROUP, "block", "allele"], "left").withColumn("h", F.coalesce("h", F.array(*[F.lit(0.0)] * 4))))
    top = cells.groupBy(*GROUP, "block").agg(F.array(*[F.max(F.get("h", F.lit(i))) for i in range(4)]).alias("top"))
    blocks = cut_lineage(blocks.join(top, [*GROUP, "block"]).withColumn("rest", F.array(*[F.get("top", F.lit(x)) + F.get("top", F.lit(y)) for x, y in R_SPLITS])))

    gain = F.array_max(F.zip_with("h", "top", lambda x, m: x - m)) + F.aggregate("top", F.lit(0.0), lambda t, m: t + m) - F.array_min("penalty")
    alleles = cells.join(blocks, [*GROUP, "block"]).groupBy(*GROUP, "allele").agg(F.sum(gain).alias("bound"))
    alleles = cut_lineage(alleles)
    seeds = _pair_sides(cells, _pairs(top_k(alleles, GROUP, [F.desc("bound"), F.asc("allele")], SEEDS)))
    floor = cut_lineage(_floor(_totals(seeds, seeds, blocks, paired)))
    few = alleles.join(floor, GROUP).where(F.col("bound") >= F.col("floor") - SURE)

    sides = cut_lineage(_pair_sides(cells, _pairs(few)))
    bounds = sides.join(blocks, [*GROUP, "block"]).groupBy(*GROUP, *PAIR).agg(
        F.sum(F.array_max(_of_split(F.col("side"), F.col("rest"), F.col("penalty")))).alias("as_r"),
        F.sum(F.array_max(_of_split(F.col("rest"), F.col("side"), F.col("penalty")))).alias("as_d"))
    bounds = cut_lineage(bounds)
    first = [top_k(bounds, GROUP, [F.desc(c), F.asc("a"), F.asc("b")], PAIR_SEEDS) for c in ("as_r", "as_d")]
    better = _floor(_totals(*[sides.join(f, [*GROUP, *PAIR], "left_semi") for f in first], blocks, paired)).withColumnRenamed("floor", "found")
    held = cut_lineage(bounds.join(floor, GROUP).join(better, GROUP, "left").withColumn("floor", F.greatest("floor", "found")))
    r, d = (sides.join(held.where(F.col(c) >= F.col("floor") - SURE), [*GROUP, *PAIR], "left_semi") for c in ("as_r", "as_d"))
    totals = _totals(r, d, blocks, paired)
    best = totals.groupBy(*GROUP).agg(F.min_by(F.struct("q", "score"), F.struct(-F.round("score", DIGITS), F.col("q"))).alias("won")).select(*GROUP, "won.*")
    best = cut_lineage(best)

    def side_of(x: str, y: str) -> DataFrame:
        return _pair_sides(cells, best.select(*GROUP, F.col(f"q.{x}").alias("a"), F.col(f"q.{y}").alias("b"))).select(*GROUP, "block", F.col("side").alias(f"side_{x}"))

    split = _of_split(F.col("side_f1"), F.col("side_f3"), F.col("penalty"))
    at = side_of("f1", "f2").join(side_of("f3", "f4"), [*GROUP, "block"]).join(blocks, [*GROUP, "block"]).withColumn("by", split)
    at = at.select(*GROUP, F.struct("block", (F.array_position("by", F.array_max("by")) - 1).cast("int").alias("split")).alias("s"))
    chosen = at.groupBy(*GROUP).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return best.join(chosen, GROUP).select(
        *GROUP, F.array(*[F.col(f"q.f{i}") for i in range(1, 5)]).alias("quartet"), "score", F.transform("s", lambda x: x["block"]).alias("blocks"), F.transform("s", lambda x: x["split"]).alias("splits"))


@F.arrow_udf(StringType())
def _edited(start: pa.Array, seq: pa.Array, edits: pa.Array) -> pa.Array:
    never = 1 << 40  # a missing number fits nowhere
    number = lambda a: a.cast(pa.int64()).fill_null(never).to_numpy()
    ends, e = edits.offsets.to_numpy(), edits.values
    at0 = np.repeat(number(start), np.diff(ends))
    rel = number(e.field("pos0"))[ends[0] : ends[-1]] - at0
    size, alt = number(e.field("n"))[ends[0] : ends[-1]], e.field("alt").to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    ends, out = ends - ends[0], []
    for text, lo, hi in zip(seq.to_pylist(), ends[:-1], ends[1:]):
        if text is not None:
            parts, at, last = [], 0, len(text)
            for r, n, new in zip(rel[lo:hi].tolist(), size[lo:hi].tolist(), alt[lo:hi].tolist()):
                if r >= at and r + n <= last:
                    parts += text[at:r], new
                    at = r + n
            text = None if None in parts else "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def edit_haplotypes(haps: DataFrame) -> DataFrame:
    """``(sample, gene, hap, seq)`` of ``(sample, gene, hap, start, seq, e)``; ``e array<struct<pos0,n,alt>>``: the haplotype's edits in order, each replacing ``n`` bases.

    One pass over a slice and its edits, whatever their number: expressions would look for
    each place from the slice's first byte on and copy what is built once per edit.
    """
    e = F.coalesce("e", F.array().cast(haps.schema["e"].dataType))
    return haps.select(*GROUP, "hap", _edited("start", "seq", e).alias("seq"))


def build_haplotypes(slices: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply each haplotype's edits to its reference slice: ``(sample, gene, hap, seq)``.

    ``slices``: ``(sample, gene, start, seq)``; ``edits``: ``(sample, gene, hap, pos0, ref, alt)``.
    Edits outside the slice, or starting inside an earlier edit, are skipped. Every
    haplotype 1..4 of a slice is returned, unedited where it has no edits.
    """
    inside = edits.groupBy(*GROUP, "hap").agg(F.array_sort(F.collect_list(F.struct("pos0", F.length("ref").alias("n"), "alt"))).alias("e"))
    haps = slices.withColumn("hap", F.explode(F.array(*[F.lit(h) for h in range(1, 5)]))).join(inside, [*GROUP, "hap"], "left")
    return edit_haplotypes(haps)


def stitch(blocks: DataFrame, gene_refs: DataFrame) -> DataFrame:
    """Full haplotypes from block sequences, gaps filled with the gene reference.

    ``blocks``: ``(sample, gene, hap, lo, hi, seq)`` in global haplotype numbers;
    ``gene_refs``: ``(gene, start, end, ref)``.
    """
    w = Window.partitionBy(*GROUP, "hap").orderBy("lo")
    b = blocks.join(gene_refs, "gene").withColumn("prev", F.coalesce(F.lag("hi").over(w), F.col("start")))
    fill = F.substr(F.col("ref"), F.col("prev") - F.col("start") + 1, F.greatest(F.col("lo") - F.col("prev"), F.lit(0)))
    b = b.withColumn("part", F.struct("lo", F.concat(fill, F.col("seq")).alias("t"), "hi"))
    g = b.groupBy(*GROUP, "hap", "start", "end", "ref").agg(F.array_sort(F.collect_list("part")).alias("p"))
    tail = F.substr(F.col("ref"), F.element_at("p", -1)["hi"] - F.col("start") + 1)
    return g.select(*GROUP, "hap", F.concat(F.array_join(F.transform("p", lambda x: x.t), ""), tail).alias("seq"))
