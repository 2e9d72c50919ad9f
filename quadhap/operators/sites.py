"""Variant-site operators: mixture fraction, genotype reassignment, phase blocks.

``sites`` columns used: ``sample, chrom, pos`` (1-based), ``ref, alt, gt array<int>,
phased, ps, ad array<int>, ro, ao``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.functions import dose
from quadhap.operators.ranking import overlapping, running_sums

R_SPLITS = list(combinations(range(4), 2))  # which two of four haplotypes are the recipient's
BINS = 50


def biallelic(alt: str = "alt") -> Column:
    return ~F.contains(F.col(alt), F.lit(","))


def called_tetraploid(gt: str = "gt") -> Column:
    return F.coalesce((F.size(gt) == 4) & F.forall(gt, lambda a: a.isNotNull()), F.lit(False))


def alt_fraction(ad: str = "ad", min_depth: int = 1) -> Column:
    """ALT share of the first two allele depths over all depths; NULL when depths are unusable."""
    depth = F.aggregate(ad, F.lit(0), lambda acc, x: acc + x)
    usable = (F.size(ad) >= 2) & F.forall(ad, lambda x: x.isNotNull()) & (depth >= min_depth)
    return F.when(usable, F.get(ad, F.lit(1)) / depth)


def tetraploid_observations(sites: DataFrame, min_depth: int = 10) -> DataFrame:
    """Sites with four called 0/1 alleles and usable depths, with their ALT fraction ``af``."""
    ok = called_tetraploid() & biallelic() & F.forall("gt", lambda a: a.isin(0, 1))
    return sites.where(ok).withColumn("af", alt_fraction("ad", min_depth)).where("af is not null")


def pooled_af(sites: DataFrame, min_depth: int = 30, lo: float = 0.005, hi: float = 0.995, open_interval: bool = False) -> DataFrame:
    """Biallelic sites with depth and AF inside the window (closed for χ estimation, open for AF scoring)."""
    dp = F.col("ro") + F.col("ao")
    af = F.col("ao") / dp
    inside = (af > lo) & (af < hi) if open_interval else af.between(lo, hi)
    return sites.where(biallelic() & (dp >= min_depth) & inside).withColumns({"dp": dp, "af": af})


def af_bin(x: Column) -> Column:
    """1 % bin of a folded AF compared with the edges ``i*0.01`` themselves; 0.5 falls into the last bin."""
    edge = lambda i: i * F.lit(0.01)
    b = F.floor(x / 0.01)
    b = F.when(x < edge(b), b - 1).when(x >= edge(b + 1), b + 1).otherwise(b)
    return F.least(b, F.lit(BINS - 1)).cast("int")


def chi_from_pooled_af(afs: DataFrame, keys: tuple[str, ...] = ("sample",), per_chrom: bool = False) -> DataFrame:
    """Mixture fraction from the smallest peak of the folded AF histogram.

    Counts per 1 % bin are summed map-side, so a group is 50 numbers when it meets.
    Neighbouring bins are compared as 3-bin sums (the moving average times three).
    With ``per_chrom`` a row per chromosome joins the global one (``chrom`` NULL).
    """
    x = afs.withColumn("bin", af_bin(dose.folded_af(F.col("af"))))
    if per_chrom:
        k = list(keys)
        counts = x.groupingSets([[*k, "bin"], [*k, "chrom", "bin"]], *k, "chrom", "bin").agg(
            F.count("*").alias("n"), F.grouping("chrom").alias("g")
        )
        group = [*k, "chrom", "g"]
    else:
        group = list(keys)
        counts = x.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    hist = counts.groupBy(*group).agg(F.sum("n").alias("n_af"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    at = lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0))
    idx = F.sequence(F.lit(0), F.lit(BINS - 1))
    hist = hist.withColumn("s", F.transform(idx, lambda i: at(i - 1) + at(i) + at(i + 1)))
    s = lambda i: F.get("s", i)
    peak_at = F.filter(
        F.sequence(F.lit(2), F.lit(BINS - 2)),
        lambda i: (s(i) >= s(i - 1)) & (s(i) >= s(i + 1)) & (s(i) >= F.array_max("s") * 0.15),
    )
    hist = hist.withColumn("peaks", F.transform(peak_at, lambda i: (i * 0.01 + (i + 1) * 0.01) / 2))
    keep = [*keys, "chrom"] if per_chrom else list(keys)
    return hist.select(*keep, "n_af", F.get("peaks", F.lit(0)).alias("peak"), (F.get("peaks", F.lit(0)) * 2).alias("chi_r"), "peaks")


def chi_from_gt(obs: DataFrame, keys: tuple[str, ...] = ("sample",), recipient_major: bool = False, min_points: int = 8,
                bucket_width: float = 0.001) -> DataFrame:
    """Mixture fraction from single- and triple-dose sites: best two-cluster split of their AFs.

    ``obs``: ``keys, gt, af``. The within-cluster error of every split comes from
    running sums, which are built per AF bucket so that a deep sample is not one window.
    """
    d = F.aggregate("gt", F.lit(0), lambda acc, x: acc + x)
    x = F.when(d == 1, F.col("af")).when(d == 3, 1.0 - F.col("af"))
    k = list(keys)
    pts = obs.select(*k, x.alias("x")).where("x > 0.02 and x < 0.48")
    run = running_sums(pts, k, F.floor(F.col("x") / bucket_width), [F.col("x")], {"i": F.lit(1), "s1": F.col("x"), "s2": F.col("x") * F.col("x")})
    total = pts.groupBy(*k).agg(F.count("*").alias("n"), F.sum("x").alias("t1"), F.sum(F.col("x") * F.col("x")).alias("t2"))
    both = run.join(total, k).where("i < n")
    rest = F.col("n") - F.col("i")
    sse = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("i")) + (
        (F.col("t2") - F.col("s2")) - (F.col("t1") - F.col("s1")) * (F.col("t1") - F.col("s1")) / rest
    )
    best = both.withColumn("sse", F.round(sse, 12)).groupBy(*k).agg(
        F.min_by(F.struct((F.col("s1") / F.col("i")).alias("low"), ((F.col("t1") - F.col("s1")) / rest).alias("high"), F.col("i").alias("split")),
                 F.struct("sse", "i")).alias("b")
    )
    major = F.least(F.lit(0.99), F.greatest(F.lit(0.51), F.greatest(F.col("b.high") * 2, 1 - F.col("b.low") * 2)))
    major = F.when(F.col("n") >= min_points, major)
    out = total.select(*k, "n").join(best, k, "left").select(*k, F.col("n").alias("n_points"), "b.low", "b.high", "b.split", major.alias("major"))
    return out.withColumn("chi_r", F.col("major") if recipient_major else 1.0 - F.col("major"))


def best_dose(af: Column, chi: Column) -> Column:
    """``struct(delta, neg, n_r, n_d)`` of the dose closest to ``af``; ties prefer more ALT copies,
    then fewer recipient copies."""
    options = []
    for n_r in range(3):
        for n_d in range(3):
            expected = F.lit(0.5 * n_r) * chi + F.lit(0.5 * n_d) * (1.0 - chi)
            options.append(F.struct(F.abs(af - expected).alias("delta"), F.lit(-(n_r + n_d)).alias("neg"), F.lit(n_r).alias("n_r"), F.lit(n_d).alias("n_d")))
    return F.array_min(F.array(*options))


def reassign_genotypes(sites: DataFrame, chi: DataFrame, min_depth: int = 10, drop_af: float = 0.05) -> DataFrame:
    """Genotypes refitted to the mixture: ``n_r, n_d, new_gt, exp_af, disposition``.

    Multi-allelic sites and sites without depths pass through unchanged; shallow
    sites, sites below ``drop_af`` and all-reference fits are marked as dropped.
    ``chi``: ``(sample, chi_r)``.
    """
    s = sites.join(chi.select("sample", "chi_r"), "sample")
    depth = F.aggregate("ad", F.lit(0), lambda acc, x: acc + x)
    bad_ad = F.coalesce((F.size("ad") < 2) | F.exists("ad", lambda x: x.isNull()), F.lit(True)) | F.col("ad").isNull()
    s = s.withColumn("obs_af", F.when(~bad_ad & (depth > 0), F.get("ad", F.lit(1)) / depth).otherwise(0.0))
    s = s.withColumn("_d", best_dose(F.col("obs_af"), F.col("chi_r")))
    disposition = (
        F.when(~biallelic() | bad_ad, "passed_through")
        .when(depth < min_depth, "dropped_low_depth")
        .when(F.col("obs_af") < drop_af, "dropped_low_af")
        .when(F.col("_d.neg") == 0, "dropped_no_alt")
        .otherwise("refitted")
    )
    s = s.withColumn("disposition", disposition)
    fitted = F.col("disposition") == "refitted"
    n_r, n_d = F.col("_d.n_r"), F.col("_d.n_d")
    return s.withColumns({
        "n_r": F.when(fitted, n_r),
        "n_d": F.when(fitted, n_d),
        "new_gt": F.when(fitted, dose.dose_genotype(n_r, n_d)),
        "exp_af": F.when(fitted, n_r * 0.5 * F.col("chi_r") + n_d * 0.5 * (1.0 - F.col("chi_r"))),
    }).drop("_d")


def in_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Sites inside ``[start, end)`` of a region of their chromosome (zero-based), with the region's gene."""
    at = sites.withColumns({"_p0": F.col("pos") - 1, "_p1": F.col("pos")})
    return overlapping(at, regions, "_p0", "_p1").drop("_p0", "_p1").withColumnsRenamed({"r_start": "start", "r_end": "end"})


def phase_blocks(sites: DataFrame) -> DataFrame:
    """``(sample, gene, ps, lo, hi, obs)`` of phased tetraploid sites already cut to regions.

    ``obs`` lists ``(pos0, gt, af)`` of the biallelic 0/1 sites; a site without PS is its own block.
    """
    p = sites.where(called_tetraploid() & F.col("phased")).withColumn("ps", F.coalesce("ps", "pos"))
    p0, reflen = F.col("pos") - 1, F.length("ref")
    usable = biallelic() & F.forall("gt", lambda a: a.isin(0, 1)) & alt_fraction().isNotNull()
    ob = F.when(usable, F.struct(p0.alias("pos0"), "gt", alt_fraction().alias("af")))
    return p.groupBy("sample", "gene", "ps").agg(
        F.greatest(F.first("start"), F.min(p0)).alias("lo"),
        F.least(F.first("end"), F.max_by(p0 + reflen, F.struct(p0, reflen))).alias("hi"),
        F.array_sort(F.collect_list(ob)).alias("obs"),
    )


def filter_blocks(blocks: DataFrame, min_bp: int = 0, min_variants: int = 0) -> DataFrame:
    return blocks.where((F.col("hi") - F.col("lo") >= min_bp) & (F.size("obs") >= min_variants))


def haplotag_coverage(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Reads per HP tag 1..4 overlapping a block of their own phase set: ``(sample, gene, ps, c1..c4)``.

    ``reads``: ``(sample, ps, hp, pos0, end0, flag)``. The phase set makes it an equi-join.
    """
    from quadhap.functions.alignment import DUPLICATE, SECONDARY, SUPPLEMENTARY, has_flag

    usable = reads.where(~has_flag("flag", SECONDARY | SUPPLEMENTARY | DUPLICATE) & F.col("hp").between(1, 4))
    hits = usable.join(blocks.select("sample", "gene", "ps", "lo", "hi"), ["sample", "ps"]).where("pos0 < hi and end0 > lo")
    counted = hits.groupBy("sample", "gene", "ps").agg(*[F.count_if(F.col("hp") == i).alias(f"c{i}") for i in range(1, 5)])
    return blocks.select("sample", "gene", "ps").join(counted, ["sample", "gene", "ps"], "left").na.fill(0, ["c1", "c2", "c3", "c4"])


def _split_weights(split: tuple[int, int], chi: Column) -> list[Column]:
    return [(chi if h in split else 1.0 - chi) / 2 for h in range(4)]


def vaf_penalties(chi: Column) -> Column:
    """Array of six: Σ|AF − expected AF| when a pair of local haplotypes is the recipient's.

    The 24 assignments of local to global haplotypes differ only in that choice.
    """
    out = []
    for split in R_SPLITS:
        w = _split_weights(split, chi)
        out.append(F.aggregate(
            "obs", F.lit(0.0),
            lambda acc, o: acc + F.abs(o.af - sum((w[h] * F.get(o.gt, F.lit(h)) for h in range(1, 4)), w[0] * F.get(o.gt, F.lit(0)))),
        ))
    return F.array(*out)


def cov_penalties(counts: list[Column], chi: Column) -> Column:
    """Array of six: Σ|haplotype share − expected share|; zero without reads."""
    total = sum(counts[1:], counts[0])
    out = []
    for split in R_SPLITS:
        w = _split_weights(split, chi)
        out.append(F.when(total > 0, sum((F.abs(counts[h] / total - w[h]) for h in range(1, 4)), F.abs(counts[0] / total - w[0]))).otherwise(0.0))
    return F.array(*out)


def side_assignment(obs: DataFrame, keys: tuple[str, ...] = ("sample", "gene"), min_obs: int = 3) -> DataFrame:
    """Which two of four phased haplotypes are the recipient's: least Σ|AF − expected|.

    ``obs``: ``keys, gt, af, chi_r``. All six choices are summed in one aggregation;
    too few observations keep haplotypes 1 and 2.
    """
    chi = F.col("chi_r")
    sums = []
    for j, split in enumerate(R_SPLITS):
        w = _split_weights(split, chi)
        expected = sum((w[h] * F.get("gt", F.lit(h)) for h in range(1, 4)), w[0] * F.get("gt", F.lit(0)))
        sums.append(F.sum(F.abs(F.col("af") - expected)).alias(f"r{j}"))
    agg = obs.groupBy(*keys).agg(F.count("*").alias("n_obs"), *sums)
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"r{j}"), 12).alias("residual"), F.lit(j).alias("j")) for j in range(6)]))
    sides = F.array(*[F.lit("".join("R" if h in s else "D" for h in range(4))) for s in R_SPLITS])
    enough = F.col("n_obs") >= min_obs
    return agg.withColumn("b", best).select(
        *keys, "n_obs", F.when(enough, F.get(sides, F.col("b.j"))).otherwise("RRDD").alias("sides"),
        F.when(enough, F.col("b.residual")).alias("residual"),
    )


def best_phaseset(sites: DataFrame, keys: tuple[str, ...] = ("sample", "gene")) -> DataFrame:
    """Phase set with most polymorphic phased sites (larger id on ties)."""
    poly = (F.size("gt") >= 2) & (F.size(F.array_distinct("gt")) > 1)
    per = sites.where("ps is not null").groupBy(*keys, "ps").agg(F.count_if(poly).alias("polymorphic"), F.count("*").alias("sites"))
    return per.groupBy(*keys).agg(F.max_by(F.struct("ps", "polymorphic", "sites"), F.struct("polymorphic", "ps")).alias("b")).select(*keys, "b.*")


def clone_frequencies(sites: DataFrame, n_clones: int, keys: tuple[str, ...] = ("sample", "gene")) -> DataFrame:
    """Mean frequency per clone over sites that report exactly ``n_clones`` frequencies; uniform without any."""
    usable = (F.size("hf") == n_clones) & F.forall("hf", lambda x: x.isNotNull())
    means = [F.coalesce(F.avg(F.when(usable, F.get("hf", F.lit(i)))), F.lit(1.0 / n_clones)) for i in range(n_clones)]
    return sites.groupBy(*keys).agg(F.array(*means).alias("freq"), F.count_if(usable).alias("n_sites"))


def usable_phased(sites: DataFrame) -> DataFrame:
    """Drop sites filtered as ``q10``; keep phased or homozygous ones."""
    hom = F.size(F.array_distinct("gt")) == 1
    return sites.where(~F.array_contains("filters", "q10") & (F.col("phased") | hom))
