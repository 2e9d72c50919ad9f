"""Smaller rerank, DRB345 and call operators on hand-made loci."""

import pytest
from pyspark.sql import functions as F

from quadhap.operators import calls, drb345, em, gates, kmers, quartet, rerank, sites

Q = "sample string, gene string, quartet array<string>"
FAM = "sample string, gene string, family string, weight double"


@pytest.fixture(scope="module")
def locus(spark):
    return dict(
        current=spark.createDataFrame([("s", "g", ["A*01:01", "A*02:01", "A*03:01", "A*03:01"])], Q),
        families=spark.createDataFrame([("s", "g", f"A*{n:02d}:01", w) for n, w in ((1, 100.0), (2, 100.0), (3, 500.0), (4, 290.0), (5, 10.0))], FAM),
        chi=spark.createDataFrame([("s", 0.2)], "sample string, chi_r double"),
        groups=spark.createDataFrame([("A*01:01:01", "A*01:01:01G"), ("A*02:01:01", "A*01:01:01G")], "member string, grp string"),
    )


def test_candidates_and_groups(spark, locus):
    exon = spark.createDataFrame([("s", "g", "A*09:01:7;A*01:01:9;A*08:01:1;A*09:01:2")], "sample string, gene string, support_text string")
    extra = rerank.exon_candidates(exon, 2, 3)
    assert [(r.family, r.support, r["rank"]) for r in extra.orderBy("ord").collect()] == [("A*01:01", 9, 2), ("A*09:01", 7, 1)]
    pool = rerank.candidates(locus["current"], None, locus["families"], 2, extra)
    assert [r.family for r in pool.orderBy("ord").collect()] == ["A*01:01", "A*02:01", "A*03:01", "A*04:01", "A*09:01"]
    kept = rerank.collapse_by_ggroup(pool, locus["groups"])
    assert [(r.ord, r.family) for r in kept.orderBy("ord").collect()] == [(0, "A*01:01"), (1, "A*03:01"), (2, "A*04:01"), (3, "A*09:01")]


def test_dose_and_kmer_rerank(spark, locus):
    pool = rerank.dose_pool(locus["current"], locus["families"])
    d = rerank.dose_rerank(locus["current"], locus["families"], locus["chi"], pool).first()
    assert d.changed and sorted(d.best[2:]) == ["A*03:01", "A*04:01"] and d.best_residual < d.current_residual
    support = locus["families"].withColumns({"reads": F.col("weight").cast("long"), "unique_kmers": F.lit(200)})
    k = rerank.kmer_dose_rerank(locus["current"], support, locus["chi"]).first()
    assert k.best == d.best
    assert not rerank.dose_rerank(locus["current"], locus["families"], locus["chi"], pool, min_gain=5.0).first().changed


def test_ensemble(spark, locus):
    pool = rerank.candidates(locus["current"], None, locus["families"], 5)
    space = rerank.search_space("full", locus["current"], pool, keep_current=True)
    rows = rerank.channel_table(space, locus["families"], locus["chi"]).join(locus["current"].select("sample", "gene", F.col("quartet").alias("current")), ["sample", "gene"])
    rows = rows.withColumn("af", F.col("em"))
    exon = spark.createDataFrame([("s", "g", "A*04:01", 5, 1)], "sample string, gene string, family string, support int, rank int")
    got = {r.strategy: r for r in rerank.ensemble_strategies(rows, exon).collect()}
    assert got["exon_inject_em"].overridden and "A*04:01" in got["exon_inject_em"].chosen
    assert got["ensemble_gate"].overridden and not got["disc_panel"].overridden
    weak = exon.withColumn("support", F.lit(1))
    assert not any(r.overridden for r in rerank.ensemble_strategies(rows, weak).collect())


def test_site_genotypes_and_phase_variants(spark, locus):
    s = spark.createDataFrame([("g", 1030, "A", "T"), ("g", 1031, "C", "G"), ("g", 5, "A", "T")], "gene string, pos0 int, ref string, alt string")
    spans = spark.createDataFrame([("g", "x", 1020, 0, 20), ("g", "y", 1000, 0, 100)], "gene string, family string, ref_start int, allele_start int, len int")
    fams = spark.createDataFrame([("g", "x", "C" * 10 + "T" + "C" * 9), ("g", "y", "A" * 100)], "gene string, family string, seq string")
    got = {(r.pos0, r.family): r.g for r in rerank.site_genotypes(s, spans, fams).collect()}
    assert got == {(1030, "x"): 1, (1030, "y"): 0, (1031, "x"): 0, (1031, "y"): None}

    cur = locus["current"]
    pool = rerank.candidates(cur, None, locus["families"], 4)
    geno = spark.createDataFrame([("g", i, f"A*{n:02d}:01", (n * (i + 1) + i) % 2) for i in range(8) for n in (1, 2, 3, 4)], "gene string, site int, family string, g int")
    pairs = spark.createDataFrame([("s", "g", i, j, 5, 2, 3, 9) for i in range(8) for j in range(i + 1, 8)], "sample string, gene string, i int, j int, n00 int, n01 int, n10 int, n11 int")
    st = spark.createDataFrame([("s", "g", i, 0.1 * (i + 1), 100) for i in range(8)], "sample string, gene string, site int, af double, dp int")
    m = rerank.site_matrix(st, geno, pool)
    space = rerank.search_space("swap", cur, pool, keep_current=True)
    pm = rerank.phase_matrix(pairs, m)
    a = {tuple(r.quartet): r.value for r in rerank.phase_nll(space, pm, locus["chi"]).collect()}
    b = {tuple(r.quartet): r.value for r in rerank.phase_nll(space, pm, locus["chi"], all_known=pool).collect()}
    assert a and a == pytest.approx(b)
    binom = rerank.site_scores(space, m, locus["chi"], "binom_nll", min_sites=5)
    both = rerank.phase_plus_binom(space, m, rerank.phase_nll(space, pm, locus["chi"]), binom)
    per_site = {tuple(r.quartet): r.value / r.n for r in binom.collect()}
    assert {tuple(r.quartet): r.value for r in both.collect()} == pytest.approx({q: v + per_site[q] for q, v in a.items()})
    ranked = rerank.rank_with_gap(binom).first()
    assert ranked.gap >= 0 and ranked.value == min(r.value for r in binom.collect())
    grid = rerank.chi_window(locus["chi"], 0.1, 0.05).first().grid
    assert grid == pytest.approx([0.1, 0.15, 0.2, 0.25, 0.3])


def test_em_outputs(spark, locus):
    fit = quartet.fit_quartet_l1(locus["families"], locus["chi"])
    fam = em.rollup_families(locus["families"].withColumnRenamed("family", "contig"), locus["families"].select("gene", F.col("family").alias("contig"), "family"))
    c = em.calls_from_quartet(fit, fam).orderBy("global_hap").collect()
    assert [r.assignment for r in c] == ["R", "R", "D", "D"] and [r.hap_fraction for r in c] == pytest.approx([0.1, 0.1, 0.4, 0.4])
    assert all(r.allele_read_count > 0 for r in c)
    reads = spark.createDataFrame([("s", "g", 77)], "sample string, gene string, n_reads int")
    s = em.em_summary(fam, fit, reads).first()
    assert s.top_frac == pytest.approx(0.5) and s.n_reads == 77 and s.sum_abs_diff == pytest.approx(fit.first().score)


def test_drb345_end_to_end(spark):
    fam = spark.createDataFrame([("s", "DRB3*01:01", 60.0), ("s", "DRB4*01:01", 40.0), ("t", "DRB3*01:01", 10.0)], "sample string, family string, weight double")
    final = spark.createDataFrame(
        [("s", "HLA-DRB1", "DRB1*03:01", "DRB1*03:01", "DRB1*04:01", "DRB1*01:01", "", 0.1), ("t", "HLA-DRB1", "DRB1*15:01", None, "NA", "NA", "high_mask_report_2field", 0.2), ("u", "HLA-DRB1", "NA", "NA", "NA", "NA", "", 0.9)],
        "sample string, gene string, R1_full string, R2_full string, D1_full string, D2_full string, warning string, mean_mask_fraction double")
    chi = spark.createDataFrame([(x, 0.4) for x in "stu"], "sample string, chi_r double")
    loci = spark.createDataFrame([("t", "DRB3")], "sample string, locus string")
    got = {r["sample"]: r for r in drb345.fit_drb345(fam, final, loci, chi).collect()}
    assert got["s"].quartet == ["DRB3*01:01", "DRB3*01:01", "DRB4*01:01", "NA"] and got["s"]["mode"] == "linked"
    assert got["t"].quartet == ["DRB3*01:01"] * 4 and got["t"]["mode"] == "evidence"
    assert got["u"].quartet == ["NA"] * 4
    long = drb345.drb345_calls(drb345.fit_drb345(fam, final, loci, chi), fam, chi)
    groups = spark.createDataFrame([("DRB3*01:01:01", "DRB3*01:01:01G")], "member string, grp string")
    row = drb345.drb345_final_rows(long, groups).where("sample = 's'").first()
    assert (row.R1_full, row.R1_g_group, row.D2_full, row.gene) == ("DRB3*01:01", "DRB3*01:01:01G", "NA", "HLA-DRB345")
    support = spark.createDataFrame([("s", "DRB3", 0.06), ("s", "DRB4", 0.03)], "sample string, locus string, fraction double")
    assert {r.locus for r in drb345.confident_loci(support, chi).collect()} == {"DRB3"}


def test_site_helpers(spark):
    df = spark.createDataFrame([("s", "g", 5, [0, 1], [0.2, 0.8], ["PASS"], True), ("s", "g", 5, [1, 1], [0.4, 0.6], ["q10"], True), ("s", "g", 7, [0, 1], None, ["PASS"], False)],
                               "sample string, gene string, ps int, gt array<int>, hf array<double>, filters array<string>, phased boolean")
    assert sites.clone_frequencies(df, 2).first().freq == pytest.approx([0.3, 0.7])
    assert sites.usable_phased(df).count() == 1
    reg = spark.createDataFrame([("c", 10, 20, "g")], "chrom string, start int, end int, gene string")
    pos = spark.createDataFrame([("c", 10), ("c", 11), ("c", 20), ("c", 21)], "chrom string, pos int")
    assert sorted(r.pos for r in sites.in_regions(pos, reg).collect()) == [11, 20]


def test_reference_choice_and_direct_gate(spark):
    rec = spark.createDataFrame([("g", "f1", "a1", "AC", 2), ("g", "f1", "a2", "ACG", 3), ("g", "f2", "b", "ACGT", 4)], "gene string, family string, allele string, seq string, len int")
    sup = spark.createDataFrame([("s", "g", "f1", 9), ("s", "g", "f2", 3)], "sample string, gene string, family string, reads int")
    r = kmers.choose_reference(rec, sup, ["sample", "gene"], ["gene"]).first()
    assert (r.allele, r.mode, r.support) == ("a2", "top-read-support:f1", 9)
    assert kmers.choose_reference(rec, None, ["gene"], ["gene"]).first().allele == "b"
    d = spark.createDataFrame([("s", "g", ["a"] * 4, ["b"] * 4, 200.0), ("s", "h", ["a"] * 4, ["a"] * 4, 200.0), ("s", "i", ["a"] * 4, ["b"] * 4, 10.0)],
                              "sample string, gene string, quartet array<string>, current array<string>, gap double")
    assert [x.gene for x in gates.direct_overrides(d).collect()] == ["g"]
    assert calls.FINAL_COLUMNS.__len__() == 42


def test_equal_scores_take_the_first_chi(spark):
    # af one side above and one below every expectation: the sum is the same for each chi but for rounding
    w = 1e9 / 7
    m = spark.createDataFrame([("s", "g", i, af, w, {"a": 1, "b": 1, "c": 0, "d": 0}) for i, af in enumerate((56 / 101, 8 / 101))], "sample string, gene string, site int, af double, w double, g map<string,int>")
    q = spark.createDataFrame([("s", "g", ["a", "b", "c", "d"])], Q)
    grid = spark.createDataFrame([("s", "g", [0.1, 0.1 + 0.05])], "sample string, gene string, grid array<double>")
    chi = spark.createDataFrame([("s", 0.1)], "sample string, chi_r double")
    r = rerank.site_scores(q, m, chi, "count_l1", chi_grid=grid, min_sites=2).first()
    assert (r.chi, r.n) == (0.1, 2) and r.value == pytest.approx(48 / 101 * w)
