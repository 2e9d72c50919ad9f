"""Text formats: written by hand, read back, split into many tasks."""

import gzip

import pytest

from quadhap.sources import sequences, sinks, tables


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta(spark, tmp_path, small_splits):
    want = {}
    with open(tmp_path / "a.fa", "w") as fh:
        for i in range(60):
            seq = "ACGTacgtNN-"[i % 7:] * (i % 5 + 1)
            fh.write(f">HLA:HLA{i:05d} A*{i % 40 + 1:02d}:{i:02d}:01 {len(seq)} bp\n" + "\n".join(seq[j:j + 7] for j in range(0, len(seq), 7)) + "\n")
            want[f"A*{i % 40 + 1:02d}:{i:02d}:01"] = seq.upper().replace("-", "")
    df = sequences.read_fasta(spark, str(tmp_path / "a.fa"), "A*")
    assert df.rdd.getNumPartitions() > 1
    assert {r.allele: r.seq for r in df.collect()} == want


@pytest.mark.parametrize("zipped", [False, True])
def test_fastq_pairs(spark, tmp_path, small_splits, zipped):
    def write(mate, n):
        name = tmp_path / f"R{mate}.fq{'.gz' if zipped else ''}"
        with (gzip.open(name, "wt") if zipped else open(name, "w")) as fh:
            for i in range(n):
                fh.write(f"@r{i}{'x' if mate == 2 and i == 3 else ''}/{mate} c\nACGT{'A' * (i % 9)}\n+\n@III{'@' * (i % 9)}\n")
        return str(name)

    r1 = sequences.read_fastq(spark, write(1, 90)).selectExpr("'s' as sample", "*")
    r2 = sequences.read_fastq(spark, write(2, 90)).selectExpr("'s' as sample", "*")
    pairs = sequences.zip_mates(r1, r2)
    rows = sorted(pairs.collect(), key=lambda r: r.rec)
    assert [r.name for r in rows] == [f"r{i}" for i in range(90)]
    assert [r.seq1 for r in rows] == [r.seq2 for r in rows] == ["ACGT" + "A" * (i % 9) for i in range(90)]
    assert [r.rec for r in rows if r.name_mismatch] == [3]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t65\tA*1\t5\t60\t10M\t=\t50\t0\tACGT\tIIII\tNM:i:1\tAS:i:-3\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\nbad line\n")
    rows = {r.qname: r for r in sequences.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert set(rows) == {"q1", "q2"}
    assert (rows["q1"].score, rows["q1"].nm, rows["q1"].mate_contig, rows["q1"].mate) == (-3, 1, "A*1", 1)
    assert rows["q2"].score is None


def test_vcf(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    body = "c\t10\t.\tA\tT\t1\tPASS\t.\tGT:AD:RO:AO:PS\t0|1|0|1:8,4:8:4:10\nc\t11\t.\tA\tT,G\t1\tq10;x\t.\tGT:AO\t./././.:3,1\n"
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as fh:
        fh.write(head + body)
    a, b = tables.read_vcf(spark, str(tmp_path / "a.vcf.gz")).orderBy("pos").collect()
    assert (a.gt, a.phased, a.ad, a.ro, a.ao, a.ps) == ([0, 1, 0, 1], True, [8, 4], 8, 4, 10)
    assert (b.gt, b.ad, b.ro, b.ao, b.filters) == ([None] * 4, None, 0, 3, ["q10", "x"])


def test_small_tables(spark, tmp_path):
    (tmp_path / "r.bed").write_text("# c\nchr1\t0\t10\tA\nchr1 20 30 A\nchr2\t5\t9\tB\n")
    assert sorted(r.tag for r in tables.read_regions(spark, str(tmp_path / "r.bed")).collect()) == ["A", "A_2", "B"]
    (tmp_path / "g.txt").write_text("# c\nA*;01:01:01/01:01:02;01:01:01G\nB*;07:02;\nC*;x\n")
    got = {r.member: r.grp for r in tables.read_ggroups(spark, str(tmp_path / "g.txt")).collect()}
    assert got == {"A*01:01:01": "A*01:01:01G", "A*01:01:02": "A*01:01:01G", "A*01:01:01G": "A*01:01:01G", "B*07:02": "B*07:02"}
    (tmp_path / "t.tsv").write_text("x\tA\tA\tDRB345\nPATIENT\t01:01\t02:01\t03:01\nDONOR\t03:01\tNA\t-\n")
    truth = {(r.side, r.ord): (r.gene, r.allele) for r in tables.read_truth(spark, str(tmp_path / "t.tsv")).collect()}
    assert truth[("PATIENT", 2)] == ("HLA-A", "A*02:01") and truth[("PATIENT", 3)] == ("HLA-DRB345", "DRB3*01") and len(truth) == 6
    (tmp_path / "m.tsv").write_text("# pairs_scanned\t3\n# candidate_families\tDPB1*04:01, DPB1*02:01\nfamily\tcandidate\nDPB1*05:01\t1\nDPB1*06:01\t0\n")
    assert {r.family for r in tables.read_rescue_manifest(spark, str(tmp_path / "m.tsv"), r"(m)\.tsv").collect()} == {"DPB1*04:01", "DPB1*02:01", "DPB1*05:01"}
    settings = spark.createDataFrame([("p1", "HLA-A=0.1; HLA-B=0.2,"), ("p2", "")], "profile string, value string")
    assert sorted(map(tuple, tables.parse_gene_parameters(settings).collect())) == [("p1", "HLA-A", 0.1), ("p1", "HLA-B", 0.2)]
    for wrong in ("HLA-A", "HLA-A=x"):
        with pytest.raises(Exception, match="not GENE=number"):
            tables.parse_gene_parameters(spark.createDataFrame([(wrong,)], "value string")).collect()


def test_chi_logs(spark, tmp_path):
    for s, text in {"s1": "GLOBAL  chi_R=0.1300  n=5\n", "s2": "GLOBAL  chi_R=NA\n", "s3": "GLOBAL  chi_R=0.6\n"}.items():
        (tmp_path / f"{s}.pooled.txt").write_text(text)
        (tmp_path / f"{s}.chim.txt").write_text("FAIL n=2\n" if s == "s2" else "major=0.7 chi_R=0.2\nlater chi_R=0.3000\n")
    df = tables.read_chi(spark, str(tmp_path / "*.pooled.txt"), str(tmp_path / "*.chim.txt"), r"(s\d)\.")
    assert {r.sample: r.chi_r for r in df.collect()} == {"s1": 0.13, "s2": None, "s3": 0.3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "A", 0.5, None), ("s2", "B", None, "w")], "sample string, gene string, x double, y string")
    sinks.write_tsv(df, str(tmp_path / "t"), ["gene", "x", "y"], {"x": 3}, partition_by="sample")
    lines = sorted(line for p in (tmp_path / "t").rglob("*.csv") for line in p.read_text().splitlines() if not line.startswith("gene"))
    assert lines == ["A\t0.500\tNA", "B\tNA\tw"]
    reads = spark.createDataFrame([("A", "@r/1", "ACGT", "IIII")], "gene string, header string, seq string, qual string")
    sinks.write_fastq(reads, str(tmp_path / "fq"), ["gene"])
    assert sequences.read_fastq(spark, str(tmp_path / "fq/gene=A")).select("name", "seq").first() == ("r", "ACGT")
    sinks.append_version(reads, reads, str(tmp_path / "v2"), ["gene"])
    assert spark.read.parquet(str(tmp_path / "v2")).groupBy("rescued").count().count() == 2


def test_cohort_tables_with_different_columns(spark, tmp_path, small_splits):
    (tmp_path / "s1_A.tsv").write_text("allele\tweight\textra\nA*01\t1.5\tx\n\nA*02\tNA\t\n")
    (tmp_path / "s2_B.tsv").write_text("weight\tallele\n" + "".join(f"{i}\tB*{i:03d}\n" for i in range(200)))
    df = tables.read_cohort_tsv(spark, str(tmp_path / "*.tsv"), r"(s\d)_", r"_([A-Z])\.tsv")
    got = {(r.sample, r.gene, r.allele): (r.weight, r.extra) for r in df.collect()}
    assert got[("s1", "A", "A*01")] == ("1.5", "x") and got[("s1", "A", "A*02")] == (None, None)
    assert all(got[("s2", "B", f"B*{i:03d}")] == (str(i), None) for i in range(200)) and len(got) == 202


def test_fasta_headers_with_the_sign(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">HLA:1 A*01:01 len>5 bp\nACGT\nAC>GT\n>HLA:2 B*02:01\nTT\n")
    assert {(r.allele, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "b.fa")).collect()} == {("A*01:01", "ACGTAC>GT"), ("B*02:01", "TT")}


def test_surplus_mates_are_kept_with_a_status(spark):
    schema = "sample string, rec bigint, name string, seq string, qual string"
    r1 = spark.createDataFrame([("s", 0, "a", "A", "!"), ("s", 1, "b", "C", "!"), ("t", 0, "x", "G", "!")], schema)
    r2 = spark.createDataFrame([("s", 0, "a", "T", "!"), ("s", 1, "c", "T", "!"), ("s", 2, "d", "T", "!")], schema)
    got = {(r.sample, r.rec): (r.mate_status, r.name_mismatch, r.seq1, r.seq2) for r in sequences.zip_mates(r1, r2).collect()}
    assert got == {("s", 0): ("paired", False, "A", "T"), ("s", 1): ("name_mismatch", True, "C", "T"), ("s", 2): ("no_first", False, None, "T"), ("t", 0): ("no_second", False, "G", None)}


def test_regions_follow_file_order_not_split_packing(spark):
    rows = [("a", 0, 0, "c 1 2 G"), ("a", 7, 0, "c 3 4 G"), ("b", 0, 0, "c 5 6 G"), ("b", 0, 1, "# c 0 0 G"), ("b", 0, 2, " ")]
    df = spark.createDataFrame(rows, "file string, block bigint, nth bigint, value string").repartition(3)
    assert {(r.start, r.tag) for r in tables.parse_regions(df).collect()} == {(1, "G"), (3, "G_2"), (5, "G_3")}
