"""Reader queries: lines are rendered from the tables inside the plan and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.functions import dose, names
from quadhap.plans.registry import Tables, micro, micro_sql, query
from quadhap.sources import sequences, tables


@query("cohort_tables", """SELECT p_size % 3 AS part, p_partkey AS allele, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_size % 3 = 1 THEN p_type END AS kind FROM part""")
def cohort_tables(t: Tables) -> DataFrame:
    """Three files whose headers differ in order and in one column."""
    p = t.part.withColumn("n", F.col("p_size") % 3)
    allele, brand = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "NA").otherwise(F.col("p_brand"))
    line = F.when(F.col("n") == 1, F.concat_ws("\t", brand, "p_type", allele)).otherwise(F.concat_ws("\t", allele, brand))
    body = p.select(F.concat(F.lit("f"), F.col("n").cast("string")).alias("file"), (F.col("p_partkey") % 7).alias("block"), (F.col("p_partkey") + 1).alias("nth"), line.alias("value"))
    names = F.when(F.col("file") == "f1", "brand\tkind\tallele").otherwise("allele\tbrand")
    head = body.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("nth"), names.alias("value"))
    cells = tables.parse_tsv(body.unionByName(head))
    return cells.select(
        F.substring("file", 2, 9).cast("int").alias("part"), F.col("cells")["allele"].cast("bigint").alias("allele"),
        F.col("cells")["brand"].alias("brand"), F.col("cells")["kind"].alias("kind"))


@query("gene_parameters", """SELECT n_regionkey AS region, n_name AS gene, n_nationkey / 4 AS setting FROM nation""")
def gene_parameters(t: Tables) -> DataFrame:
    """Settings of a region's nations, listed in one text with stray spaces and separators."""
    item = F.concat(F.lit(" "), "n_name", F.lit("= "), (F.col("n_nationkey") / 4).cast("string"))
    listed = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.array_join(F.sort_array(F.collect_list(item)), ";"), F.lit(",; ")).alias("value"))
    return tables.parse_gene_parameters(listed)


@query("name_codecs", """SELECT p_partkey, 'r' || p_partkey AS pair_name, substr(header, 2, length(header) - 3) AS dedup_name, '@r' || p_partkey AS slash_name, replace(replace(allele, '*', '_'), ':', '_') AS safe,
  'HLA-G' || (p_size % 4) AS gene_long, 'HLA_G' || (p_size % 4) AS contig, 'G' || (p_size % 4) || '*' AS prefix, CASE WHEN p_size % 5 > 0 THEN allele END AS allele_found
FROM (SELECT *, '@r' || p_partkey || '/' || (p_size % 2 + 1) || ' ' || p_type AS header, 'G*' || lpad(cast(p_size as varchar), 2, '0') || ':' || lpad(cast(p_partkey % 90 as varchar), 2, '0') || 'N' AS allele FROM part)""")
def name_codecs(t: Tables) -> DataFrame:
    """Read headers, allele headers and gene names in every spelling."""
    text = lambda c: c.cast("string")
    allele = F.concat(F.lit("G*"), F.lpad(text(F.col("p_size")), 2, "0"), F.lit(":"), F.lpad(text(F.col("p_partkey") % 90), 2, "0"), F.lit("N"))
    header = F.concat(F.lit("@r"), text(F.col("p_partkey")), F.lit("/"), text(F.col("p_size") % 2 + 1), F.lit(" "), F.col("p_type"))
    p = t.part.select("p_partkey", "p_size", allele.alias("a"), header.alias("h"), F.concat(F.lit("HLA-G"), text(F.col("p_size") % 4)).alias("g"))
    return p.select(
        "p_partkey", names.read_name("h").alias("pair_name"), names.read_name("h", "dedup").alias("dedup_name"), names.read_name("h", "slash").alias("slash_name"), names.safe_name("a").alias("safe"),
        names.long_gene(names.short_gene("g")).alias("gene_long"), names.contig_name("g").alias("contig"), names.allele_prefix("g").alias("prefix"),
        names.allele_from_header(F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("HLA:HLA1 "), "a", F.lit(" 12 bp"))).otherwise(F.lit("no allele here"))).alias("allele_found"))


@query("slot_fractions", f"""SELECT n_nationkey, unnest(['R', 'D']) AS side, {micro_sql("unnest([chi, 1 - chi]) / 2")} AS fraction_micro FROM (SELECT n_nationkey, n_nationkey / 50.0::double AS chi FROM nation)""")
def slot_fractions(t: Tables) -> DataFrame:
    sides = t.nation.select("n_nationkey", (F.col("n_nationkey") / 50.0).alias("chi"), F.explode(F.array(F.lit("R"), F.lit("D"))).alias("side"))
    return sides.select("n_nationkey", "side", micro(dose.slot_fraction(F.col("side"), F.col("chi"))).alias("fraction_micro"))


def text(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("parsed_sequences", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'P' || p_partkey ELSE 'A*' || p_size || ':' || p_partkey END AS allele, upper(replace(p_name, ' ', '')) AS seq, length(replace(p_name, ' ', '')) AS len FROM part""")
def parsed_sequences(t: Tables) -> DataFrame:
    """FASTA records with and without allele names, wrapped lines and gaps; some still carry their sign."""
    allele = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("A*"), text("p_size"), F.lit(":"), text("p_partkey"))).otherwise("plain")
    header = F.concat(F.when(F.col("p_partkey") % 5 == 0, ">").otherwise(""), F.lit("P"), text("p_partkey"), F.lit("  "), allele, F.lit(" > 12 bp"))
    body = F.concat(F.substring("p_name", 1, 7), F.lit("-\n--"), F.expr("substr(p_name, 8)"), F.when(F.col("p_size") % 3 == 0, "\n").otherwise(""))
    junk = t.part.where("p_size = 7").select(F.lit("no line break").alias("value"))
    parsed = sequences.parse_fasta(t.part.select(F.concat(header, F.lit("\n"), body).alias("value")).unionByName(junk))
    return parsed.select(F.regexp_extract("header", r"P(\d+)", 1).try_cast("bigint").alias("p_partkey"), "allele", "seq", "len")


@query("parsed_alignments", """SELECT 'r' || l_orderkey AS qname, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 65 ELSE 1153 END AS flag, 'c' || l_suppkey AS contig, l_partkey::INT AS pos, l_quantity::INT AS mapq, l_quantity::INT || 'M' AS cigar,
  CASE WHEN l_linestatus = 'O' THEN 'c' || l_suppkey ELSE 'c' || (l_partkey % 7) END AS mate_contig, 'ACGT' AS seq, CASE WHEN l_linenumber % 2 = 0 THEN -l_linenumber END AS score, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS nm,
  CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS mate FROM lineitem WHERE l_linenumber < 7""")
def parsed_alignments(t: Tables) -> DataFrame:
    """SAM lines with optional tags in any number, header lines, and lines cut short."""
    flag = F.when(F.col("l_linenumber") % 3 == 0, "0").when(F.col("l_linenumber") % 3 == 1, "65").otherwise("1153")
    contig = F.concat(F.lit("c"), text("l_suppkey"))
    mate = F.when(F.col("l_linestatus") == "O", "=").otherwise(F.concat(F.lit("c"), text(F.col("l_partkey") % 7)))
    quantity = text(F.col("l_quantity").cast("int"))
    tags = [F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("AS:i:"), text(-F.col("l_linenumber")))), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("NM:i:"), text("l_linenumber"))), F.lit("XT:A:U")]
    line = F.concat_ws("\t", F.concat(F.lit("r"), text("l_orderkey")), flag, contig, text("l_partkey"), quantity, F.concat(quantity, F.lit("M")), mate, F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("@@@@"), *tags)
    value = F.when(F.col("l_linenumber") < 7, line).when(F.col("l_linestatus") == "O", F.concat(F.lit("@SQ\tSN:"), line)).otherwise("r1\t0\tc1")
    return sequences.parse_sam(t.lineitem.select(F.lit("f").alias("file"), value.alias("value"))).drop("file")


@query("parsed_sites", f"""SELECT event_id::INT AS pos, 'chr' || (user_id % 5) AS chrom, 'A' AS ref, CASE WHEN event_id % 4 = 0 THEN 'C,G' ELSE 'C' END AS alt, CASE WHEN event_id % 3 = 0 THEN 'q10|low' ELSE 'PASS' END AS filters,
  CASE WHEN event_id % 6 = 0 THEN '.|1' WHEN event_id % 2 = 0 THEN '0|1|1|1' ELSE '0|0|1|1' END AS gt, event_id % 2 = 1 AS phased, (user_id % 50) || '|' || CASE WHEN event_id % 4 = 0 THEN '.|3' ELSE '9' END AS ad,
  CASE WHEN event_id % 7 = 0 THEN 0 ELSE (user_id % 50)::INT END AS ro, CASE WHEN event_id % 7 > 0 THEN (event_id % 11)::INT END AS ao, CASE WHEN event_id % 7 > 0 AND event_id % 5 > 0 THEN (event_id % 100)::INT END AS ps FROM events WHERE event_id % 13 > 0""")
def parsed_sites(t: Tables) -> DataFrame:
    """VCF lines with several alternatives, missing values, short sample columns, headers and lines without a sample."""
    e = F.col("event_id")
    gt = F.when(e % 6 == 0, "./1").when(e % 2 == 0, "0/1/1/1").otherwise("0|0|1|1")
    ad = F.concat(text(F.col("user_id") % 50), F.lit(","), F.when(e % 4 == 0, ".,3").otherwise("9"))
    more = F.concat_ws(":", text(F.col("user_id") % 50), F.concat(text(e % 11), F.lit(",8")), F.when(e % 5 == 0, ".").otherwise(text(e % 100)))
    sample = F.when(e % 7 == 0, F.concat_ws(":", gt, ad)).otherwise(F.concat_ws(":", gt, ad, more))
    fields = [F.concat(F.lit("chr"), text(F.col("user_id") % 5)), text("event_id"), F.lit("."), F.lit("A"), F.when(e % 4 == 0, "C,G").otherwise("C"), F.lit("."), F.when(e % 3 == 0, "q10;low").otherwise("PASS"), F.lit("DP=3")]
    value = F.when(e % 13 > 0, F.concat_ws("\t", *fields, F.lit("GT:AD:RO:AO:PS"), sample)).when(e % 2 == 0, F.concat(F.lit("#CHROM\t"), F.concat_ws("\t", *fields, F.lit("x"), F.lit("y")))).otherwise(F.concat_ws("\t", *fields))
    v = tables.parse_vcf(t.events.select(F.lit("f").alias("file"), value.alias("value")))
    listed = lambda c: F.array_join(c, "|", ".")
    return v.select("pos", "chrom", "ref", "alt", listed(F.col("filters")).alias("filters"), listed(F.col("gt").cast("array<string>")).alias("gt"), "phased", listed(F.col("ad").cast("array<string>")).alias("ad"), "ro", "ao", "ps")


@query("parsed_regions", """SELECT 'chr' || n_regionkey AS chrom, n_nationkey * 100 AS "start", n_nationkey * 100 + 50 AS "end", 'g' || n_regionkey AS gene, CASE WHEN n > 1 THEN 'g' || n_regionkey || '_' || n ELSE 'g' || n_regionkey END AS tag
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, n_nationkey % 3, n_nationkey) AS n FROM nation)""")
def parsed_regions(t: Tables) -> DataFrame:
    """BED lines of two files in several splits, with comments and empty lines; genes repeat."""
    n = F.col("n_nationkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), text("n_regionkey")), text(n * 100), text(n * 100 + 50), F.concat(F.lit("g"), text("n_regionkey")))
    at = lambda value: t.nation.select(F.concat(F.lit("f"), text(n % 2)).alias("file"), (n % 3).cast("bigint").alias("block"), n.cast("bigint").alias("nth"), value.alias("value"))
    return tables.parse_regions(at(line).unionByName(at(F.concat(F.lit("#"), line))).unionByName(at(F.lit("  "))))


@query("parsed_mixture", f"""SELECT n_name AS sample, {micro_sql("CASE WHEN p BETWEEN 0.02 AND 0.49 THEN p WHEN f > 0 AND f < 1 THEN f END")} AS chi_micro FROM (
  SELECT n_name, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey / 40.0::double END AS p, CASE WHEN n_nationkey % 3 > 0 THEN (n_nationkey - 2) / 20.0::double END AS f FROM nation)""")
def parsed_mixture(t: Tables) -> DataFrame:
    """Pooled and fallback logs: values out of range, repeated values, failures, and samples that only one log has."""
    n = F.col("n_nationkey")
    at = lambda nth, value: t.nation.select(F.col("n_name").alias("sample"), F.lit("f").alias("file"), F.lit(0).alias("block"), F.lit(nth).alias("nth"), value.alias("value"))
    pooled = at(1, F.when(n % 4 > 0, F.concat(F.lit("GLOBAL  chi_R="), text(n / 40.0), F.lit("  n=9"))).otherwise("GLOBAL  chi_R=NA"))
    pooled = pooled.unionByName(at(0, F.lit("A  chi_R=0.3"))).unionByName(at(2, F.lit("GLOBAL  chi_R=0.4")).where("value is null"))
    fallback = at(0, F.lit("major=1 chi_R=0.9")).join(t.nation.where("n_nationkey % 3 > 0").select(F.col("n_name").alias("sample")), "sample", "left_semi")
    fallback = fallback.unionByName(at(1, F.when(n % 3 > 0, F.concat(F.lit("major=2 chi_R="), text((n - 2) / 20.0))).otherwise("FAIL")))
    return tables.parse_chi(pooled, fallback).select("sample", micro("chi_r").alias("chi_micro"))


@query("parsed_manifest", """SELECT DISTINCT n_regionkey AS region, family FROM (SELECT n_regionkey, n_name AS family FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_regionkey, 'F' || (n_nationkey % 4) FROM nation WHERE n_nationkey % 2 = 0)""")
def parsed_manifest(t: Tables) -> DataFrame:
    """Rescue manifests: families listed in a comment, and flagged rows under headers of either order."""
    n, region = F.col("n_nationkey"), F.col("n_regionkey")
    at = lambda df, nth, value: df.select(text("n_regionkey").alias("sample"), F.lit("f").alias("file"), F.lit(0).alias("block"), nth.cast("bigint").alias("nth"), value.alias("value"))
    flip = region % 2 == 0
    head = at(t.nation.select("n_regionkey").distinct(), F.lit(0), F.when(flip, "family\tfull\tcandidate").otherwise("candidate\tfamily\tfull"))
    flag = F.when(n % 3 == 0, "1").otherwise("0")
    rows = at(t.nation, n + 5, F.when(flip, F.concat_ws("\t", "n_name", F.lit("7"), flag)).otherwise(F.concat_ws("\t", flag, "n_name", F.lit("7"))))
    listed = t.nation.where("n_nationkey % 2 = 0").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(F.lit("F"), text(n % 4))), ",").alias("l"))
    notes = at(listed, F.lit(-1), F.concat(F.lit("# candidate_families\t"), "l")).unionByName(at(listed, F.lit(-2), F.lit("# sample\tx")))
    return tables.parse_rescue_manifest(notes.unionByName(head).unionByName(rows)).select(F.col("sample").cast("int").alias("region"), "family")
