"""Readers for variant, region, nomenclature, call and truth files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadhap.functions import names


def path_part(pattern: str, group: int = 1, path: Column | str = "file") -> Column:
    """Key taken from a file path, e.g. the sample directory of a cohort glob."""
    return F.regexp_extract(path, pattern, group)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant sites of single-sample VCF text; FORMAT and sample are zipped into a map.

    ``gt``/``ad`` are arrays with NULL for ``.``; ``filters`` is the split FILTER column.
    """
    return parse_vcf(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """:func:`read_vcf` of lines ``(file, value)``; header lines and lines without a sample are left out."""
    f = F.split("value", "\t")
    raw = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 10))
    keys, vals = F.split(F.get(f, F.lit(8)), ":"), F.split(F.get(f, F.lit(9)), ":")
    n = F.least(F.size(keys), F.size(vals))
    fmt = F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(vals, F.lit(1), n))
    base = raw.select(
        F.get(f, F.lit(0)).alias("chrom"),
        F.get(f, F.lit(1)).cast("int").alias("pos"),
        F.get(f, F.lit(3)).alias("ref"),
        F.get(f, F.lit(4)).alias("alt"),
        F.split(F.get(f, F.lit(6)), ";").alias("filters"),
        F.get(f, F.lit(7)).alias("info"),
        fmt.alias("fmt"),
        "file",
    )

    def ints(text: Column) -> Column:
        return F.transform(text, lambda x: x.try_cast("int"))

    gt = F.element_at("fmt", "GT")
    return (
        base.withColumn("gt_text", gt)
        .withColumn("gt", ints(F.split(gt, r"[/|]")))
        .withColumn("phased", F.contains(gt, F.lit("|")))
        .withColumn("ad", ints(F.split(F.element_at("fmt", "AD"), ",")))
        .withColumn("ro", F.coalesce(F.element_at("fmt", "RO"), F.lit("0")).try_cast("int"))
        .withColumn("ao", F.substring_index(F.element_at("fmt", "AO"), ",", 1).try_cast("int"))
        .withColumn("ps", F.element_at("fmt", "PS").try_cast("int"))
        .withColumn("hf", F.transform(F.split(F.element_at("fmt", "MAP_HF"), ","), lambda x: x.try_cast("double")))
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """BED regions; a repeated gene name gets the tag ``gene_2``, ``gene_3`` … in file order."""
    return parse_regions(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), *_position()))


def parse_regions(lines: DataFrame) -> DataFrame:
    """:func:`read_regions` of lines ``(file, block, nth, value)``."""
    f = F.split("value", r"\s+")
    rows = (
        lines
        .where((F.trim("value") != "") & ~F.col("value").startswith("#"))
        .select(
            F.get(f, F.lit(0)).alias("chrom"),
            F.get(f, F.lit(1)).try_cast("int").alias("start"),
            F.get(f, F.lit(2)).try_cast("int").alias("end"),
            F.get(f, F.lit(3)).alias("gene"),
            F.struct("file", "block", "nth").alias("ord"),
        )
    )
    nth = F.row_number().over(Window.partitionBy("gene").orderBy("ord"))
    return rows.withColumn("nth", nth).select(
        "chrom", "start", "end", "gene",
        F.when(F.col("nth") > 1, F.concat("gene", F.lit("_"), F.col("nth"))).otherwise(F.col("gene")).alias("tag"),
    )


def parse_ggroups(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(member, grp)`` from ``gene*;a/b/c;group`` lines; a line without group uses its member text,
    and every group maps to itself. Of repeated members the last line wins."""
    p = F.split(F.trim(col), ";")
    n = F.size(p)
    good = lines.where((F.trim(col) != "") & ~F.trim(col).startswith("#") & (n >= 3)).select(
        F.regexp_replace(F.get(p, F.lit(0)), r"\*+$", "").alias("gene"),
        F.get(p, n - 2).alias("members"),
        F.get(p, n - 1).alias("named"),
        F.monotonically_increasing_id().alias("ord"),
    )
    grp = F.when(F.col("named") != "", F.col("named")).otherwise(F.col("members"))
    rows = good.where(grp != "").select("gene", "members", F.concat("gene", F.lit("*"), grp).alias("grp"), "ord")
    members = F.filter(F.split("members", "/"), lambda m: m != "")
    member_rows = rows.select("gene", "grp", "ord", F.explode(members).alias("m")).select(
        F.concat("gene", F.lit("*"), "m").alias("member"), "grp", "ord"
    )
    own_rows = rows.select(F.col("grp").alias("member"), "grp", "ord")
    return member_rows.unionByName(own_rows).groupBy("member").agg(F.max_by("grp", "ord").alias("grp"))


def read_ggroups(spark: SparkSession, path: str) -> DataFrame:
    return parse_ggroups(spark.read.text(path))


def read_cohort_tsv(spark: SparkSession, path: str, sample_pattern: str, gene_pattern: str | None = None) -> DataFrame:
    """Tab-separated tables of a whole cohort glob; sample and gene come from the file path.

    ``NA`` and empty cells are NULL. Files may differ in their columns.
    """
    rows = parse_tsv(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), *_position()))
    names_ = [r["name"] for r in rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct().orderBy("name").collect()]
    parts = [path_part(sample_pattern, path="file").alias("sample")]
    if gene_pattern is not None:
        parts.append(path_part(gene_pattern, path="file").alias("gene"))
    taken = {"sample"} | ({"gene"} if gene_pattern is not None else set())
    return rows.select(*[F.col("cells")[n].alias(n) for n in names_ if n not in taken], *parts)


def _position() -> tuple[Column, Column]:
    """Where a line of a text scan stands in its file: the start of its split, then the order inside it."""
    return F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")


def parse_tsv(lines: DataFrame) -> DataFrame:
    """``(file, cells map<string,string>)`` of lines ``(file, block, nth, value)``: each file's first line names its cells.

    ``NA`` and empty cells are left out, as are cells without a name and empty lines.
    """
    at = F.struct("block", "nth")
    cells = lines.where(F.trim("value") != "").withColumn("f", F.split("value", "\t")).withColumn("at", at)
    head = cells.groupBy("file").agg(F.min("at").alias("first"), F.min_by("f", "at").alias("head"))
    body = cells.join(head, "file").where("at > first")
    pairs = F.filter(F.arrays_zip(F.col("head").alias("name"), F.col("f").alias("cell")), lambda e: e["name"].isNotNull() & (e["name"] != "") & e["cell"].isNotNull() & ~e["cell"].isin("", "NA"))
    return body.select("file", F.map_from_entries(pairs).alias("cells"))


def read_truth(spark: SparkSession, path: str, set_pattern: str = r"([^/]+)$") -> DataFrame:
    """``(set, side, gene, ord, allele)`` from wide matrices whose header repeats gene names.

    Cells are matched to the header row by position, so repeated names survive.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        path_part(set_pattern, path="_metadata.file_path").alias("set"),
        F.split("value", "\t").alias("f"),
        F.struct("_metadata.file_path", *_position()).alias("mid"),
    )
    first = rows.groupBy("set").agg(F.min("mid").alias("head"))
    rows = rows.join(first, "set")

    def cells(df: DataFrame, value: str) -> DataFrame:
        return df.select("set", F.get("f", F.lit(0)).alias("side"), F.posexplode("f").alias("ord", value))

    head = cells(rows.where("mid = head"), "gene").where("ord > 0").drop("side")
    body = cells(rows.where("mid <> head"), "cell").where("ord > 0")
    return body.join(head, ["set", "ord"]).select(
        "set", "side", names.truth_gene("gene").alias("gene"), "ord", names.truth_allele("gene", "cell").alias("allele")
    )


def read_chi(spark: SparkSession, pooled: str, fallback: str, sample_pattern: str,
             pooled_range: tuple[float, float] = (0.02, 0.49), fallback_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``(sample, chi_r)``: the GLOBAL value of the pooled log inside its closed range, else the last
    value of the fallback log inside its open range. Consumers differ in the ranges they accept."""

    def lines(path: str) -> DataFrame:
        file = F.col("_metadata.file_path")
        return spark.read.text(path).select(path_part(sample_pattern, path="_metadata.file_path").alias("sample"), file.alias("file"), *_position(), "value")

    return parse_chi(lines(pooled), lines(fallback), pooled_range, fallback_range)


def parse_chi(pooled: DataFrame, fallback: DataFrame, pooled_range: tuple[float, float] = (0.02, 0.49), fallback_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """:func:`read_chi` of lines ``(sample, file, block, nth, value)``; every sample of either log has a row."""

    def values(lines: DataFrame) -> DataFrame:
        return lines.select(
            "sample", F.col("value").startswith("GLOBAL").alias("is_global"), F.regexp_extract("value", r"chi_R=(\S+)", 1).try_cast("double").alias("v"),
            F.struct("file", "block", "nth").alias("ord"),
        )

    p = values(pooled)
    f = values(fallback)
    samples = p.select("sample").unionByName(f.select("sample")).distinct()
    p = p.where("is_global").where(F.col("v").between(*pooled_range)).groupBy("sample").agg(F.min_by("v", "ord").alias("vp"))
    f = f.where("v is not null").groupBy("sample").agg(F.max_by("v", "ord").alias("vf"))
    vf = F.when((F.col("vf") > fallback_range[0]) & (F.col("vf") < fallback_range[1]), F.col("vf"))
    return samples.join(p, "sample", "left").join(f, "sample", "left").select("sample", F.coalesce("vp", vf).alias("chi_r"))


def read_rescue_manifest(spark: SparkSession, path: str, sample_pattern: str) -> DataFrame:
    """Candidate families of rescue manifests: the ``# candidate_families`` line and rows with ``candidate=1``."""
    file = F.col("_metadata.file_path")
    return parse_rescue_manifest(spark.read.text(path).select(path_part(sample_pattern, path="_metadata.file_path").alias("sample"), file.alias("file"), *_position(), "value"))


def parse_rescue_manifest(lines: DataFrame) -> DataFrame:
    """:func:`read_rescue_manifest` of lines ``(sample, file, block, nth, value)``."""
    rows = lines.select("sample", "value", F.struct("file", "block", "nth").alias("mid")).where("value <> ''")
    listed = rows.where(F.col("value").rlike(r"^#\s*candidate_families\t")).select(
        "sample", F.explode(F.split(F.substring_index("value", "\t", -1), ",")).alias("family")
    )
    data = rows.where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    head = data.groupBy("sample").agg(F.min("mid").alias("mid"), F.min_by("f", "mid").alias("h"))
    body = data.join(head.select("sample", "h", F.col("mid").alias("head")), "sample").where("mid > head")
    at = lambda name: F.get("f", (F.array_position("h", name) - 1).cast("int"))
    flagged = body.where(at("candidate") == "1").select("sample", at("family").alias("family"))
    return listed.unionByName(flagged).withColumn("family", F.trim("family")).where("family <> ''").distinct()


def discover_samples(spark: SparkSession, glob: str, pattern: str, roots: list[str] | None = None) -> DataFrame:
    """``(sample, file, root_rank)`` of matching files; with ``roots`` the earliest root wins per sample."""
    files = (
        spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"))
        .withColumn("sample", path_part(pattern)).where("sample <> ''")
    )
    rank = F.lit(0)
    for i, root in reversed(list(enumerate(roots or []))):
        rank = F.when(F.instr("file", root) > 0, F.lit(i)).otherwise(rank)
    best = F.min_by("file", F.struct("root_rank", "file"))
    return files.withColumn("root_rank", rank).groupBy("sample").agg(best.alias("file"), F.min("root_rank").alias("root_rank"))


def prefer_sources(tagged: DataFrame, keys: list[str], rank: str = "source_rank") -> DataFrame:
    """Of rows gathered from several roots keep, per key, those of the best-ranked root."""
    best = tagged.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return tagged.join(best, keys).where(F.col(rank) == F.col("_best")).drop("_best")


def parse_gene_parameters(settings: DataFrame, text: str = "value") -> DataFrame:
    """The other columns of ``settings`` with ``(gene, setting)`` for each ``GENE=number`` that the text column lists between commas or semicolons.

    Empty items are skipped; anything else that is not of this form stops the query.
    """
    item = F.trim("item")
    items = settings.withColumn("item", F.explode(F.split(text, "[,;]"))).where(item != "")
    bad = F.raise_error(F.concat(F.lit("not GENE=number: "), "item"))
    number = F.when(F.contains("item", F.lit("=")), F.trim(F.substring_index("item", "=", -1)).try_cast("double"))
    return items.select(*[c for c in settings.columns if c != text], F.trim(F.substring_index("item", "=", 1)).alias("gene"), F.coalesce(number, bad.cast("double")).alias("setting"))


def gene_parameter(gene: Column | str, default: float, overrides: dict[str, float]) -> Column:
    g = F.col(gene) if isinstance(gene, str) else gene
    value = F.lit(float(default))
    for name, v in overrides.items():
        value = F.when(g == name, F.lit(float(v))).otherwise(value)
    return value
