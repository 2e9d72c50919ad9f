"""FASTA, FASTQ and SAM text readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadhap.functions import alignment as aln
from quadhap.functions import names


def read_fasta(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """``(name, allele, seq, len)``; the allele is the first token holding ``*``, else the first token.

    A line that starts with ``>`` opens a record: the separator is the line break with it, so
    large files split across tasks and headers may hold the sign. Only a file's first record
    still carries its own.
    """
    out = parse_fasta(spark.read.option("lineSep", "\n>").text(path))
    return out if prefix is None else out.where(F.col("allele").startswith(prefix))


def parse_fasta(records: DataFrame) -> DataFrame:
    """``(header, allele, seq, len)`` of records ``(value)``, each from its header to the next record's sign."""
    raw = records.select(F.regexp_replace("value", "^>", "").alias("value"))
    header = F.substring_index("value", "\n", 1)
    body = F.substr(F.col("value"), F.instr("value", "\n") + 1)
    tokens = F.split(F.trim(F.regexp_replace(header, r"\s+", " ")), " ")
    starred = F.get(F.filter(tokens, lambda t: F.contains(t, F.lit("*"))), F.lit(0))
    out = raw.where(F.instr("value", "\n") > 0).select(
        header.alias("header"),
        F.coalesce(starred, F.get(tokens, F.lit(0))).alias("allele"),
        F.upper(F.regexp_replace(body, r"[-\s]", "")).alias("seq"),
    )
    return out.where(F.col("header") != "").withColumn("len", F.length("seq"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ln, value)`` with zero-based line numbers.

    Spark hands out ids in file order inside a split; per-split line counts turn
    them into file positions. Only one small row per split is ever ordered.
    """
    lines = (
        spark.read.text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumnsRenamed({"file_path": "file", "file_block_start": "block"})
        .withColumn("mid", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("file", "block").agg(F.min("mid").alias("first_mid"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(splits, ["file", "block"]).select(
        "file", (F.col("mid") - F.col("first_mid") + F.col("skip")).alias("ln"), "value"
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rec, header, name, seq, qual)``; plain or gzip, four lines per record.

    Records are found by line number, never by a leading ``@``, because a quality
    line may start with one. An incomplete last record is dropped.
    """
    lines = _numbered_lines(spark, path).withColumn("rec", F.floor(F.col("ln") / 4)).withColumn("part", F.col("ln") % 4)

    def line(i: int, alias: str):
        return F.max(F.when(F.col("part") == i, F.col("value"))).alias(alias)

    recs = lines.groupBy("file", "rec").agg(line(0, "header"), line(1, "seq"), line(3, "qual"), F.count("*").alias("n"))
    return recs.where(F.col("n") == 4).select(
        "file", "rec", "header", names.read_name("header").alias("name"), "seq", "qual"
    )


def zip_mates(r1: DataFrame, r2: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Pair mates by record position, keeping the first mate's name.

    Nothing is dropped: ``mate_status`` is ``paired``, ``name_mismatch``, or ``no_first`` and
    ``no_second`` for the surplus records of the longer file, and ``name_mismatch`` flags the second.
    """
    left = r1.select(*keys, "rec", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    right = r2.select(
        *keys, "rec", F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2")
    )
    both = left.withColumn("has1", F.lit(True)).join(right.withColumn("has2", F.lit(True)), [*keys, "rec"], "full")
    differ = F.col("has1") & F.col("has2") & (F.col("name") != F.col("name2"))
    status = F.when(F.col("has1").isNull(), "no_first").when(F.col("has2").isNull(), "no_second").when(differ, "name_mismatch").otherwise("paired")
    return both.withColumn("mate_status", status).withColumn("name_mismatch", F.col("mate_status") == "name_mismatch").drop("has1", "has2")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM text; ``=`` mate contigs are resolved, AS/NM become integers."""
    return parse_sam(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def parse_sam(lines: DataFrame) -> DataFrame:
    """:func:`read_sam` of lines ``(file, value)``; header lines and lines of under 11 fields are left out."""
    f = F.split("value", "\t")

    def tag(name: str):
        return F.regexp_extract("value", rf"\t{name}:i:(-?\d+)", 1).try_cast("int")

    raw = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    contig = F.get(f, F.lit(2))
    mate_contig = F.get(f, F.lit(6))
    return raw.select(
        F.get(f, F.lit(0)).alias("qname"),
        F.get(f, F.lit(1)).cast("int").alias("flag"),
        contig.alias("contig"),
        F.get(f, F.lit(3)).cast("int").alias("pos"),
        F.get(f, F.lit(4)).cast("int").alias("mapq"),
        F.get(f, F.lit(5)).alias("cigar"),
        F.when(mate_contig == "=", contig).otherwise(mate_contig).alias("mate_contig"),
        F.get(f, F.lit(9)).alias("seq"),
        tag("AS").alias("score"),
        tag("NM").alias("nm"),
        "file",
    ).withColumn("mate", aln.mate("flag"))
