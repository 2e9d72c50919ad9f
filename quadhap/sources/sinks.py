"""Table, sequence and manifest sinks, resume and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.functions import dose


def write_tsv(df: DataFrame, path: str, columns: list[str], digits: dict[str, int] | None = None,
              partition_by: str | None = None) -> None:
    """Tab-separated text in a fixed column order; NULL is written as ``NA``."""
    digits = digits or {}
    cells = [
        (dose.render(F.col(c), digits[c]) if c in digits else F.coalesce(F.col(c).cast("string"), F.lit("NA"))).alias(c)
        for c in columns
    ]
    extra = [F.col(partition_by).alias(f"_{partition_by}")] if partition_by else []
    writer = df.select(*cells, *extra).write.option("sep", "\t").option("header", True).mode("overwrite")
    (writer.partitionBy(f"_{partition_by}") if partition_by else writer).csv(path)


def write_fastq(df: DataFrame, path: str, partition_by: list[str], seq: str = "seq", qual: str = "qual",
                header: str | Column = "header") -> None:
    """Gzip FASTQ text, one folder per partition key; a record stays in one row, hence in one file."""
    record = F.concat_ws("\n", header, F.col(seq), F.lit("+"), F.col(qual))
    df.select(*partition_by, record.alias("value")).write.partitionBy(*partition_by).option("compression", "gzip").mode(
        "overwrite"
    ).text(path)


def write_fasta(df: DataFrame, path: str, header: str | Column, seq: str = "seq", partition_by: list[str] | None = None,
                width: int = 80) -> None:
    wrapped = F.regexp_replace(F.col(seq), "(.{%d})(?!$)" % width, "$1\n")
    keys = partition_by or []
    rows = df.select(*keys, F.concat(F.lit(">"), header, F.lit("\n"), wrapped).alias("value"))
    (rows.write.partitionBy(*keys) if keys else rows.write).mode("overwrite").text(path)


def counters(df: DataFrame, reason: str = "status", keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    return df.groupBy(*keys, reason).agg(F.count("*").alias("n"))


def append_version(base: DataFrame, rescued: DataFrame, path: str, partition_by: list[str]) -> None:
    """Base reads plus rescued reads as a new version; the base stays untouched."""
    (
        base.withColumn("rescued", F.lit(False))
        .unionByName(rescued.withColumn("rescued", F.lit(True)), allowMissingColumns=True)
        .write.partitionBy(*partition_by).mode("errorifexists").parquet(path)
    )


def pending(work: DataFrame, done: DataFrame, keys: list[str], inputs: DataFrame | None = None) -> DataFrame:
    """Work not finished yet and, when ``inputs`` is given, whose inputs exist."""
    todo = work.join(done.select(*keys), keys, "left_anti")
    return todo if inputs is None else todo.join(inputs.select(*keys), keys, "left_semi")


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], source: str | None = None,
           warning: str | None = None) -> DataFrame:
    """Replace rows with the same key, add new ones; optionally tag source and append a warning."""
    if source is not None:
        rows = rows.withColumn("source", F.lit(source))
    if warning is not None:
        old = F.nullif(F.col("warning"), F.lit("")) if "warning" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("warning", F.concat_ws(";", old, F.lit(warning)))
    return existing.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
