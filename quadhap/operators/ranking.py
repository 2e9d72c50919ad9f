"""Ordered numbering and running sums that do not put a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Catalyst limits each map task to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums along ``order`` inside each key.

    ``bucket`` must be monotone in ``order``. Rows are windowed per (key, bucket)
    only; what came before a bucket is one small row per bucket, so a key that
    holds a large share of the table is spread over its buckets.
    """
    b = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": c for n, c in sums.items()})
    per_bucket = b.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    prior = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inner) for n in sums}).join(offsets, [*keys, "_bucket"])
    return out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in sums}).select(
        *df.columns, *[n for n in sums if n not in df.columns]
    )


def occurrence_number(df: DataFrame, keys: list[str], ordinal: str, width: int = 1 << 20, out: str = "occurrence") -> DataFrame:
    """1, 2, 3 … for repeated keys in ordinal order (``ordinal`` is a unique integer position)."""
    bucket = F.floor(F.col(ordinal) / F.lit(width))
    return running_sums(df, keys, bucket, [F.col(ordinal)], {out: F.lit(1)})


BIN = 1 << 14  # bases


def overlapping(spans: DataFrame, regions: DataFrame, start: str, end: str) -> DataFrame:
    """Spans ``[start, end)`` joined with the regions ``(chrom, start, end, gene)`` of their chromosome that they meet.

    Both sides are cut into bins of the chromosome, so that one chromosome is many keys;
    a pair is kept in the first bin the two have in common. Region columns come as
    ``chrom, gene, r_start, r_end``.
    """
    def bins(first, behind):
        return F.sequence(F.floor(first / BIN), F.floor((behind - 1) / BIN))

    r = regions.where("start < end").select("chrom", "gene", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    r = r.withColumn("_bin", F.explode(bins(F.col("r_start"), F.col("r_end"))))
    s = spans.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(bins(F.col(start), F.col(end))))
    met = (F.col(start) < F.col("r_end")) & (F.col(end) > F.col("r_start"))
    return s.join(r, ["chrom", "_bin"]).where(met & (F.col("_bin") == F.floor(F.greatest(start, "r_start") / BIN))).drop("_bin")
