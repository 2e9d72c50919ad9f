"""Strategy tallies and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strategy_tallies(rows: DataFrame) -> DataFrame:
    """Proposals, improvements, regressions, neutrals, holds, skips and net change.

    ``rows``: ``(strategy, set, gene, status, delta)`` with status ``propose``, ``hold``
    or ``skip``. One pass yields the totals and the breakdowns by set and by gene;
    ``scope`` tells them apart.
    """
    sets = [["strategy"], ["strategy", "set"], ["strategy", "gene"]]
    proposed = F.col("status") == "propose"
    delta = F.when(proposed, F.col("delta")).otherwise(0)
    out = rows.groupingSets(sets, "strategy", "set", "gene").agg(
        F.grouping("set").alias("gs"), F.grouping("gene").alias("gg"),
        F.count_if(proposed).alias("prop"), F.count_if(proposed & (F.col("delta") > 0)).alias("imp"),
        F.count_if(proposed & (F.col("delta") < 0)).alias("reg"), F.count_if(proposed & (F.col("delta") == 0)).alias("neu"),
        F.count_if(F.col("status") == "hold").alias("hold"), F.count_if(F.col("status") == "skip").alias("skip"), F.sum(delta).alias("net"),
    )
    scope = F.when(F.col("gs") == 0, "set").when(F.col("gg") == 0, "gene").otherwise("all")
    return out.withColumn("scope", scope).drop("gs", "gg")


def tau_sweep(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Effect of a minimum gap: per (strategy, τ) how many proposals survive and what they change.

    ``rows``: ``(strategy, gap, changed, delta, current_score)``. A proposal stands when it
    changes the call and its gap exceeds τ. Every row lists the thresholds, so τ adds no join.
    """
    r = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    stands = F.col("changed") & (F.col("gap") > F.col("tau"))
    d = F.when(stands, F.col("delta")).otherwise(0)
    return r.groupBy("strategy", "tau").agg(
        F.count_if(stands).alias("prop"), F.count_if(stands & (F.col("delta") > 0)).alias("imp"),
        F.count_if(stands & (F.col("delta") < 0)).alias("reg"), F.count_if(stands & (F.col("delta") == 0)).alias("neu"),
        F.count_if(~stands).alias("hold"), F.sum(d).alias("net"), (F.sum("current_score") + F.sum(d)).alias("after"),
    )


def gap_quantiles(rows: DataFrame, ps: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), keys: tuple[str, ...] = ("strategy",),
                  value: str = "gap") -> DataFrame:
    """Order statistics at index ``int(p·(n−1))`` without sorting a group in one place.

    Equal values are counted first; the running count over distinct values is bucketed.
    """
    from quadhap.operators.ranking import running_sums

    k = list(keys)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count("*").alias("n"))
    run = running_sums(counted, k, F.floor(F.col(value)), [F.col(value)], {"upto": F.col("n")})
    total = counted.groupBy(*k).agg(F.sum("n").alias("total"))
    j = run.join(total, k)
    hit = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col(value))).alias(f"q{int(round(p * 100))}") for p in ps]
    return j.groupBy(*k).agg(*hit)
