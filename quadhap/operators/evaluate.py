"""Accuracy of final calls against truth typings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.functions import names
from quadhap.operators.calls import attach_ggroup

KEYS = ["sample", "side", "gene"]


def long_calls(final: DataFrame, call_set: str = "report") -> DataFrame:
    """``(sample, side, gene, allele)`` of the wide table; missing slots are ``NA``."""
    slots = F.array(*[
        F.struct(F.lit(side).alias("side"), F.coalesce(f"{s}_{call_set}", F.lit("NA")).alias("allele"))
        for s, side in (("R1", "PATIENT"), ("R2", "PATIENT"), ("D1", "DONOR"), ("D2", "DONOR"))
    ])
    return final.select("sample", "gene", F.explode(slots).alias("x")).select("sample", "x.side", "gene", "x.allele")


def prefix_groups(ggroups: DataFrame) -> DataFrame:
    """``(prefix, groups, grp)``: how many G groups the members below a name prefix fall into (``grp`` if one).

    Every ``:``-prefix of a member becomes a key, so a prefix search is an equi-join.
    """
    m = ggroups.where(~F.col("member").endswith("G"))
    parts = F.split("member", ":")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ":"))).otherwise(
        F.array().cast("array<string>")
    )
    e = m.select("grp", F.explode(prefixes).alias("prefix")).distinct()
    return e.groupBy("prefix").agg(F.count("*").alias("groups"), F.min("grp").alias("grp"))


def truth_targets(truth: DataFrame, ggroups: DataFrame) -> DataFrame:
    """Adds ``level`` and ``target``: the resolution a truth allele supports and its value there.

    A two-field truth whose members spread over several G groups (or none) is only
    comparable at two fields.
    """
    t = attach_ggroup(truth, "allele", ggroups, "_grp", bare="strip").withColumn("_a", names.clean_allele("allele", "strip"))
    t = t.join(F.broadcast(prefix_groups(ggroups).select(F.col("prefix").alias("_a"), F.col("groups").alias("_n"))), "_a", "left")
    n = names.field_count("allele")
    unclear = (n == 2) & (F.coalesce("_n", F.lit(0)) != 1)
    group_level = ~unclear & (F.col("_a").endswith("G") | (F.col("_grp") != F.col("_a")) | (n >= 3))
    return t.withColumns({
        "level": F.when(group_level, "g_group").otherwise("2field"),
        "target": F.when(group_level, F.col("_grp")).otherwise(names.two_field("allele", "report", "strip")),
    }).drop("_a", "_n", "_grp")


def _overlap(truth: Column, count) -> Column:
    """Multiset overlap: Σ min(count, count) over the values of ``truth``; ``count`` says how often the other side has one."""
    return F.aggregate(F.array_distinct(truth), F.lit(0).cast("bigint"), lambda n, v: n + F.least(F.size(F.filter(truth, lambda x: x == v)), count(v)))


def evaluate_calls(calls: DataFrame, truth: DataFrame, ggroups: DataFrame, levels: tuple[str, ...] = ("2field", "g_group"),
                   strict: bool = False) -> DataFrame:
    """``(sample, side, gene, level, hits, total, mismatch, truth, pred)`` for genes that were called.

    ``calls``: ``(sample, side, gene, allele)`` from ``long_calls``; ``truth`` alike. At the
    G-group level each truth allele is compared at its own resolution, and predictions are
    counted separately per resolution, so one prediction can serve twice; ``strict`` caps
    the hits at the number of predictions that match anything.
    """
    two, grouped = names.two_field("allele", "report", "strip"), "g_group" in levels
    p, t = calls.withColumn("2field", two), truth
    if grouped:
        p, t = attach_ggroup(p, "allele", ggroups, "g_group", bare="strip"), truth_targets(truth, ggroups)
    none = F.lit(None).cast("string")
    p = p.select(*KEYS, F.struct("2field", (F.col("g_group") if grouped else none).alias("g_group")).alias("p"), F.lit(None).alias("t"))
    t = t.select(*KEYS, F.lit(None).alias("p"), F.struct(two.alias("2field"), *[(F.col(c) if grouped else none).alias(c) for c in ("level", "target")]).alias("t"))
    # The alleles of one side of one gene are few: both sides meet in one shuffle and are compared as arrays.
    met = p.unionByName(t).na.drop(subset=KEYS).groupBy(*KEYS).agg(F.collect_list("p").alias("p"), F.collect_list("t").alias("t")).where("size(p) > 0 and size(t) > 0")
    show = lambda a: F.array_join(F.array_sort(a), ",")
    of = lambda a, c: F.transform(a, lambda x: x[c])

    def one(level: str) -> Column:
        if level == "g_group":
            value, keyed = of("t", "target"), F.transform("t", lambda x: F.struct(x["level"], x["target"]))
            fits = lambda x, v: F.when(v["level"] == "2field", x["2field"] == v["target"]).otherwise(x["g_group"] == v["target"])
            hits = _overlap(keyed, lambda v: F.size(F.filter("p", lambda x: fits(x, v))))
            if strict:
                hits = F.least(hits, F.size(F.filter("p", lambda x: F.exists("t", lambda v: fits(x, v)))))
        else:
            value = of("t", "2field")
            hits = _overlap(value, lambda v: F.size(F.filter("p", lambda x: x["2field"] == v)))
        return F.struct(F.lit(level).alias("level"), hits.cast("bigint").alias("hits"), F.size("t").cast("bigint").alias("total"), show(value).alias("truth"), show(of("p", level)).alias("pred"))

    each = met.select(*KEYS, F.explode(F.array(*[one(x) for x in levels])).alias("x")).select(*KEYS, "x.*")
    return each.select(*KEYS, "level", "hits", "total", (F.col("hits") != F.col("total")).alias("mismatch"), "truth", "pred")


def quartet_score(quartet: Column, truth: Column) -> Column:
    """Slots of a quartet that agree with a truth quartet, side by side, order inside a side ignored."""
    return names.pair_overlap(F.slice(quartet, 1, 2), F.slice(truth, 1, 2)) + names.pair_overlap(F.slice(quartet, 3, 2), F.slice(truth, 3, 2))


def accuracy(evaluated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return evaluated.groupBy("level", *by).agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"), F.count_if("mismatch").alias("mismatches"))


def compare_versions(versions: DataFrame, truth: DataFrame, ggroups: DataFrame, current: str) -> DataFrame:
    """Per call version: changed genes and score change when it replaces the current calls gene by gene.

    ``versions``: ``(version, sample, side, gene, allele)``. A gene the version lacks keeps the current call.
    """
    tagged = versions.withColumn("sample", F.concat_ws("\u0001", "version", "sample"))
    t = truth.join(versions.select("version", "sample").distinct(), "sample")
    t = t.withColumn("sample", F.concat_ws("\u0001", "version", "sample")).drop("version")
    e = evaluate_calls(tagged, t, ggroups).withColumns({
        "version": F.substring_index("sample", "\u0001", 1), "sample": F.substring_index("sample", "\u0001", -1)
    })
    base = e.where(F.col("version") == current).select(*KEYS, "level", F.col("hits").alias("hits0"), F.col("pred").alias("pred0"))
    j = e.join(base, [*KEYS, "level"])
    return j.groupBy("version", "level").agg(
        F.count_if(F.col("pred") != F.col("pred0")).alias("changed"), F.sum(F.col("hits") - F.col("hits0")).alias("delta"),
    )
