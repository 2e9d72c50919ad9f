"""Guarded rescues of class-II calls: linkage anchor and DPB1 slot rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import names
from quadhap.operators.ranking import top_k

GROUP = ["sample", "gene"]

# DRB1 allele that travels with a DQB1 allele.
DRB1_OF_DQB1 = {
    "DQB1*02:01": "DRB1*03:01",
    "DQB1*02:02": "DRB1*07:01",
    "DQB1*02:82": "DRB1*07:01",
    "DQB1*02:109": "DRB1*03:01",
    "DQB1*03:01": "DRB1*04:01",
    "DQB1*06:02": "DRB1*15:01",
}


def drb1_from_dqb1(calls: DataFrame, min_mask: float = 0.40, linkage: dict[str, str] = DRB1_OF_DQB1) -> DataFrame:
    """DRB1 proposals read off the DQB1 quartet of the same sample, all four slots or none.

    ``calls``: ``(sample, gene, quartet, mask)`` with family quartets. Only high-mask
    DRB1 calls are touched and only when something changes.
    """
    table = F.create_map(*[F.lit(x) for kv in linkage.items() for x in kv])
    dqb1 = calls.where(F.col("gene") == "HLA-DQB1").select("sample", F.transform("quartet", lambda a: F.element_at(table, a)).alias("candidate"))
    dqb1 = dqb1.where((F.size("candidate") == 4) & F.forall("candidate", lambda a: a.isNotNull()))
    drb1 = calls.where((F.col("gene") == "HLA-DRB1") & (F.col("mask") >= min_mask))
    return drb1.join(dqb1, "sample").where(F.col("candidate") != F.col("quartet")).select(
        *GROUP, "quartet", F.col("candidate").alias("proposed"), F.lit("drdq_ld_anchor").alias("rule")
    )


def with_counts(calls: DataFrame, families: DataFrame, top: int | None = 12) -> DataFrame:
    """Attach the ``top`` heaviest families and those of the quartet as ``counts`` (heaviest first).

    ``None`` attaches all families of the gene.
    """
    ranked = families.select(*GROUP, F.col("family").alias("allele"), "weight", "fraction")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("weight"), "allele")
    j = calls.select(*GROUP, "quartet").join(ranked.withColumn("rank", F.row_number().over(order)), GROUP)
    if top is not None:
        j = j.where((F.col("rank") <= top) | F.array_contains("quartet", F.col("allele")))
    c = j.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("rank", "allele", "weight", "fraction"))).alias("counts"))
    empty = F.array().cast("array<struct<rank:int,allele:string,weight:double,fraction:double>>")
    return calls.join(c, GROUP, "left").withColumn("counts", F.coalesce("counts", empty))


def _uses(q: Column, allele: Column) -> Column:
    return F.size(F.filter(q, lambda a: a == allele))


def dpb1_rare_collapse(calls: DataFrame, families: DataFrame, cutoff: int = 100, min_fraction: float = 0.02, top_common: int = 6,
                       min_mask: float = 0.40) -> DataFrame:
    """Slots with a rare allele (number ≥ ``cutoff``) take the first common allele used fewer than twice.

    Slots are visited in order and see what earlier slots received. Adds ``proposed``;
    rows below ``min_mask`` keep their quartet.
    """
    f = families.where((names.allele_number("family") < cutoff) & (F.col("fraction") >= min_fraction))
    f = top_k(f, GROUP, [F.desc("weight"), F.asc("family")], top_common)
    c = f.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "family"))), lambda s: s.family).alias("common"))
    j = calls.join(c, GROUP, "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    for slot in range(4):  # one column per slot keeps the expression small
        src = "quartet" if slot == 0 else f"_q{slot - 1}"
        now = F.get(src, F.lit(slot))
        pick = F.get(F.filter("common", lambda x: F.size(F.filter(src, lambda a: a == x)) < 2), F.lit(0))
        new = F.when(names.allele_number(now) >= cutoff, F.coalesce(pick, now)).otherwise(now)
        j = j.withColumn(f"_q{slot}", F.array(*[new if x == slot else F.get(src, F.lit(x)) for x in range(4)]))
    return j.withColumn("proposed", F.when(F.col("mask") >= min_mask, F.col("_q3")).otherwise(F.col("quartet"))).drop("common", *[f"_q{i}" for i in range(4)])


def dpb1_common_minor(calls: DataFrame, max_number: int = 10, min_fraction: float = 0.005, max_fraction: float = 0.09,
                      min_weight: float = 50.0, top: int = 12) -> DataFrame:
    """Heterozygous recipient pair equal to the donor pair: bring in the heaviest plausible minor allele.

    ``calls`` come from ``with_counts``. The minor allele replaces the recipient allele
    that does not share its first field, or else the less supported one.
    """
    q = F.col("quartet")
    r = F.slice(q, 1, 2)
    r1, r2 = F.get("quartet", F.lit(0)), F.get("quartet", F.lit(1))
    applies = (F.array_sort(r) == F.array_sort(F.slice(q, 3, 2))) & (r1 != r2)
    minors = F.filter(
        "counts",
        lambda c: (c["rank"] <= top) & ~F.array_contains(F.slice("quartet", 1, 2), c.allele) & (names.allele_number(c.allele) <= max_number)
        & c.fraction.between(min_fraction, max_fraction) & (c.weight >= min_weight),
    )
    d = calls.withColumn("_m", F.when(applies, F.get(minors, F.lit(0))))
    frac = lambda a: F.coalesce(F.get(F.filter("counts", lambda c: c.allele == a), F.lit(0)).fraction, F.lit(0.0))
    like = lambda a: names.first_field(a) == names.first_field(F.col("_m.allele"))
    keep_first = F.when(like(r1), True).when(like(r2), False).otherwise(frac(r1) > frac(r2))
    new = F.when(keep_first, F.array(r1, F.col("_m.allele"))).otherwise(F.array(F.col("_m.allele"), r2))
    return d.withColumn("proposed", F.when(F.col("_m").isNotNull(), F.concat(new, F.slice(q, 3, 2))).otherwise(q)).drop("_m")


def dpb1_absolute_common(calls: DataFrame, max_number: int = 10, min_weight: float = 150.0, min_fraction: float = 0.01,
                         min_ratio: float = 2.0) -> DataFrame:
    """An allele called three or more times gives one slot to the heaviest missing common allele.

    The donor slot with the least support goes first; the newcomer must outweigh the
    replaced allele ``min_ratio`` times, else the next missing allele is tried.
    ``calls`` come from ``with_counts``.
    """
    d = calls.withColumn(
        "_miss",
        F.filter("counts", lambda c: ~F.array_contains("quartet", c.allele) & (names.allele_number(c.allele) <= max_number)
                 & (c.weight >= min_weight) & (c.fraction >= min_fraction)),
    )
    weight = lambda a: F.coalesce(F.get(F.filter("counts", lambda c: c.allele == a), F.lit(0)).weight, F.lit(0.0))
    slots = F.array(*[
        F.struct(F.lit(0 if i >= 2 else 1).alias("side"), weight(F.get("quartet", F.lit(i))).alias("weight"), F.lit(i).alias("i"),
                 (_uses(F.col("quartet"), F.get("quartet", F.lit(i))) >= 3).alias("ok"))
        for i in range(4)
    ])
    d = d.withColumn("_slots", F.filter(slots, lambda s: s.ok))
    tries = F.transform("_miss", lambda m: F.struct(
        m.allele.alias("allele"),
        F.array_min(F.filter("_slots", lambda s: ~((s.weight > 0) & (m.weight < s.weight * min_ratio)))).alias("s"),
    ))
    d = d.withColumn("_hit", F.get(F.filter(tries, lambda t: t.s.isNotNull()), F.lit(0)))
    new = F.array(*[F.when(F.col("_hit.s.i") == i, F.col("_hit.allele")).otherwise(F.get("quartet", F.lit(i))) for i in range(4)])
    return d.withColumn("proposed", F.when(F.col("_hit").isNotNull(), new).otherwise(F.col("quartet"))).drop("_miss", "_slots", "_hit")


def propose_dpb1(calls: DataFrame, families: DataFrame, min_mask: float = 0.40) -> DataFrame:
    """The three DPB1 rules in order, with the names of those that changed something in ``rule``."""
    base = calls.where((F.col("gene") == "HLA-DPB1") & (F.col("mask") >= min_mask)).withColumn("_orig", F.col("quartet"))
    step = dpb1_rare_collapse(base, families, min_mask=min_mask)
    step = step.withColumn("_r1", F.col("proposed") != F.col("quartet")).withColumn("quartet", F.col("proposed")).drop("proposed")
    step = dpb1_common_minor(with_counts(step, families))
    step = step.withColumn("_r2", F.col("proposed") != F.col("quartet")).withColumn("quartet", F.col("proposed")).drop("proposed", "counts")
    step = dpb1_absolute_common(with_counts(step, families, top=None))
    step = step.withColumn("_r3", F.col("proposed") != F.col("quartet"))
    rule = F.concat_ws("+", F.when(F.col("_r1"), "dpb1_rare_collapse"), F.when(F.col("_r2"), "dpb1_common_minor"), F.when(F.col("_r3"), "dpb1_absolute_common"))
    return step.where(F.col("proposed") != F.col("_orig")).select(*GROUP, F.col("_orig").alias("quartet"), "proposed", rule.alias("rule"))


def stack_strategies(calls: DataFrame, proposals: list[tuple[str, DataFrame]]) -> DataFrame:
    """Chosen quartet and its reason; later proposals take precedence over earlier ones.

    ``proposals``: ``(reason, DataFrame(sample, gene, proposed))`` in application order.
    """
    out = calls
    cols: list[Column] = []
    for i, (reason, df) in enumerate(proposals):
        out = out.join(df.select(*GROUP, F.col("proposed").alias(f"_p{i}")), GROUP, "left")
        cols.insert(0, F.when(F.col(f"_p{i}").isNotNull(), F.struct(F.col(f"_p{i}").alias("q"), F.lit(reason).alias("reason"))))
    pick = F.coalesce(*cols, F.struct(F.col("quartet").alias("q"), F.lit("current").alias("reason")))
    out = out.withColumn("_x", pick)
    return out.withColumns({"chosen": F.col("_x.q"), "reason": F.col("_x.reason")}).drop("_x", *[f"_p{i}" for i in range(len(proposals))])
