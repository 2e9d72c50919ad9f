"""Evidence gates that decide between a baseline call and a refined one. No truth columns enter here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.functions import dose, names
from quadhap.sources.tables import gene_parameter

GROUP = ["sample", "gene"]


@dataclass(frozen=True)
class GateParams:
    max_diff: float = 0.70
    high_mask: float = 0.40
    ambiguous_diff: float = 0.35
    ambiguous_top_frac: float = 0.42
    selected_min_frac: float = 0.0005
    baseline_min_frac: float = 0.005
    baseline_near_tie: float = 0.001
    class_i_genes: tuple[str, ...] = ("HLA-A",)
    class_i_diff: float = 0.20
    class_i_top_frac: float = 0.50
    overrides: dict[str, dict[str, float]] = field(default_factory=dict)  # parameter -> gene -> value

    def column(self, name: str) -> Column:
        return gene_parameter("gene", getattr(self, name), self.overrides.get(name, {}))


# Gate profiles replayed against each other, as per-gene max_diff overrides.
PROFILES = {
    "global_max_070": {},
    "pipeline_default": {"HLA-DRB1": 0.35, "HLA-DPB1": 0.20, "HLA-DQB1": 0.50},
    "class2_max_050": {"HLA-DRB1": 0.50, "HLA-DPB1": 0.50, "HLA-DQB1": 0.50},
    "class2_max_035": {"HLA-DRB1": 0.35, "HLA-DPB1": 0.35, "HLA-DQB1": 0.50},
    "class2_max_025": {"HLA-DRB1": 0.25, "HLA-DPB1": 0.25, "HLA-DQB1": 0.50},
    "dpb1_strict_020": {"HLA-DPB1": 0.20},
    "drb1_strict_020": {"HLA-DRB1": 0.20},
    "dpb1_noem_drb1_035": {"HLA-DRB1": 0.35, "HLA-DPB1": 0.00, "HLA-DQB1": 0.50},
    "drb1_dpb1_noem": {"HLA-DRB1": 0.00, "HLA-DPB1": 0.00, "HLA-DQB1": 0.50},
}


def gate_metrics(summary: DataFrame, em_calls: DataFrame, baseline_calls: DataFrame, fractions: DataFrame, mask: DataFrame,
                 baseline_min_frac: Column | float = 0.005) -> DataFrame:
    """One row per (sample, gene) of ``summary`` with everything the gate looks at.

    ``summary``: ``sum_abs_diff, top_frac, chi_r_fit``; calls: ``assignment, allele,
    global_hap``; ``fractions``: ``family, fraction``; ``mask``: ``mean_mask_fraction``.
    The residual of the baseline sums over all families.
    """

    def selected(calls: DataFrame) -> DataFrame:
        s = calls.where(F.col("assignment").isin("R", "D")).select(
            *GROUP, F.struct((F.col("assignment") == "D").alias("d"), F.col("global_hap").cast("int").alias("h")).alias("o"),
            names.two_field("allele", "gate").alias("family"),
        ).join(fractions.select(*GROUP, "family", "fraction"), [*GROUP, "family"], "left")
        return s.groupBy(*GROUP).agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "family", F.coalesce("fraction", F.lit(0.0)).alias("fraction")))), 1, 4).alias("s"))

    total = fractions.groupBy(*GROUP).agg(F.sum("fraction").alias("total"))
    m = (
        summary.select(*GROUP, F.col("sum_abs_diff").alias("diff"), "top_frac", F.col("chi_r_fit").alias("chi"))
        .join(selected(em_calls).withColumnRenamed("s", "em"), GROUP, "left")
        .join(selected(baseline_calls).withColumnRenamed("s", "base"), GROUP, "left")
        .join(total, GROUP, "left").join(mask.select(*GROUP, "mean_mask_fraction"), GROUP, "left")
    )
    least = lambda c: F.coalesce(F.array_min(F.transform(c, lambda s: s.fraction)), F.lit(0.0))
    floor = baseline_min_frac if isinstance(baseline_min_frac, Column) else F.lit(float(baseline_min_frac))
    q = F.transform("base", lambda s: s.family)
    residual = dose.quartet_residual(q, dose.fraction_lookup(F.col("base")), F.coalesce("total", F.lit(0.0)), F.col("chi"))
    return m.select(
        *GROUP, "diff", "top_frac", "chi", F.coalesce("mean_mask_fraction", F.lit(0.0)).alias("mask"),
        (F.coalesce(F.size("em"), F.lit(0)) > 0).alias("has_selected"), least("em").alias("min_selected"), least("base").alias("baseline_min"),
        F.coalesce(F.size(F.filter("base", lambda s: s.fraction >= floor)), F.lit(0)).alias("baseline_supported"),
        F.when(F.size("base") >= 4, residual).alias("baseline_residual"),
    )


def em_gate(metrics: DataFrame, p: GateParams = GateParams(), max_diff: Column | None = None) -> DataFrame:
    """Adds ``action`` (``KEEP_BASELINE`` or ``OVERRIDE``) and the ``reasons`` that fired.

    Rules, independent of each other: large residual, unless the baseline has no support
    at all while the selection has; ambiguous high-mask gene; supported high-mask baseline
    nearly as good; protected class-I baseline; unsupported selection.
    """
    diff, mask, top = F.col("diff"), F.col("mask"), F.col("top_frac")
    limit = p.column("max_diff") if max_diff is None else max_diff
    supported, weak = F.col("baseline_supported"), F.col("has_selected") & (F.col("min_selected") < p.column("selected_min_frac"))
    escape = (supported == 0) & F.col("has_selected") & (F.col("min_selected") >= p.column("selected_min_frac"))
    near_tie = F.col("baseline_residual") - diff <= p.column("baseline_near_tie")
    rules = {
        "max_diff": (diff >= limit) & ~escape,
        "ambiguous_high_mask": (mask >= p.column("high_mask")) & (diff >= p.column("ambiguous_diff")) & (top <= p.column("ambiguous_top_frac")) & (supported >= 3),
        "high_mask_baseline_near_tie": F.coalesce((mask >= p.column("high_mask")) & (supported >= 4) & near_tie, F.lit(False)),
        "class_i_high_em_residual": F.col("gene").isin(*p.class_i_genes) & (diff >= p.class_i_diff) & (top <= p.class_i_top_frac) & (supported >= 4),
        "low_selected_support": weak & (diff >= p.column("ambiguous_diff")),
    }
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    out = metrics.withColumn("reasons", fired)
    keep = F.size("reasons") > 0
    reasons = F.when(~keep & (diff >= limit) & escape, F.array(F.lit("baseline_unsupported"))).otherwise(F.col("reasons"))
    return out.withColumn("action", F.when(keep, "KEEP_BASELINE").otherwise("OVERRIDE")).withColumn("reasons", reasons)


def replay_profiles(metrics: DataFrame, profiles: dict[str, dict[str, float]] = PROFILES, p: GateParams = GateParams()) -> DataFrame:
    """The gate under every profile: one row per (sample, gene, profile).

    The profile only changes the residual limit, so each row carries a short list of
    limits instead of being joined to a profile table.
    """
    limits = F.array(*[
        F.struct(F.lit(name).alias("profile"), gene_parameter("gene", p.max_diff, over).alias("limit")) for name, over in profiles.items()
    ])
    rows = metrics.withColumn("x", F.explode(limits)).select("*", "x.profile", "x.limit").drop("x")
    return em_gate(rows, p, max_diff=F.col("limit"))


def choose_calls(gated: DataFrame, baseline: DataFrame, em: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Long calls of the version the gate chose; genes without gate row keep the baseline."""
    take = gated.where(F.col("action") == "OVERRIDE").select(*keys)
    both = em.select(*keys).distinct()
    take = take.join(both, keys, "left_semi")
    return baseline.join(take, keys, "left_anti").withColumn("version", F.lit("baseline")).unionByName(
        em.join(take, keys, "left_semi").withColumn("version", F.lit("em")), allowMissingColumns=True
    )


def direct_overrides(direct: DataFrame, min_gap: float = 150.0) -> DataFrame:
    """Likelihood quartets that differ from the current call by a sufficient gap.

    ``direct``: ``(sample, gene, quartet, current, gap)``; order inside a quartet matters.
    """
    return direct.where((F.col("gap") >= min_gap) & (F.size("quartet") > 0) & (F.col("quartet") != F.col("current")))


def lift_alleles(quartets: DataFrame, options: DataFrame) -> DataFrame:
    """Full names for family quartets: the n-th use of a family takes its n-th known full name, or the last one.

    ``options``: ``(sample, gene, family, allele, ord)``. Returns ``lifted``; a family
    without names stays as it is.
    """
    uses = quartets.select(*GROUP, "quartet", F.posexplode("quartet").alias("p", "family")).withColumn(
        "nth", F.size(F.filter(F.slice("quartet", F.lit(1), F.col("p") + 1), lambda a: a == F.col("family")))
    )
    known = options.join(uses.select(*GROUP, "family").distinct(), [*GROUP, "family"], "left_semi")
    lists = known.groupBy(*GROUP, "family").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "allele"))), 1, 4).alias("first"), F.max_by("allele", F.struct("ord", "allele")).alias("last"))
    named = uses.join(lists, [*GROUP, "family"], "left").withColumn("full", F.coalesce(F.get("first", F.col("nth") - 1)["allele"], "last", "family"))
    return named.groupBy(*GROUP, "quartet").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "full"))), lambda s: s.full).alias("lifted"))
