"""Quartet, gate and rescue queries: revenue per brand is family evidence, nations and flags are samples and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.operators import class2, drb345, gates, quartet, tallies
from quadhap.plans.registry import Tables, micro, micro_sql, query, with_

GROUP = ["sample", "gene"]

FAMILIES = """SELECT concat('n', lpad(cast(s_nationkey as string), 2, '0')) AS sample, l_returnflag AS gene, p_brand AS family, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) AS weight
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3"""
CHI = "SELECT concat('n', lpad(cast(n_nationkey as string), 2, '0')) AS sample, (n_nationkey % 9 + 1) * cast(0.05 as double) AS chi_r FROM {nation}"

FRACTIONS = "SELECT sample, gene, family, weight, fraction, row_number() OVER (PARTITION BY sample, gene ORDER BY weight DESC, family) AS ord FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY sample, gene) AS fraction FROM fam)"
POOL = "SELECT sample, gene, family, fraction, ord FROM fr WHERE fraction > 0.002::double"


def residual_sql(slots: list[str], shares: list[str], total: str, chi: str = "chi") -> str:
    """Σ|o − e| of one quartet, counting each distinct member once."""
    terms = [total]
    for i, m in enumerate(slots):
        n_r = " + ".join(f"({slots[x]} = {m})::int" for x in (0, 1))
        n_d = " + ".join(f"({slots[x]} = {m})::int" for x in (2, 3))
        first = " AND ".join(f"{slots[x]} <> {m}" for x in range(i)) or "true"
        terms.append(f"CASE WHEN {first} THEN abs({shares[i]} - (({n_r}) * {chi} / 2 + ({n_d}) * (1 - {chi}) / 2)) - {shares[i]} ELSE 0 END")
    return " + ".join(terms)


def _brute(grid: str) -> dict[str, str]:
    """Every ordered pair of pairs of the pool, without the library's pruning."""
    return dict(
        fam=FAMILIES, chi0=CHI, fr=FRACTIONS, pool=POOL,
        pr="SELECT a.sample, a.gene, a.ord AS i, b.ord AS j, a.family AS fa, b.family AS fb, a.fraction AS oa, b.fraction AS ob FROM pool a JOIN pool b ON a.sample = b.sample AND a.gene = b.gene AND a.family <= b.family",
        base="SELECT sample, gene, sum(fraction) AS base FROM pool GROUP BY ALL",
        q=f"""SELECT r.sample, r.gene, r.i, r.j, d.i AS k, d.j AS m, r.fa AS f1, r.fb AS f2, d.fa AS f3, d.fb AS f4, r.oa AS o1, r.ob AS o2, d.oa AS o3, d.ob AS o4, base, chi_r, chi, chi_ord
          FROM pr r JOIN pr d ON r.sample = d.sample AND r.gene = d.gene JOIN base ON base.sample = r.sample AND base.gene = r.gene JOIN chi0 ON chi0.sample = r.sample, {grid}""",
    )


@query("quartet_l1", with_(
    f"""SELECT sample, gene, least(f1, f2) AS r1, greatest(f1, f2) AS r2, least(f3, f4) AS d1, greatest(f3, f4) AS d2, {micro_sql('score')} AS score_micro FROM (
      SELECT *, row_number() OVER (PARTITION BY sample, gene ORDER BY score, i, j, k, m) AS r FROM (SELECT *, round({residual_sql(['f1', 'f2', 'f3', 'f4'], ['o1', 'o2', 'o3', 'o4'], 'base')}, 12) AS score FROM q)) WHERE r = 1""",
    **{k: v.replace(", (SELECT 1) g", "").replace("chi_r, chi, chi_ord", "chi_r, chi_r AS chi, 0 AS chi_ord") for k, v in _brute("(SELECT 1) g").items()}))
def quartet_l1(t: Tables) -> DataFrame:
    return spelled(quartet.fit_quartet_l1(t.view(FAMILIES), t.view(CHI)))


def spelled(fit: DataFrame, *extra) -> DataFrame:
    cols = [F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))]
    return fit.select(*GROUP, *cols, micro("score").alias("score_micro"), *extra)


REGIONAL = FAMILIES.replace("concat('n', lpad(cast(s_nationkey as string), 2, '0'))", "concat('n', lpad(cast(s_nationkey % 5 as string), 2, '0'))")


@query("quartet_chi_grid", with_(
    f"""SELECT sample, gene, least(f1, f2) AS r1, greatest(f1, f2) AS r2, least(f3, f4) AS d1, greatest(f3, f4) AS d2, {micro_sql('score')} AS score_micro, {micro_sql('chi')} AS chi_micro FROM (
      SELECT *, row_number() OVER (PARTITION BY sample, gene ORDER BY score, i, j, k, m, chi_ord) AS r FROM (SELECT *, round({residual_sql(['f1', 'f2', 'f3', 'f4'], ['o1', 'o2', 'o3', 'o4'], 'base')} + 0.5::double * abs(chi - chi_r), 12) AS score FROM q)) WHERE r = 1""",
    **(_brute("(SELECT i AS chi_ord, 0.05::double + i * 0.09::double AS chi FROM range(0, 6) x(i)) g") | {"fam": REGIONAL})))
def quartet_chi_grid(t: Tables) -> DataFrame:
    fit = quartet.fit_quartet_l1(t.view(REGIONAL), t.view(CHI), chi_grid=(0.05, 0.5, 0.09), chi_prior=0.5)
    return spelled(fit, micro("chi_fit").alias("chi_micro"))


READ_FAMILY = """SELECT l_returnflag AS sample, l_linestatus AS gene, cast(l_orderkey as string) AS read, p_brand AS family, cast(l_quantity as int) AS score FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
FLAG_CHI = "SELECT DISTINCT l_returnflag AS sample, cast(0.2 as double) AS chi_r FROM {lineitem}"
# All quartets of 25 families times all reads are too many for a check in SQL; the tests enumerate a small fixture.
@query("quartet_likelihood")
def quartet_likelihood(t: Tables) -> DataFrame:
    reads = t.view(READ_FAMILY)
    weights = reads.groupBy(*GROUP, "family").agg(F.count("*").cast("double").alias("weight"))
    fit = quartet.fit_quartet_likelihood(quartet.family_logweights(reads), weights, t.view(FLAG_CHI))
    cols = [F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))]
    return fit.select(*GROUP, *cols, micro("nll", 1e3).alias("nll_milli"), micro("gap", 1e3).alias("gap_milli"), "n_reads")


def ranked_fit(t: Tables, ranks: tuple[int, int, int, int], families: DataFrame | None = None) -> DataFrame:
    """A call whose slots are the families at the given ranks."""
    f = quartet.family_fractions(t.view(FAMILIES) if families is None else families)
    q = f.groupBy(*GROUP).agg(F.array(*[F.max(F.when(F.col("ord") == r, F.col("family"))) for r in ranks]).alias("quartet"))
    return q.join(t.view(CHI).select("sample", F.col("chi_r").alias("chi_fit")), "sample")


def ranked_sql(ranks: tuple[int, int, int, int]) -> str:
    return "SELECT sample, gene, " + ", ".join(f"max(CASE WHEN ord = {r} THEN family END) AS f{i}" for i, r in enumerate(ranks, 1)) + ", " + ", ".join(
        f"max(CASE WHEN ord = {r} THEN fraction END) AS o{i}" for i, r in enumerate(ranks, 1)) + " FROM fr GROUP BY ALL"


@query("recipient_minor", with_(
    """SELECT c.sample, c.gene, CASE WHEN minor IS NULL THEN f1 ELSE f3 END AS r1, coalesce(minor, f2) AS r2, f3 AS d1, f4 AS d2, minor FROM c LEFT JOIN (
      SELECT c.sample, c.gene, arg_min(family, (-weight, family)) AS minor FROM c JOIN fr ON c.sample = fr.sample AND c.gene = fr.gene JOIN chi0 ON chi0.sample = c.sample
      WHERE chi_r < 0.45 AND family NOT IN (f3, f4) AND weight >= 20 AND fraction BETWEEN 0.001::double AND 0.042::double GROUP BY ALL) x ON x.sample = c.sample AND x.gene = c.gene""",
    fam=FAMILIES, chi0=CHI, fr=FRACTIONS, c=ranked_sql((2, 1, 1, 2))))
def recipient_minor(t: Tables) -> DataFrame:
    out = quartet.rescue_recipient_minor(ranked_fit(t, (2, 1, 1, 2)), t.view(FAMILIES), t.view(CHI), max_frac=0.042)
    return out.select(*GROUP, *[F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))], "minor")


def _trial_sql(slot: int, src: str) -> str:
    """Trials for one recipient slot: donors first, then the four heaviest families."""
    f = [f"f{i}" if i != slot else "rep" for i in range(1, 5)]
    o = [f"o{i}" if i != slot else "ro" for i in range(1, 5)]
    now = residual_sql(["f1", "f2", "f3", "f4"], ["o1", "o2", "o3", "o4"], "1.0::double", "chi_r")
    return f"""SELECT *, round({now}, 12) AS cur, round({residual_sql(f, o, '1.0::double', 'chi_r')}, 12) AS res,
      f{slot} NOT IN (f3, f4) AND o{slot} < 0.06::double AND o{slot} < chi_r / 2 * 0.9::double AS tiny FROM {src} JOIN cand USING (sample, gene) JOIN chi0 USING (sample) WHERE rep <> f{slot}"""


def _step_sql(slot: int, src: str, trial: str) -> str:
    keep = [c for c in ("f1", "f2", "f3", "f4", "o1", "o2", "o3", "o4")]
    cols = ", ".join(f"CASE WHEN b.rep IS NULL THEN s.{c} ELSE b.{'rep' if c[0] == 'f' else 'ro'} END AS {c}" if c[1] == str(slot) else f"s.{c}" for c in keep)
    return f"""SELECT s.sample, s.gene, {cols}, s.n + (b.rep IS NOT NULL)::int AS n FROM {src} s LEFT JOIN (SELECT sample, gene, arg_min(rep, (res, pos)) AS rep, arg_min(ro, (res, pos)) AS ro
      FROM {trial} WHERE tiny GROUP BY sample, gene HAVING min(res) < min(cur) - 1e-9) b ON b.sample = s.sample AND b.gene = s.gene"""


@query("low_private", with_(
    "SELECT sample, gene, f1 AS r1, f2 AS r2, f3 AS d1, f4 AS d2, n::int AS n_changed FROM s2",
    fam=FAMILIES, chi0=CHI, fr=FRACTIONS, c=ranked_sql((24, 22, 1, 2)), s0="SELECT *, 0 AS n FROM c",
    cand="SELECT sample, gene, family AS rep, fraction AS ro, ord AS pos FROM fr WHERE ord <= 4",
    t1=_trial_sql(1, "s0"), s1=_step_sql(1, "s0", "t1"), t2=_trial_sql(2, "s1"), s2=_step_sql(2, "s1", "t2")))
def low_private(t: Tables) -> DataFrame:
    out = quartet.collapse_low_private(ranked_fit(t, (24, 22, 1, 2)), t.view(FAMILIES), max_frac=0.06, dose_ratio=0.9)
    return out.select(*GROUP, *[F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))], F.size("collapsed").alias("n_changed"))


LINKED_FAM = """SELECT concat('n', lpad(cast(s_nationkey as string), 2, '0')) AS sample, concat(CASE WHEN p_size % 3 = 0 THEN 'DRB3' WHEN p_size % 3 = 1 THEN 'DRB4' ELSE 'DRB5' END, '*', lpad(cast(p_size as string), 2, '0'), ':01') AS family,
  cast(sum(cast(l_quantity as int)) as double) AS weight FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2"""
LOCI = ["absent", "DRB3", "DRB4", "DRB5"]
LINKED_SLOTS = """SELECT concat('n', lpad(cast(n_nationkey as string), 2, '0')) AS sample, concat('DRB1*', CASE n_nationkey % 4 WHEN 0 THEN '03' WHEN 1 THEN '04' WHEN 2 THEN '15' ELSE '01' END, ':01') AS a1,
  concat('DRB1*', CASE WHEN n_nationkey % 3 = 0 THEN '07' WHEN n_nationkey % 3 = 1 THEN '11' ELSE '16' END, ':01') AS a2, CASE WHEN n_nationkey % 2 = 0 THEN 'DRB1*13:02' ELSE 'DRB1*09:01' END AS a3, 'DRB1*14:01' AS a4 FROM {nation}"""
LOCUS_CASE = "CASE WHEN substr({a}, 6, 2) IN ('03', '11', '12', '13', '14') THEN 'DRB3' WHEN substr({a}, 6, 2) IN ('04', '07', '09') THEN 'DRB4' WHEN substr({a}, 6, 2) IN ('15', '16') THEN 'DRB5' ELSE 'absent' END"


def _linked_score() -> str:
    w = ["chi_r / 2", "chi_r / 2", "(1 - chi_r) / 2", "(1 - chi_r) / 2"]
    scale = " + ".join(f"CASE WHEN f{i + 1} <> 'NA' THEN {w[i]} ELSE 0 END" for i in range(4))
    out = ["1.0::double"]
    for i in range(4):
        first = " AND ".join([f"f{i + 1} <> 'NA'"] + [f"f{x + 1} <> f{i + 1}" for x in range(i)])
        e = " + ".join(f"CASE WHEN f{x + 1} = f{i + 1} THEN {w[x]} ELSE 0 END" for x in range(4))
        out.append(f"CASE WHEN {first} THEN abs(o{i + 1} - ({e}) / ({scale})) - o{i + 1} ELSE 0 END")
    return " + ".join(out)


@query("linked_fit", with_(
    f"""SELECT sample, f1 AS r1, f2 AS r2, f3 AS d1, f4 AS d2, {micro_sql('score')} AS score_micro FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score, p1, p2, p3, p4) AS r FROM (
      SELECT *, round({_linked_score()}, 12) AS score FROM q)) WHERE r = 1""",
    fm=LINKED_FAM, chi0=CHI, sl=LINKED_SLOTS,
    fr="SELECT *, substr(family, 1, 4) AS locus, weight / sum(weight) OVER (PARTITION BY sample) AS o, row_number() OVER (PARTITION BY sample, substr(family, 1, 4) ORDER BY weight DESC, family) AS p FROM fm",
    op="SELECT sample, locus, family AS f, o, p FROM fr WHERE p <= 8 UNION ALL SELECT sample, 'absent', 'NA', 0, 1 FROM chi0",
    lo="SELECT sample, " + ", ".join(LOCUS_CASE.replace("{a}", f"a{i}") + f" AS l{i}" for i in range(1, 5)) + " FROM sl",
    q="SELECT lo.sample, chi_r, " + ", ".join(f"x{i}.f AS f{i}, x{i}.o AS o{i}, x{i}.p AS p{i}" for i in range(1, 5)) + " FROM lo JOIN chi0 USING (sample) " + " ".join(f"JOIN op x{i} ON x{i}.sample = lo.sample AND x{i}.locus = l{i}" for i in range(1, 5))))
def linked_fit(t: Tables) -> DataFrame:
    s = t.view(LINKED_SLOTS)
    wide = s.select("sample", F.lit("HLA-DRB1").alias("gene"), *[F.col(f"a{i}").alias(f"{n}_full") for i, n in enumerate(drb345.SLOTS, 1)])
    fit = drb345.fit_linked(t.view(LINKED_FAM), drb345.drb1_slots(wide), t.view(CHI))
    return fit.select("sample", *[F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))], micro("score").alias("score_micro"))


@query("evidence_fit", with_(
    f"""SELECT sample, f1 AS r1, f2 AS r2, f3 AS d1, f4 AS d2, {micro_sql('score')} AS score_micro FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score, p1, p2, p3, p4) AS r FROM (
      SELECT *, round({residual_sql(['f1', 'f2', 'f3', 'f4'], ['o1', 'o2', 'o3', 'o4'], '1.0::double', 'chi_r')}, 12) AS score FROM q)) WHERE r = 1""",
    fm=LINKED_FAM, chi0=CHI,
    fr="SELECT sample, family AS f, weight / sum(weight) OVER (PARTITION BY sample) AS o, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, family) AS p FROM fm WHERE substr(family, 1, 4) <> 'DRB4'",
    op="SELECT * FROM fr WHERE p <= 9",
    q="SELECT chi0.sample, chi_r, " + ", ".join(f"x{i}.f AS f{i}, x{i}.o AS o{i}, x{i}.p AS p{i}" for i in range(1, 5)) + " FROM chi0 " + " ".join(f"JOIN op x{i} ON x{i}.sample = chi0.sample" for i in range(1, 5)) + " WHERE x1.p <= x2.p AND x3.p <= x4.p"))
def evidence_fit(t: Tables) -> DataFrame:
    loci = t.view("SELECT concat('n', lpad(cast(n_nationkey as string), 2, '0')) AS sample, 'DRB3' AS locus FROM {nation} UNION ALL SELECT concat('n', lpad(cast(n_nationkey as string), 2, '0')), 'DRB5' FROM {nation}")
    fit = drb345.fit_evidence(t.view(LINKED_FAM), loci, t.view(CHI))
    return fit.select("sample", *[F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))], micro("score").alias("score_micro"))


# ------------------------------------------------------------------------ gates

METRICS = """SELECT concat('d', cast(d.doc_id as string)) AS sample, CASE d.doc_id % 6 WHEN 0 THEN 'HLA-A' WHEN 1 THEN 'HLA-B' WHEN 2 THEN 'HLA-C' WHEN 3 THEN 'HLA-DPB1' WHEN 4 THEN 'HLA-DQB1' ELSE 'HLA-DRB1' END AS gene,
  (d.n_chars % 101) / 100 AS diff, (d.n_chars % 89) / 88 AS top_frac, cast(0.2 as double) AS chi, (d.doc_id % 67) / 66 AS mask, d.n_chars % 13 > 0 AS has_selected, (d.n_chars % 17) / 10000 AS min_selected,
  cast(0 as double) AS baseline_min, cast(d.n_chars % 5 as int) AS baseline_supported, CASE WHEN d.n_chars % 11 = 0 THEN NULL ELSE (d.n_chars % 97) / 96 END AS baseline_residual, coalesce(l.quality, 0) AS quality
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
METRICS_SQL = METRICS.replace(" / 100 AS", " / 100.0::double AS").replace(" / 88 AS", " / 88.0::double AS").replace(" / 66 AS", " / 66.0::double AS").replace(" / 10000 AS", " / 10000.0::double AS").replace(" / 96 END", " / 96.0::double END")
MAX_DIFF = {"HLA-DRB1": 0.35, "HLA-DPB1": 0.20, "HLA-DQB1": 0.50}


def case_sql(values: dict[str, float], default: float) -> str:
    return "CASE gene " + " ".join(f"WHEN '{g}' THEN {v}::double" for g, v in values.items()) + f" ELSE {default}::double END" if values else f"{default}::double"


def gate_sql(limit: str) -> str:
    escape = "(baseline_supported = 0 AND has_selected AND min_selected >= 0.0005::double)"
    return f"""SELECT *, concat_ws(';', CASE WHEN diff >= {limit} AND NOT {escape} THEN 'max_diff' END,
      CASE WHEN mask >= 0.4::double AND diff >= 0.35::double AND top_frac <= 0.42::double AND baseline_supported >= 3 THEN 'ambiguous_high_mask' END,
      CASE WHEN mask >= 0.4::double AND baseline_supported >= 4 AND baseline_residual - diff <= 0.001::double THEN 'high_mask_baseline_near_tie' END,
      CASE WHEN gene = 'HLA-A' AND diff >= 0.2::double AND top_frac <= 0.5::double AND baseline_supported >= 4 THEN 'class_i_high_em_residual' END,
      CASE WHEN has_selected AND min_selected < 0.0005::double AND diff >= 0.35::double THEN 'low_selected_support' END) AS kept, diff >= {limit} AND {escape} AS escaped"""


@query("em_gate", with_(
    "SELECT sample, gene, CASE WHEN kept <> '' THEN 'KEEP_BASELINE' ELSE 'OVERRIDE' END AS action, CASE WHEN kept = '' AND escaped THEN 'baseline_unsupported' ELSE kept END AS reasons FROM g",
    m=METRICS_SQL, g=gate_sql(case_sql(MAX_DIFF, 0.7)) + " FROM m"))
def em_gate(t: Tables) -> DataFrame:
    g = gates.em_gate(t.view(METRICS), gates.GateParams(overrides={"max_diff": MAX_DIFF}))
    return g.select(*GROUP, "action", F.array_join("reasons", ";").alias("reasons"))


@query("gate_profiles", with_(
    "SELECT profile, gene, count(*) AS n, count(*) FILTER (kept <> '') AS kept, sum(CASE WHEN kept = '' THEN quality ELSE 0 END)::bigint AS override_quality FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS profile, x.* FROM ({gate_sql(case_sql(over, 0.7))} FROM m) x" for name, over in gates.PROFILES.items()) + ") GROUP BY ALL", m=METRICS_SQL))
def gate_profiles(t: Tables) -> DataFrame:
    g = gates.replay_profiles(t.view(METRICS))
    keep = F.col("action") == "KEEP_BASELINE"
    return g.groupBy("profile", "gene").agg(F.count("*").alias("n"), F.count_if(keep).alias("kept"), F.sum(F.when(~keep, F.col("quality")).otherwise(0)).cast("bigint").alias("override_quality"))


def _calls(t: Tables, ranks: tuple[int, ...]) -> DataFrame:
    f = quartet.family_fractions(t.view(FAMILIES)).where(F.col("ord").isin(*ranks))
    hap = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("ord"))
    return f.select(*GROUP, hap.alias("global_hap"), F.when(hap <= 2, "R").otherwise("D").alias("assignment"), F.concat(F.lit("B*"), "family").alias("allele"))


@query("gate_metrics", with_(
    f"""SELECT c.sample, c.gene, {micro_sql('least(e.o1, e.o2, e.o3, e.o4)')} AS min_selected_micro, {micro_sql('least(c.o1, c.o2, c.o3, c.o4)')} AS baseline_min_micro,
      ((c.o1 >= 0.04)::int + (c.o2 >= 0.04)::int + (c.o3 >= 0.04)::int + (c.o4 >= 0.04)::int)::int AS baseline_supported,
      {micro_sql(residual_sql(['c.f1', 'c.f2', 'c.f3', 'c.f4'], ['c.o1', 'c.o2', 'c.o3', 'c.o4'], '1.0::double', 'chi_r'))} AS residual_micro FROM c JOIN e ON c.sample = e.sample AND c.gene = e.gene JOIN chi0 ON chi0.sample = c.sample""",
    fam=FAMILIES, chi0=CHI, fr=FRACTIONS, c=ranked_sql((9, 3, 12, 4)), e=ranked_sql((1, 15, 2, 7))))
def gate_metrics(t: Tables) -> DataFrame:
    f = quartet.family_fractions(t.view(FAMILIES))
    fractions = f.withColumn("family", F.concat(F.lit("B*"), "family"))
    summary = f.groupBy(*GROUP).agg(F.max("fraction").alias("top_frac")).join(t.view(CHI), "sample").select(*GROUP, F.lit(0.1).alias("sum_abs_diff"), "top_frac", F.col("chi_r").alias("chi_r_fit"))
    mask = summary.select(*GROUP, F.lit(0.1).alias("mean_mask_fraction"))
    m = gates.gate_metrics(summary, _calls(t, (1, 15, 2, 7)), _calls(t, (9, 3, 12, 4)), fractions, mask, baseline_min_frac=0.04)
    return m.select(*GROUP, micro("min_selected").alias("min_selected_micro"), micro("baseline_min").alias("baseline_min_micro"), "baseline_supported", micro("baseline_residual").alias("residual_micro"))


STRATEGY_ROWS = """SELECT event_type AS strategy, concat('set', cast(user_id % 4 as string)) AS set_, concat('g', cast(event_id % 6 as string)) AS gene, CASE event_id % 5 WHEN 0 THEN 'hold' WHEN 1 THEN 'skip' ELSE 'propose' END AS status,
  cast(user_id % 5 as int) - 2 AS delta, value AS gap, event_id % 7 > 0 AS changed, cast(event_id % 5 as int) AS current_score FROM {events}"""


@query("strategy_tallies", with_(
    """SELECT strategy, set_, gene, CASE WHEN grouping(set_) = 0 THEN 'set' WHEN grouping(gene) = 0 THEN 'gene' ELSE 'all' END AS scope, count(*) FILTER (status = 'propose') AS prop,
      count(*) FILTER (status = 'propose' AND delta > 0) AS imp, count(*) FILTER (status = 'propose' AND delta < 0) AS reg, count(*) FILTER (status = 'propose' AND delta = 0) AS neu,
      count(*) FILTER (status = 'hold') AS hold, count(*) FILTER (status = 'skip') AS skip, sum(CASE WHEN status = 'propose' THEN delta ELSE 0 END)::bigint AS net
    FROM s GROUP BY GROUPING SETS ((strategy), (strategy, set_), (strategy, gene))""", s=STRATEGY_ROWS))
def strategy_tallies(t: Tables) -> DataFrame:
    return tallies.strategy_tallies(t.view(STRATEGY_ROWS).withColumnRenamed("set_", "set")).withColumnRenamed("set", "set_")


@query("tau_sweep", with_(
    """SELECT strategy, tau, count(*) FILTER (st) AS prop, count(*) FILTER (st AND delta > 0) AS imp, count(*) FILTER (st AND delta < 0) AS reg, count(*) FILTER (st AND delta = 0) AS neu,
      count(*) FILTER (NOT st) AS hold, sum(CASE WHEN st THEN delta ELSE 0 END)::bigint AS net, (sum(current_score) + sum(CASE WHEN st THEN delta ELSE 0 END))::bigint AS after
    FROM (SELECT *, changed AND gap > tau AS st FROM s, (VALUES (0.0::double), (10.0), (50.0), (200.0)) v(tau)) GROUP BY ALL""", s=STRATEGY_ROWS))
def tau_sweep(t: Tables) -> DataFrame:
    return tallies.tau_sweep(t.view(STRATEGY_ROWS), [0.0, 10.0, 50.0, 200.0])


@query("gap_quantiles", with_(
    "SELECT strategy, " + ", ".join(f"{micro_sql(f'list_extract(l, (floor({p}::double * (n - 1)) + 1)::bigint)')} AS q{int(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99))
    + " FROM (SELECT strategy, list_sort(list(gap)) AS l, count(*) AS n FROM s GROUP BY ALL)", s=STRATEGY_ROWS))
def gap_quantiles(t: Tables) -> DataFrame:
    q = tallies.gap_quantiles(t.view(STRATEGY_ROWS))
    return q.select("strategy", *[micro(c).alias(c) for c in ("q50", "q75", "q90", "q95", "q99")])


# -------------------------------------------------------------------- class II

DPB1 = """SELECT concat('n', lpad(cast(s_nationkey as string), 2, '0')) AS sample, concat('DPB1*', cast(p_size * 5 as string), ':01') AS family, cast(sum(cast(l_quantity as int)) as double) AS weight
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2"""
DPB1_FR = "SELECT sample, 'HLA-DPB1' AS gene, family, weight, weight / sum(weight) OVER (PARTITION BY sample) AS fraction, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, family) AS ord FROM fm"
NUM = "cast(regexp_extract({a}, '[*]([0-9]+):', 1) as int)"


def dpb1(t: Tables, ranks: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    f = quartet.family_fractions(t.view(DPB1).withColumn("gene", F.lit("HLA-DPB1")))
    calls = f.groupBy(*GROUP).agg(F.array(*[F.max(F.when(F.col("ord") == r, F.col("family"))) for r in ranks]).alias("quartet")).withColumn("mask", F.lit(0.5))
    return calls, f


def dpb1_sql(ranks: tuple[int, ...]) -> dict[str, str]:
    return dict(fm=DPB1, fr=DPB1_FR, c="SELECT sample, gene, " + ", ".join(f"max(CASE WHEN ord = {r} THEN family END) AS f{i}" for i, r in enumerate(ranks, 1)) + " FROM fr GROUP BY ALL")


def _fold_sql(i: int, src: str) -> str:
    """One slot of the sequential replacement."""
    uses = " + ".join(f"(f{x} = k)::int" for x in range(1, 5))
    pick = f"(SELECT arg_min(k, o) FROM (SELECT family AS k, ord AS o FROM common x WHERE x.sample = s.sample) WHERE {uses} < 2)"
    cols = ", ".join(f"CASE WHEN {NUM.replace('{a}', f'f{x}')} >= 100 THEN coalesce({pick}, f{x}) ELSE f{x} END AS f{x}" if x == i else f"f{x}" for x in range(1, 5))
    return f"SELECT sample, gene, {cols} FROM {src} s"


RANKS = (1, 6, 17, 33)


@query("rare_collapse", with_(
    "SELECT sample, gene, f1 AS r1, f2 AS r2, f3 AS d1, f4 AS d2 FROM c4", **dpb1_sql(RANKS),
    common=f"SELECT sample, family, row_number() OVER (PARTITION BY sample ORDER BY ord) AS ord FROM fr WHERE {NUM.replace('{a}', 'family')} < 100 AND fraction >= 0.02::double QUALIFY row_number() OVER (PARTITION BY sample ORDER BY ord) <= 6",
    c1=_fold_sql(1, "c"), c2=_fold_sql(2, "c1"), c3=_fold_sql(3, "c2"), c4=_fold_sql(4, "c3")))
def rare_collapse(t: Tables) -> DataFrame:
    calls, f = dpb1(t, RANKS)
    return _slots(class2.dpb1_rare_collapse(calls, f))


def _slots(df: DataFrame, col: str = "proposed") -> DataFrame:
    return df.select(*GROUP, *[F.get(col, F.lit(i)).alias(n) for i, n in enumerate(("r1", "r2", "d1", "d2"))])


@query("common_minor", with_(
    f"""SELECT c.sample, c.gene, CASE WHEN m IS NULL THEN f1 WHEN keep1 THEN f1 ELSE m END AS r1, CASE WHEN m IS NULL THEN f2 WHEN keep1 THEN m ELSE f2 END AS r2, f3 AS d1, f4 AS d2 FROM (
      SELECT *, CASE WHEN regexp_extract(f1, '[*]([0-9]+):', 1) = regexp_extract(m, '[*]([0-9]+):', 1) THEN true WHEN regexp_extract(f2, '[*]([0-9]+):', 1) = regexp_extract(m, '[*]([0-9]+):', 1) THEN false ELSE o1 > o2 END AS keep1 FROM (
      SELECT c.*, (SELECT fraction FROM fr WHERE fr.sample = c.sample AND family = f1) AS o1, (SELECT fraction FROM fr WHERE fr.sample = c.sample AND family = f2) AS o2,
        (SELECT arg_min(family, ord) FROM fr WHERE fr.sample = c.sample AND ord <= 12 AND family NOT IN (f1, f2) AND {NUM.replace('{a}', 'family')} <= 60 AND fraction BETWEEN 0.005::double AND 0.09::double AND weight >= 50) AS m FROM c)) c""",
    **dpb1_sql((5, 2, 2, 5))))
def common_minor(t: Tables) -> DataFrame:
    calls, f = dpb1(t, (5, 2, 2, 5))
    return _slots(class2.dpb1_common_minor(class2.with_counts(calls, f), max_number=60))


@query("absolute_common", with_(
    """SELECT c.sample, c.gene, CASE WHEN slot = 1 THEN a ELSE f1 END AS r1, CASE WHEN slot = 2 THEN a ELSE f2 END AS r2, CASE WHEN slot = 3 THEN a ELSE f3 END AS d1, CASE WHEN slot = 4 THEN a ELSE f4 END AS d2 FROM c LEFT JOIN pick USING (sample)""",
    **dpb1_sql((40, 40, 40, 9)),
    slots="SELECT sample, i AS slot, CASE i WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END AS f, (i < 3)::int AS side FROM c, range(1, 5) r(i)",
    ok="SELECT s.*, coalesce(weight, 0) AS w FROM slots s JOIN (SELECT sample, f FROM slots GROUP BY ALL HAVING count(*) >= 3) x ON x.sample = s.sample AND x.f = s.f LEFT JOIN fr ON fr.sample = s.sample AND fr.family = s.f",
    tries=f"SELECT fr.sample, fr.family AS a, fr.ord, arg_min(ok.slot, (ok.side, ok.w, ok.slot)) AS slot FROM fr JOIN ok ON ok.sample = fr.sample JOIN c ON c.sample = fr.sample WHERE fr.family NOT IN (f1, f2, f3, f4) AND {NUM.replace('{a}', 'fr.family')} <= 100 AND fr.weight >= 150 AND fraction >= 0.01::double AND NOT (ok.w > 0 AND fr.weight < ok.w * 1.3::double) GROUP BY ALL",
    pick="SELECT sample, arg_min(a, ord) AS a, arg_min(slot, ord) AS slot FROM tries GROUP BY sample"))
def absolute_common(t: Tables) -> DataFrame:
    calls, f = dpb1(t, (40, 40, 40, 9))
    return _slots(class2.dpb1_absolute_common(class2.with_counts(calls, f, top=None), max_number=100, min_ratio=1.3))


LD = list(class2.DRB1_OF_DQB1)
LD_CALLS = "SELECT concat('o', cast(l_orderkey as string)) AS sample, " + ", ".join(
    f"CASE coalesce(max(CASE WHEN l_linenumber = {i} THEN l_partkey END), 0) % 7 " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in enumerate(LD)) + f" ELSE 'DQB1*05:01' END AS q{i}" for i in range(1, 5)) + ", max(l_discount) AS m FROM {lineitem} GROUP BY l_orderkey"


@query("linkage_anchor", with_(
    "SELECT sample, " + ", ".join(f"d{i}" for i in range(1, 5)) + " FROM (SELECT sample, m, " + ", ".join(
        f"CASE q{i} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in class2.DRB1_OF_DQB1.items()) + f" END AS d{i}" for i in range(1, 5))
    + " FROM c) WHERE m >= 0.06 AND d1 IS NOT NULL AND d2 IS NOT NULL AND d3 IS NOT NULL AND d4 IS NOT NULL", c=LD_CALLS))
def linkage_anchor(t: Tables) -> DataFrame:
    c = t.view(LD_CALLS)
    dq = c.select("sample", F.lit("HLA-DQB1").alias("gene"), F.array("q1", "q2", "q3", "q4").alias("quartet"), F.col("m").alias("mask"))
    dr = c.select("sample", F.lit("HLA-DRB1").alias("gene"), F.array(*[F.lit("DRB1*01:01")] * 4).alias("quartet"), F.col("m").alias("mask"))
    p = class2.drb1_from_dqb1(dq.unionByName(dr), min_mask=0.06)
    return p.select("sample", *[F.get("proposed", F.lit(i)).alias(f"d{i + 1}") for i in range(4)])
