"""Reranking queries: nations are samples, return flags are genes, part sizes are sites."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.operators import assembly, quartet, rerank
from quadhap.plans.quartets import CHI, FAMILIES, FRACTIONS, ranked_fit, ranked_sql, residual_sql
from quadhap.plans.registry import Tables, micro, micro_sql, query, with_

GROUP = ["sample", "gene"]
RANKS = (3, 1, 2, 5)
TOP = 6
NAMES = ("f1", "f2", "f3", "f4")


def families(t: Tables) -> DataFrame:
    return t.stage("families", lambda: t.view(FAMILIES))


def current(t: Tables) -> DataFrame:
    return t.stage("current", lambda: ranked_fit(t, RANKS, families(t)).select(*GROUP, "quartet"))


def pool(t: Tables) -> DataFrame:
    return t.stage("pool", lambda: rerank.candidates(current(t), None, families(t), TOP))


def spelled(df: DataFrame, *extra) -> DataFrame:
    return df.select(*GROUP, *[F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(NAMES)], *extra)


# Current slots first, then the remaining families by weight.
BASE = dict(
    fam=FAMILIES, chi0=CHI, fr=FRACTIONS, cur=ranked_sql(RANKS),
    cand=f"""SELECT sample, gene, family, row_number() OVER (PARTITION BY sample, gene ORDER BY CASE ord WHEN {RANKS[0]} THEN 0 WHEN {RANKS[1]} THEN 1 WHEN {RANKS[2]} THEN 2 WHEN {RANKS[3]} THEN 3 ELSE 10 + ord END) - 1 AS o, ord AS rk
      FROM fr WHERE ord <= {TOP}""",
    one=" UNION ALL ".join("SELECT sample, gene, " + ", ".join(f"family AS f{x}" if x == i else f"f{x}" for x in range(1, 5)) + f", {i - 1} * 100 + o AS ord FROM cur JOIN cand USING (sample, gene) WHERE family <> f{i}" for i in range(1, 5)),
    swap=" UNION ALL ".join("SELECT sample, gene, " + ", ".join(f"f{p + 1} AS f{i}" for i, p in enumerate(perm, 1)) + f", {n} AS ord FROM cur" for n, perm in enumerate(rerank.SIDE_SWAPS)),
)
KEY = "least(f1, f2) || '|' || greatest(f1, f2) || '/' || least(f3, f4) || '|' || greatest(f3, f4)"


def space_sql(src: str, keep_current: bool = False) -> str:
    """First quartet per order-free key; the current one last (if kept)."""
    rows = f"SELECT sample, gene, f1, f2, f3, f4, ord FROM {src}" + (" UNION ALL SELECT sample, gene, f1, f2, f3, f4, 1073741824 FROM cur" if keep_current else "")
    dedup = f"SELECT *, row_number() OVER (PARTITION BY sample, gene, k ORDER BY ord) AS r FROM (SELECT *, {KEY} AS k FROM ({rows}))"
    cond = "" if keep_current else " AND x.k <> c.k"
    return f"SELECT x.sample, x.gene, x.f1, x.f2, x.f3, x.f4, x.ord, x.k = c.k AS is_current FROM ({dedup}) x JOIN (SELECT sample, gene, {KEY} AS k FROM cur) c ON c.sample = x.sample AND c.gene = x.gene WHERE x.r = 1{cond}"


FULL = """SELECT sample, gene, r.fa AS f1, r.fb AS f2, d.fa AS f3, d.fb AS f4, ((r.i * 100 + r.j) * 10000 + d.i * 100 + d.j) AS ord FROM pr r JOIN pr d USING (sample, gene)"""
PAIRS = "SELECT a.sample, a.gene, a.o AS i, b.o AS j, a.family AS fa, b.family AS fb FROM cand a JOIN cand b ON a.sample = b.sample AND a.gene = b.gene AND a.o <= b.o"


@query("search_spaces", with_(
    "SELECT 'one' AS kind, sample, gene, f1, f2, f3, f4 FROM sp1 UNION ALL SELECT 'swap', sample, gene, f1, f2, f3, f4 FROM sp2 UNION ALL SELECT 'full', sample, gene, f1, f2, f3, f4 FROM sp3 UNION ALL SELECT 'private_one', sample, gene, f1, f2, f3, f4 FROM sp4",
    **BASE, pr=PAIRS, fullq=FULL, sp1=space_sql("one"), sp2=space_sql("swap"), sp3=space_sql("fullq"),
    priv=" UNION ALL ".join("SELECT sample, gene, " + ", ".join(f"family AS f{x}" if x == i else f"f{x}" for x in range(1, 5)) + f", {i} * 100 + rk AS ord FROM cur JOIN cand USING (sample, gene) JOIN chi0 USING (sample) WHERE family <> f{i} AND o{i} <= greatest(0.03::double, 0.25::double * {'chi_r' if i <= 2 else '(1 - chi_r)'} / 2)" for i in range(1, 5)),
    sp4=space_sql("priv")))
def search_spaces(t: Tables) -> DataFrame:
    out = None
    for kind in ("one", "swap", "full", "private_one"):
        s = spelled(rerank.search_space(kind, current(t), pool(t), families(t), t.view(CHI)), F.lit(kind).alias("kind"))
        out = s if out is None else out.unionByName(s)
    return out


SITES = """SELECT concat('n', lpad(cast(s_nationkey as string), 2, '0')) AS sample, l_returnflag AS gene, p_size AS site, sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) / count(*) AS af, count(*) * 3 AS dp
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3"""
# Genotype of a brand at a site, from their numbers; two in eleven are unknown.
GENO = """SELECT gene, site, family, CASE WHEN h < 5 THEN 0 WHEN h < 9 THEN 1 END AS g FROM (SELECT l_returnflag AS gene, p_size AS site, p_brand AS family, (cast(substr(p_brand, 7) as int) * 7 + p_size * 5 + cast(substr(p_brand, 7) as int) * p_size) % 11 AS h
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4) x"""
SITE_BASE = BASE | dict(
    st=SITES, ge=GENO,
    gk="SELECT ge.* FROM ge WHERE g IS NOT NULL",
    w="SELECT sample, gene, site, af, least(dp, 200)::double AS w FROM st",
)


def matrix(t: Tables) -> DataFrame:
    return t.stage("matrix", lambda: rerank.site_matrix(t.view(SITES), t.view(GENO), pool(t)))


def sited_sql(src: str, extra: str = "") -> str:
    joins = " ".join(f"JOIN gk g{i} ON g{i}.gene = q.gene AND g{i}.site = w.site AND g{i}.family = q.f{i}" for i in range(1, 5))
    return f"SELECT q.sample, q.gene, q.f1, q.f2, q.f3, q.f4, q.ord, q.is_current, w.site, w.w, w.af, 0.5::double * (g1.g + g2.g) AS r, 0.5::double * (g3.g + g4.g) AS d, chi_r FROM {src} q JOIN w ON w.sample = q.sample AND w.gene = q.gene {joins} JOIN chi0 ON chi0.sample = q.sample {extra}"


SCORE_SQL = {
    "af_l1": "sum(w * abs(af - p)) / (sum(w) + 1e-9)",
    "count_l1": "sum(abs(af * w - p * w))",
    "poisson_nll": "sum(p * w - af * w * ln(p * w + 1e-12))",
    "binom_nll": "sum(-(af * w * ln(p) + (w - af * w) * ln(1 - p)))",
}
CLIP = "greatest(0.005::double, least(0.995::double, r * chi + d * (1 - chi)))"


@query("site_scorers", with_(
    " UNION ALL ".join(f"SELECT '{n}' AS scorer, sample, gene, f1, f2, f3, f4, {micro_sql('v', '10000.0')} AS value_e4, {micro_sql('chi')} AS chi_micro, n FROM (SELECT *, row_number() OVER (PARTITION BY sample, gene, f1, f2, f3, f4 ORDER BY v, chi) AS o FROM (SELECT sample, gene, f1, f2, f3, f4, chi, round({e}, 12) AS v, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 10)) WHERE o = 1" for n, e in SCORE_SQL.items()),
    **SITE_BASE, q=space_sql("swap"), x=sited_sql("q"), p=f"SELECT *, {CLIP} AS p FROM (SELECT x.*, chi_r + k * 0.05::double AS chi FROM x, (VALUES (0), (1), (2)) v(k))"))
def site_scorers(t: Tables) -> DataFrame:
    q = t.stage("swap", lambda: rerank.search_space("swap", current(t), pool(t)))
    grid = current(t).join(t.view(CHI), "sample").select(*GROUP, F.array(*[F.col("chi_r") + k * F.lit(0.05) for k in range(3)]).alias("grid"))
    out = None
    for s in rerank.SCORERS:
        v = rerank.site_scores(q, matrix(t), t.view(CHI), s, chi_grid=grid, min_sites=10)
        v = spelled(v, F.lit(s).alias("scorer"), micro("value", 1e4).alias("value_e4"), micro("chi").alias("chi_micro"), "n")
        out = v if out is None else out.unionByName(v)
    return out


FRAGMENTS = "SELECT l_returnflag AS sample, 'g' AS gene, l_orderkey AS fragment, p_size - 1 AS site, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS allele FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
PHASE = dict(
    f=FRAGMENTS, o="SELECT sample, gene, fragment, site, min(allele) AS a FROM f GROUP BY ALL HAVING min(allele) = max(allele)",
    pc0="SELECT a.sample, a.gene, a.site AS i, b.site AS j, " + ", ".join(f"count(CASE WHEN a.a = {x} AND b.a = {y} THEN 1 END) AS n{x}{y}" for x in (0, 1) for y in (0, 1)) + " FROM o a JOIN o b ON a.sample = b.sample AND a.gene = b.gene AND a.fragment = b.fragment AND a.site < b.site GROUP BY ALL",
    pc="SELECT sample, gene, i, j, n00, n01, n10, n11 FROM pc0",
)


@query("phase_pairs", with_("SELECT * FROM pc", **PHASE))
def phase_pairs(t: Tables) -> DataFrame:
    c = rerank.phase_pair_counts(t.view(FRAGMENTS))
    return c.select("sample", "gene", "i", "j", "n00", "n01", "n10", "n11")


PHASE_FAM = "SELECT l_returnflag AS sample, 'g' AS gene, p_brand AS family, cast(sum(cast(l_quantity as int)) as double) AS weight FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3"
PHASE_CHI = "SELECT DISTINCT l_returnflag AS sample, cast(0.3 as double) AS chi_r FROM {lineitem}"
PHASE_GENO = GENO.replace("l_returnflag AS gene, p_size AS site", "'g' AS gene, p_size - 1 AS site")


@query("phase_likelihood", with_(
    f"""SELECT q.sample, q.gene, f1, f2, f3, f4, {micro_sql('sum(ll) / max(tot)')} AS value_micro, count(*) AS n FROM (SELECT *, -({' + '.join(f"n{a}{b} * ln(({' + '.join(f'CASE WHEN b{h} = {2 * a + b} THEN {0.15 if h <= 2 else 0.35}::double ELSE 0 END' for h in range(1, 5))} + 0.001::double) / 1.004::double)" for a in (0, 1) for b in (0, 1))}) AS ll FROM b) q
      JOIN (SELECT sample, sum(n00 + n01 + n10 + n11) AS tot FROM pc GROUP BY ALL) t ON t.sample = q.sample GROUP BY ALL HAVING count(*) >= 5""",
    **PHASE, fam=PHASE_FAM, chi0=PHASE_CHI, ge=PHASE_GENO, fr=FRACTIONS, cur=ranked_sql(RANKS), gk="SELECT site, family, g FROM ge WHERE g IS NOT NULL",
    cand=BASE["cand"], one=BASE["one"], sp=space_sql("one", True),
    b="SELECT sp.*, pc.n00, pc.n01, pc.n10, pc.n11, " + ", ".join(f"2 * x{h}.g + y{h}.g AS b{h}" for h in range(1, 5)) + " FROM sp JOIN pc ON pc.sample = sp.sample " + " ".join(
        f"JOIN gk x{h} ON x{h}.site = pc.i AND x{h}.family = sp.f{h} JOIN gk y{h} ON y{h}.site = pc.j AND y{h}.family = sp.f{h}" for h in range(1, 5))))
def phase_likelihood(t: Tables) -> DataFrame:
    fam = t.stage("phase_families", lambda: t.view(PHASE_FAM))
    f = quartet.family_fractions(fam)
    cur = f.groupBy(*GROUP).agg(F.array(*[F.max(F.when(F.col("ord") == r, F.col("family"))) for r in RANKS]).alias("quartet"))
    cands = t.stage("phase_pool", lambda: rerank.candidates(cur, None, fam, TOP))
    pairs = t.stage("phase_pairs", lambda: rerank.phase_pair_counts(t.view(FRAGMENTS)))
    ends = pairs.select(*GROUP, F.explode(F.array("i", "j")).alias("site")).distinct().withColumns({"af": F.lit(0.0), "dp": F.lit(1)})
    sites = rerank.site_matrix(ends, t.view(PHASE_GENO), cands)
    q = rerank.search_space("one", cur, cands, keep_current=True)
    v = rerank.phase_nll(q, rerank.phase_matrix(pairs, sites), t.view(PHASE_CHI))
    return spelled(v, micro("value").alias("value_micro"), "n")


EM_SQL = residual_sql(["f1", "f2", "f3", "f4"], ["o1", "o2", "o3", "o4"], "1.0::double", "chi_r")
CHANNELS = SITE_BASE | dict(
    q=space_sql("one", True), x=sited_sql("q"),
    dc="SELECT cand.sample, cand.gene, site FROM cand JOIN gk ON gk.gene = cand.gene AND gk.family = cand.family GROUP BY ALL HAVING count(DISTINCT g) = 2",
    af="SELECT sample, gene, f1, f2, f3, f4, round(sum(w * abs(af - (r * chi_r + d * (1 - chi_r)))) / (sum(w) + 1e-9), 12) AS af FROM x GROUP BY ALL HAVING count(*) >= 12",
    di="SELECT sample, gene, f1, f2, f3, f4, round(sum(w * abs(af - (r * chi_r + d * (1 - chi_r)))) / (sum(w) + 1e-9), 12) AS disc FROM x JOIN dc USING (sample, gene, site) GROUP BY ALL HAVING count(*) >= 10",
    em=f"SELECT q.sample, q.gene, f1, f2, f3, f4, ord, is_current, round({EM_SQL}, 12) AS em FROM (SELECT q.*, " + ", ".join(f"(SELECT fraction FROM fr WHERE fr.sample = q.sample AND fr.gene = q.gene AND fr.family = q.f{i}) AS o{i}" for i in range(1, 5)) + " FROM q) q JOIN chi0 ON chi0.sample = q.sample",
    ch="SELECT em.*, af.af, di.disc FROM em LEFT JOIN af USING (sample, gene, f1, f2, f3, f4) LEFT JOIN di USING (sample, gene, f1, f2, f3, f4)",
)


def channels(t: Tables) -> DataFrame:
    q = t.stage("one", lambda: rerank.search_space("one", current(t), pool(t), keep_current=True))
    return rerank.channel_table(q, families(t), t.view(CHI), matrix(t), min_sites=12)


@query("af_channels", with_(f"SELECT sample, gene, f1, f2, f3, f4, is_current, {micro_sql('em')} AS em_micro, {micro_sql('af')} AS af_micro, {micro_sql('disc')} AS disc_micro FROM ch", **CHANNELS))
def af_channels(t: Tables) -> DataFrame:
    return spelled(channels(t), "is_current", *[micro(c).alias(f"{c}_micro") for c in ("em", "af", "disc")])


@query("channel_gate", with_(
    f"""SELECT sample, gene, CASE WHEN bool_or(cem IS NULL OR caf IS NULL) THEN 'skip' WHEN bool_or(ok) THEN 'propose' ELSE 'hold' END AS status, {micro_sql('CASE WHEN bool_or(caf IS NULL) THEN NULL ELSE coalesce(max(CASE WHEN ok THEN gain END), 0) END')} AS gain_micro,
      CASE WHEN NOT bool_or(caf IS NULL) THEN arg_min(CASE WHEN ok THEN f1 || ',' || f2 || ',' || f3 || ',' || f4 END, CASE WHEN ok THEN (-gain, ord) END) END AS proposed
    FROM (SELECT ch.*, c.em AS cem, c.af AS caf, NOT ch.is_current AND coalesce(round(c.em - ch.em, 12) >= 0.01::double AND round(c.af - ch.af, 12) >= 0.0002::double, false) AS ok, round(c.em - ch.em + (c.af - ch.af), 12) AS gain
      FROM ch JOIN (SELECT sample, gene, em, af FROM ch WHERE is_current) c USING (sample, gene)) GROUP BY ALL""", **CHANNELS))
def channel_gate(t: Tables) -> DataFrame:
    rows = t.stage("channels", lambda: channels(t)).withColumn("space", F.lit("c0_one"))
    g = rerank.multi_channel_gate(rows, (("C0_one_EM_AF", "c0", "one", ("em", "af")),), {"em": 0.01, "af": 0.0002})
    return g.select(*GROUP, "status", micro("gain").alias("gain_micro"), F.array_join("proposed", ",").alias("proposed"))


DIST = "(4 - greatest((f1 = c1)::int + (f2 = c2)::int, (f1 = c2)::int + (f2 = c1)::int) - greatest((f3 = c3)::int + (f4 = c4)::int, (f3 = c4)::int + (f4 = c3)::int)) / 4.0::double"


@query("joint_score", with_(
    f"""SELECT sample, gene, CASE WHEN cur1 THEN 'hold_current_best' WHEN s2 - s1 < 0.04::double THEN 'hold_low_gap' ELSE 'propose' END AS status, {micro_sql('s1')} AS best_micro, {micro_sql('round(s2 - s1, 12)')} AS gap_micro, best FROM (
      SELECT sample, gene, bool_or(is_current) FILTER (r = 1) AS cur1, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, max(f1 || ',' || f2 || ',' || f3 || ',' || f4) FILTER (r = 1) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY sample, gene ORDER BY s, ord) AS r FROM (SELECT *, round((ne + coalesce(na, 0)) / CASE WHEN lo_af IS NULL THEN 1 ELSE 2 END + 0.04::double * {DIST}, 12) AS s FROM (
          SELECT ch.*, c1, c2, c3, c4, lo_af, (em - lo_em) / greatest(hi_em - lo_em, 1e-9) AS ne, coalesce((af - lo_af) / greatest(hi_af - lo_af, 1e-9), 0) AS na FROM ch
          JOIN (SELECT sample, gene, min(em) AS lo_em, quantile_cont(em, 0.75) AS hi_em, min(af) AS lo_af, quantile_cont(af, 0.75) AS hi_af FROM ch GROUP BY ALL) USING (sample, gene)
          JOIN (SELECT sample, gene, f1 AS c1, f2 AS c2, f3 AS c3, f4 AS c4 FROM cur) USING (sample, gene)))) GROUP BY sample, gene)""", **CHANNELS))
def joint_score(t: Tables) -> DataFrame:
    rows = t.stage("channels", lambda: channels(t)).join(current(t).select(*GROUP, F.col("quartet").alias("current")), GROUP)
    j = rerank.joint_score(rows, rerank.JointStrategy("one_position_repair", ("em", "af"), 0.04, 0.04))
    return j.select(*GROUP, "status", micro("best_score").alias("best_micro"), micro("gap").alias("gap_micro"), F.array_join("best", ",").alias("best"))


NEIGHBOURS = " UNION ALL ".join(
    ["SELECT sample, gene, f1, f2, f3, f4, 0 AS ord FROM cur"]
    + ["SELECT sample, gene, " + ", ".join(f"f{ {a: b, b: a}.get(i, i) + 1} AS f{i + 1}" for i in range(4)) + f", {n + 1} FROM cur" for n, (a, b) in enumerate(rerank.SLOT_SWAPS)]
    + ["SELECT sample, gene, " + ", ".join(f"family AS f{x}" if x == i else f"f{x}" for x in range(1, 5)) + f", {i} * 100 + row_number() OVER (PARTITION BY sample, gene ORDER BY family) FROM cur JOIN cand USING (sample, gene)" for i in range(1, 5)])


@query("dose_rerank", with_(
    f"""SELECT c.sample, c.gene, {micro_sql('n.pen')} AS best_micro, {micro_sql('n.cur_res')} AS current_micro, ch AS changed, CASE WHEN ch THEN n.q ELSE cq END AS best FROM (SELECT *, q <> cq AND round(cur_res - pen, 12) >= 0.01::double AS ch FROM (
      SELECT sample, gene, arg_min(q, (pen, ord)) AS q, min(pen) AS pen, max(CASE WHEN ord = 0 THEN res END) AS cur_res, max(CASE WHEN ord = 0 THEN q END) AS cq FROM s GROUP BY ALL)) n JOIN cur c USING (sample, gene)""",
    **BASE, nb=NEIGHBOURS,
    s=f"""SELECT *, round(res + CASE WHEN f1 = f2 AND f1 IN (f3, f4) THEN 0.02::double ELSE 0 END, 12) AS pen FROM (SELECT *, f1 || ',' || f2 || ',' || f3 || ',' || f4 AS q, round({EM_SQL}, 12) AS res FROM (SELECT nb.*, chi_r, """
    + ", ".join(f"(SELECT fraction FROM fr WHERE fr.sample = nb.sample AND fr.gene = nb.gene AND fr.family = nb.f{i}) AS o{i}" for i in range(1, 5)) + " FROM nb JOIN chi0 USING (sample)))"))
def dose_rerank(t: Tables) -> DataFrame:
    d = rerank.dose_rerank(current(t), families(t), t.view(CHI), pool(t), min_gain=0.01)
    return d.select(*GROUP, micro("best_residual").alias("best_micro"), micro("current_residual").alias("current_micro"), "changed", F.array_join("best", ",").alias("best"))


@query("quartet_af", with_(
    f"""SELECT sample, gene, f1, f2, f3, f4, {micro_sql('score')} AS score_micro, n::int AS n_sites FROM (SELECT *, row_number() OVER (PARTITION BY sample, gene ORDER BY score, i, j, k, m) AS r FROM (
      SELECT r.sample, r.gene, r.i, r.j, d.i AS k, d.j AS m, r.fa AS f1, r.fb AS f2, d.fa AS f3, d.fb AS f4,
        round(sum(r.w * abs(r.af - (0.5::double * r.g * chi_r + 0.5::double * d.g * (1 - chi_r)))) / sum(r.w), 12) AS score, count(*) AS n FROM pg r JOIN pg d USING (sample, gene, site) JOIN chi0 ON chi0.sample = r.sample GROUP BY ALL HAVING count(*) >= 5)) WHERE r = 1""",
    **SITE_BASE,
    gs="SELECT w.*, cand.family, gk.g FROM w JOIN cand ON cand.sample = w.sample AND cand.gene = w.gene JOIN gk ON gk.gene = w.gene AND gk.site = w.site AND gk.family = cand.family",
    mt="SELECT sample, gene, family, row_number() OVER (PARTITION BY sample, gene ORDER BY round(m, 9) DESC, family) AS rk FROM (SELECT sample, gene, family, sum(w * CASE WHEN g = 1 THEN af ELSE 1 - af END) AS m FROM gs GROUP BY ALL)",
    gr="SELECT gs.*, mt.rk FROM gs JOIN mt USING (sample, gene, family)",
    pg="SELECT a.sample, a.gene, a.site, a.w, a.af, a.rk AS i, b.rk AS j, a.family AS fa, b.family AS fb, a.g + b.g AS g FROM gr a JOIN gr b ON a.sample = b.sample AND a.gene = b.gene AND a.site = b.site AND a.rk <= b.rk"))
def quartet_af(t: Tables) -> DataFrame:
    f = rerank.fit_quartet_af(matrix(t), t.view(CHI), top_k_rows=1)
    return spelled(f, micro("score").alias("score_micro"), "n_sites")


SCORES = """SELECT concat('n', lpad(cast(s_nationkey as string), 2, '0')) AS sample, 'g' AS gene, l_linestatus AS ls, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS block, (l_linenumber - 1) % 4 + 1 AS hap, p_brand AS allele, cast(sum(cast(l_quantity as int)) as double) AS score
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5, 6"""
SCORE_CELLS = dict(
    sc=SCORES,
    pool="SELECT DISTINCT sample, allele FROM sc",
    cell="SELECT b.sample, b.block, h.hap, p.allele, coalesce(sc.score, 0) AS score FROM (SELECT DISTINCT sample, block FROM sc JOIN pool USING (sample, allele)) b JOIN pool p ON p.sample = b.sample, (VALUES (1), (2), (3), (4)) h(hap) LEFT JOIN sc ON sc.sample = b.sample AND sc.block = b.block AND sc.hap = h.hap AND sc.allele = p.allele".replace(", (VALUES", " CROSS JOIN (VALUES"),
    wide="SELECT sample, block, allele, " + ", ".join(f"max(CASE WHEN hap = {h} THEN score END) AS h{h}" for h in range(1, 5)) + " FROM cell GROUP BY ALL",
    pr="SELECT a.sample, a.allele AS x, b.allele AS y FROM pool a JOIN pool b ON a.sample = b.sample AND a.allele <= b.allele",
    combo="SELECT r.sample, r.x AS f1, r.y AS f2, d.x AS f3, d.y AS f4 FROM pr r JOIN pr d USING (sample)",
)


@query("paired_assembly", with_(
    f"""SELECT sample, f1, f2, f3, f4, score FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, f1, f2, f3, f4) AS r FROM (SELECT sample, f1, f2, f3, f4, sum(b)::bigint AS score FROM (
      SELECT c.*, w1.block, greatest({', '.join(' + '.join(f'w{p[h] + 1}.h{h + 1}' for h in range(4)) + f" - {10 * min(x for x in range(4) if p[x] < 2)}" for p in permutations(range(4)))}) AS b
      FROM combo c JOIN wide w1 ON w1.sample = c.sample AND w1.allele = f1 """ + " ".join(f"JOIN wide w{i} ON w{i}.sample = c.sample AND w{i}.block = w1.block AND w{i}.allele = f{i}" for i in range(2, 5)) + ") GROUP BY ALL)) WHERE r = 1",
    **SCORE_CELLS))
def paired_assembly(t: Tables) -> DataFrame:
    s = t.view(SCORES)
    # A split costs ten per position of its first recipient haplotype.
    cost = F.array(*[F.lit(10.0 * min(split)) for split, _ in assembly.SPLITS])
    penalties = s.select("sample", "gene", "block").distinct().withColumn("penalty", cost)
    a = assembly.assemble(s.select("sample", "gene", "block", "hap", "allele", "score"), penalties)
    return a.select("sample", *[F.get("quartet", F.lit(i)).alias(n) for i, n in enumerate(NAMES)], F.col("score").cast("bigint").alias("score"))


@query("unpaired_assembly", with_(
    f"""SELECT sample, f1, f2, f3, f4, score FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, f1, f2, f3, f4) AS r FROM (SELECT sample, f1, f2, f3, f4, sum(b)::bigint AS score FROM (
      SELECT c.*, w1.block, greatest({', '.join(' + '.join(f'w{p[h] + 1}.h{h + 1}' for h in range(4)) for p in permutations(range(4)))}) AS b
      FROM (SELECT * FROM combo WHERE f2 <= f3) c JOIN wide w1 ON w1.sample = c.sample AND w1.allele = f1 """ + " ".join(f"JOIN wide w{i} ON w{i}.sample = c.sample AND w{i}.block = w1.block AND w{i}.allele = f{i}" for i in range(2, 5)) + ") GROUP BY ALL)) WHERE r = 1",
    **SCORE_CELLS))
def unpaired_assembly(t: Tables) -> DataFrame:
    a = assembly.assemble(t.view(SCORES).select("sample", "gene", "block", "hap", "allele", "score"), paired=False)
    return a.select("sample", *[F.array_sort("quartet")[i].alias(n) for i, n in enumerate(NAMES)], F.col("score").cast("bigint").alias("score"))
