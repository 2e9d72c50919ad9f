"""Naming, call-table and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import names
from quadhap.operators import calls as cl
from quadhap.operators import class2, drb345, evaluate, gates
from quadhap.plans.registry import Tables, micro, micro_sql, query, with_
from quadhap.sources import sinks
from quadhap.sources.tables import parse_ggroups, prefer_sources

GROUP = ["sample", "gene"]

SPELLINGS = """SELECT p_partkey, concat(CASE WHEN p_partkey % 8 = 0 THEN 'HLA-' ELSE '' END, CASE WHEN p_partkey % 8 = 6 THEN 'B*' ELSE 'A*' END, lpad(cast(p_size as string), 2, '0'),
  CASE p_partkey % 8 WHEN 0 THEN concat(':', lpad(cast(p_partkey % 23 as string), 2, '0'), ':01N') WHEN 1 THEN concat(':', lpad(cast(p_partkey % 23 as string), 2, '0'), 'G')
    WHEN 2 THEN ':07:01P' WHEN 3 THEN ':09' WHEN 4 THEN ':02:01:02' WHEN 5 THEN ':N' WHEN 6 THEN '' ELSE ':03:01Q' END) AS a FROM {part}"""
CLEAN = "CASE WHEN a IS NULL OR a IN ('', 'NA') THEN 'NA' WHEN contains(a, '*') THEN regexp_replace(replace(a, 'HLA-', ''), '[A-FH-Za-z]$', '') ELSE a END"


def two_sql(base: str, fields: str) -> str:
    return f"CASE WHEN contains({base}, '*') THEN split_part({base}, '*', 1) || '*' || array_to_string(string_split({fields}, ':')[1:2], ':') ELSE {base} END"


def rest_sql(base: str) -> str:
    return f"substr({base}, instr({base}, '*') + 1)"


NO_HLA = "replace(trim(a), 'HLA-', '')"


@query("two_field_modes", with_(
    f"""SELECT p_partkey, c AS cleaned, {two_sql('c', f"replace({rest_sql('c')}, 'G', '')")} AS report, {two_sql('a', "split_part(a, '*', 2)")} AS em,
      {two_sql('h', f"regexp_replace({rest_sql('h')}, '[GP]+$', '')")} AS gate, {two_sql('r', f"regexp_replace({rest_sql('r')}, '(^|:)([A-Za-z]*)[A-Za-z]$', '\\1\\2')")} AS rescue,
      array_length(string_split(replace({rest_sql('c')}, 'G', ''), ':'))::int AS fields, coalesce(try_cast(regexp_extract(a, '[*]([0-9]+):', 1) as int), 999999) AS number
    FROM (SELECT *, {CLEAN} AS c, {NO_HLA} AS h, regexp_replace(replace({NO_HLA}, 'G', ''), 'P+$', '') AS r FROM s)""", s=SPELLINGS))
def two_field_modes(t: Tables) -> DataFrame:
    return t.view(SPELLINGS).select(
        "p_partkey", names.clean_allele("a").alias("cleaned"), *[names.two_field("a", m).alias(m) for m in ("report", "em", "gate", "rescue")],
        names.field_count("a").alias("fields"), names.allele_number("a").alias("number"))


TRUTH_CELLS = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'DRB345' ELSE 'DQB1' END AS g, CASE p_partkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN concat('03:', lpad(cast(p_size as string), 2, '0'), ':01') WHEN 2 THEN concat('5:', cast(p_size as string))
  WHEN 3 THEN concat('HLA-DRB4*01:', cast(p_size as string)) WHEN 4 THEN concat('07:', cast(p_size as string)) WHEN 5 THEN '04:' ELSE '-' END AS a FROM {part}"""


@query("truth_names", with_(
    """SELECT p_partkey, CASE WHEN g = 'DRB345' THEN 'HLA-DRB345' ELSE 'HLA-' || g END AS gene, CASE WHEN g <> 'DRB345' THEN CASE WHEN contains(a, '*') THEN replace(a, 'HLA-', '') ELSE g || '*' || a END
      WHEN a IN ('NA', '-', '') THEN 'NA' WHEN contains(a, '*') THEN replace(a, 'HLA-', '')
      WHEN regexp_matches(a, '^0?[345]:.') THEN 'DRB' || regexp_extract(a, '^0?([345]):', 1) || '*' || regexp_extract(a, '^[0-9]+:(.*)$', 1) ELSE 'DRB345*' || a END AS allele,
      CASE WHEN g = 'DRB345' AND regexp_matches(a, '^0?[345]:.') THEN 1 ELSE 0 END AS coded FROM s""", s=TRUTH_CELLS))
def truth_names(t: Tables) -> DataFrame:
    s = t.view(TRUTH_CELLS).withColumns({"gene": names.truth_gene("g"), "allele": names.truth_allele("g", "a")})
    coded = (F.col("g") == "DRB345") & F.col("allele").rlike(r"^DRB[345]\*") & ~F.contains(F.col("a"), F.lit("*"))
    return s.select("p_partkey", "gene", "allele", coded.cast("int").alias("coded"))


# Nomenclature lines: per family one group of two members, for every third a second group, for every fifth no group name.
FAMILY_KEYS = "SELECT DISTINCT lpad(cast(p_partkey % 40 + 1 as string), 2, '0') AS ss, lpad(cast(p_partkey % 6 as string), 2, '0') AS kk, p_partkey % 6 AS k FROM {part}"
LINES = f"""SELECT CASE WHEN k = 5 THEN concat('A*;', ss, ':', kk, ':01;') ELSE concat('A*;', ss, ':', kk, ':01/', ss, ':', kk, ':02;', ss, ':', kk, ':01G') END AS value FROM ({FAMILY_KEYS})
UNION ALL SELECT concat('A*;', ss, ':', kk, ':03;', ss, ':', kk, ':03G') AS value FROM ({FAMILY_KEYS}) WHERE k % 3 = 1 UNION ALL SELECT '# comment' AS value"""
GROUPS = """SELECT DISTINCT m AS member, grp FROM (SELECT 'A*' || ss || ':' || kk || ':' || x AS m, CASE WHEN k = 5 THEN 'A*' || ss || ':' || kk || ':01' ELSE 'A*' || ss || ':' || kk || ':01G' END AS grp FROM fk, (VALUES ('01'), ('02'), ('01G')) v(x) WHERE k <> 5 OR x = '01'
  UNION ALL SELECT 'A*' || ss || ':' || kk || ':' || x, 'A*' || ss || ':' || kk || ':03G' FROM fk, (VALUES ('03'), ('03G')) v(x) WHERE k % 3 = 1)"""


def groups(t: Tables) -> DataFrame:
    return parse_ggroups(t.view(LINES))


@query("ggroup_table", with_("SELECT * FROM gg", fk=FAMILY_KEYS, gg=GROUPS))
def ggroup_table(t: Tables) -> DataFrame:
    return groups(t).select("member", "grp")


@query("prefix_groups", with_(
    """SELECT prefix, count(DISTINCT grp) AS groups, min(grp) AS grp FROM (SELECT grp, array_to_string(string_split(member, ':')[1:i], ':') AS prefix FROM (
      SELECT *, unnest(range(1, length(member) - length(replace(member, ':', '')) + 1)) AS i FROM gg WHERE NOT ends_with(member, 'G'))) GROUP BY prefix""", fk=FAMILY_KEYS, gg=GROUPS))
def prefix_groups(t: Tables) -> DataFrame:
    return evaluate.prefix_groups(groups(t)).select("prefix", "groups", "grp")


def allele_of(x: str) -> str:
    return f"""concat('A*', lpad(cast(({x}) % 40 + 1 as string), 2, '0'), ':', lpad(cast(({x}) % 6 as string), 2, '0'), CASE ({x}) % 7 WHEN 0 THEN '' WHEN 1 THEN ':01' WHEN 2 THEN ':02' WHEN 3 THEN ':03' WHEN 4 THEN ':01G' WHEN 5 THEN ':01:05' ELSE 'N' END)"""


REPORT2 = two_sql("c", f"replace({rest_sql('c')}, 'G', '')")
# G group of a cleaned allele: itself when it is one, else the first listed name found.
GROUP_OF = """CASE WHEN ends_with(c, 'G') OR NOT contains(c, '*') THEN c ELSE coalesce((SELECT grp FROM gg WHERE member = c), CASE WHEN nf IN (2, 3) THEN (SELECT grp FROM gg WHERE member = c || ':01') END,
  CASE WHEN nf = 2 THEN (SELECT grp FROM gg WHERE member = c || ':01:01') END, c) END"""


def named_sql(source: str, keys: str) -> str:
    """Cleaned name, family and G group of column ``a``."""
    return f"SELECT {keys}, a, c, {REPORT2} AS fam, nf, {GROUP_OF} AS grp FROM (SELECT *, array_length(string_split({rest_sql('c')}, ':')) AS nf FROM (SELECT *, {CLEAN} AS c FROM {source}))"


PART_ALLELES = f"SELECT p_partkey, {allele_of('p_partkey * 3')} AS a FROM {{part}}"


@query("ggroup_lookup", with_("SELECT p_partkey, a, grp FROM n", fk=FAMILY_KEYS, gg=GROUPS, s=PART_ALLELES, n=named_sql("s", "p_partkey")))
def ggroup_lookup(t: Tables) -> DataFrame:
    return cl.attach_ggroup(t.view(PART_ALLELES), "a", groups(t), "grp").select("p_partkey", "a", "grp")


SLOT_NAMES = (("R1", "PATIENT"), ("R2", "PATIENT"), ("D1", "DONOR"), ("D2", "DONOR"))
FINAL = "SELECT concat('o', cast(o_orderkey as string)) AS sample, 'HLA-A' AS gene, " + ", ".join(f"{allele_of(f'o_custkey + {7 * i} * o_orderkey')} AS {s}_report" for i, (s, _) in enumerate(SLOT_NAMES)) + " FROM {orders}"
TRUTH = " UNION ALL ".join(
    f"SELECT concat('o', cast(o_orderkey as string)) AS sample, '{side}' AS side, 'HLA-A' AS gene, {allele_of(f'o_custkey + {7 * (i ^ 1)} * o_orderkey + CASE WHEN o_orderkey % 4 = {i} THEN 42 WHEN o_orderkey % 5 = {i} THEN 40 ELSE 0 END')} AS allele FROM {{orders}}"
    for i, (_, side) in enumerate(SLOT_NAMES))
EVAL = dict(
    fk=FAMILY_KEYS, gg=GROUPS, fin=FINAL, tr=TRUTH,
    p0=" UNION ALL ".join(f"SELECT sample, '{side}' AS side, gene, {s}_report AS a FROM fin" for s, side in SLOT_NAMES),
    t0="SELECT sample, side, gene, allele AS a FROM tr",
    p=named_sql("p0", "sample, side, gene"), t1=named_sql("t0", "sample, side, gene"),
    pg="SELECT prefix, count(DISTINCT grp) AS n FROM (SELECT grp, array_to_string(string_split(member, ':')[1:2], ':') AS prefix FROM gg WHERE NOT ends_with(member, 'G') AND length(member) - length(replace(member, ':', '')) >= 2) GROUP BY prefix",
    t="SELECT sample, side, gene, fam, CASE WHEN up THEN 'g_group' ELSE '2field' END AS lv, CASE WHEN up THEN grp ELSE fam END AS target FROM (SELECT t1.*, NOT (fc = 2 AND coalesce(n, 0) <> 1) AND (ends_with(c, 'G') OR grp <> c OR fc >= 3) AS up "
      f"FROM (SELECT *, array_length(string_split(replace({rest_sql('c')}, 'G', ''), ':')) AS fc FROM t1) t1 LEFT JOIN pg ON pg.prefix = c)",
)


@query("evaluate_two_field", with_(
    """SELECT k.sample, k.side, k.gene, coalesce(h.hits, 0) AS hits, k.total, coalesce(h.hits, 0) <> k.total AS mismatch, k.truth, q.pred FROM (SELECT sample, side, gene, count(*) AS total, string_agg(fam, ',' ORDER BY fam) AS truth FROM t GROUP BY ALL) k
    JOIN (SELECT sample, side, gene, string_agg(fam, ',' ORDER BY fam) AS pred FROM p GROUP BY ALL) q USING (sample, side, gene)
    LEFT JOIN (SELECT sample, side, gene, sum(least(a.n, b.n))::bigint AS hits FROM (SELECT sample, side, gene, fam, count(*) AS n FROM t GROUP BY ALL) a JOIN (SELECT sample, side, gene, fam, count(*) AS n FROM p GROUP BY ALL) b USING (sample, side, gene, fam) GROUP BY ALL) h USING (sample, side, gene)""", **EVAL))
def evaluate_two_field(t: Tables) -> DataFrame:
    e = evaluate.evaluate_calls(evaluate.long_calls(t.view(FINAL)), t.view(TRUTH), groups(t), ("2field",))
    return e.select("sample", "side", "gene", "hits", "total", "mismatch", "truth", "pred")


@query("evaluate_g_group", with_(
    """SELECT k.sample, k.side, k.gene, coalesce(h.hits, 0) AS hits, k.total, k.truth FROM (SELECT sample, side, gene, count(*) AS total, string_agg(target, ',' ORDER BY target) AS truth FROM t GROUP BY ALL) k
    LEFT JOIN (SELECT sample, side, gene, sum(least(a.n, b.n))::bigint AS hits FROM (SELECT sample, side, gene, lv, target, count(*) AS n FROM t GROUP BY ALL) a
      JOIN (SELECT sample, side, gene, lv, target, count(*) AS n FROM (SELECT sample, side, gene, '2field' AS lv, fam AS target FROM p UNION ALL SELECT sample, side, gene, 'g_group', grp FROM p) GROUP BY ALL) b USING (sample, side, gene, lv, target) GROUP BY ALL) h USING (sample, side, gene)""", **EVAL))
def evaluate_g_group(t: Tables) -> DataFrame:
    e = evaluate.evaluate_calls(evaluate.long_calls(t.view(FINAL)), t.view(TRUTH), groups(t), ("g_group",))
    return e.select("sample", "side", "gene", "hits", "total", "truth")


LONG = f"""SELECT concat('o', cast(l_orderkey as string)) AS sample, 'HLA-A' AS gene, l_linenumber AS global_hap, CASE WHEN l_linenumber <= 2 THEN 'R' WHEN l_linenumber <= 5 THEN 'D' ELSE '?' END AS assignment,
  {allele_of('p')} AS allele, CASE WHEN l_linenumber <= 2 THEN cast(0.1 as double) ELSE cast(0.4 as double) END AS hap_fraction, bool_ AS refined
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) % 2 = 0 AS bool_ FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) x"""
TF = f"""SELECT sample, gene, concat('A*', lpad(cast(p % 40 + 1 as string), 2, '0'), ':', lpad(cast(p % 6 as string), 2, '0')) AS family, cast(sum(q) as double) AS weight FROM (
  SELECT concat('o', cast(l_orderkey as string)) AS sample, 'HLA-A' AS gene, l_partkey AS p, cast(l_quantity as int) AS q FROM {{lineitem}} WHERE l_returnflag <> 'N') x GROUP BY 1, 2, 3"""
GRID = "SELECT concat('o', cast(o_orderkey as string)) AS sample, 'HLA-A' AS gene, (o_orderkey % 50) / 100 AS mean_mask_fraction, cast(0.3 as double) AS chi_r FROM {orders}"
SLOTS = cl.SLOTS


def final(t: Tables) -> DataFrame:
    f = t.view(TF)
    f = f.withColumn("fraction", F.col("weight") / F.sum("weight").over(Window.partitionBy(*GROUP)))
    grid = t.view(GRID)
    return cl.aggregate_calls(t.view(LONG), grid, groups(t), f, grid, grid.select("sample", "chi_r"))


FINAL_SQL = dict(
    fk=FAMILY_KEYS, gg=GROUPS, lg=LONG, tf=TF, grid=GRID.replace("/ 100", "/ 100.0::double"),
    num="SELECT *, assignment || cast(row_number() OVER (PARTITION BY sample, assignment ORDER BY global_hap) as varchar) AS slot FROM lg WHERE assignment IN ('R', 'D')",
    s0="SELECT sample, slot, allele AS a, hap_fraction FROM num WHERE slot IN ('R1', 'R2', 'D1', 'D2')", s1=named_sql("s0", "sample, slot, hap_fraction"),
    fr="SELECT sample, family, weight, weight / sum(weight) OVER (PARTITION BY sample) AS fraction FROM tf",
    s2="SELECT s1.*, CASE WHEN h.sample IS NOT NULL THEN coalesce(fr.fraction, 0) END AS rf, CASE WHEN h.sample IS NOT NULL THEN coalesce(fr.weight, 0) END AS rc FROM s1 LEFT JOIN (SELECT DISTINCT sample FROM tf) h ON h.sample = s1.sample LEFT JOIN fr ON fr.sample = s1.sample AND fr.family = s1.fam",
    w="SELECT sample, " + ", ".join(f"max(CASE WHEN slot = '{x}' THEN {src} END) AS {x}_{c}" for c, src in (("full", "a"), ("2field", "fam"), ("g_group", "grp"), ("fraction", "hap_fraction"), ("rf", "rf"), ("rc", "rc")) for x in SLOTS) + " FROM s2 GROUP BY ALL",
    rfd="SELECT sample, bool_or(refined) AS refined FROM lg GROUP BY ALL",
)


@query("final_calls", with_(
    "SELECT g.sample, g.gene, " + ", ".join(f"{x}_full" for x in SLOTS) + ", " + ", ".join(f"CASE WHEN r.sample IS NULL THEN '' ELSE {x}_{c} END AS {x}_{c}" for c in ("2field", "g_group") for x in SLOTS) + ", "
    + ", ".join(f"CASE WHEN r.sample IS NULL THEN '' WHEN mean_mask_fraction >= 0.15::double THEN {x}_2field ELSE {x}_full END AS {x}_report" for x in SLOTS) + ", "
    + ", ".join(f"{micro_sql(f'{x}_fraction')} AS {x}_fraction, {micro_sql(f'{x}_rf')} AS {x}_read_fraction, {x}_rc::bigint AS {x}_read_count" for x in SLOTS)
    + f""", CASE WHEN r.sample IS NULL THEN 'missing' WHEN refined THEN 'em-refined' ELSE 'baseline' END AS source, CASE WHEN r.sample IS NOT NULL THEN {micro_sql('mean_mask_fraction')} END AS mask_micro,
      CASE WHEN r.sample IS NULL THEN 'missing' WHEN mean_mask_fraction >= 0.15::double THEN '2-field' ELSE 'full' END AS report_level,
      CASE WHEN r.sample IS NULL THEN 'missing_calls_tsv' WHEN mean_mask_fraction >= 0.15::double THEN 'high_mask_report_2field' ELSE '' END AS warning
    FROM grid g LEFT JOIN rfd r ON r.sample = g.sample LEFT JOIN w ON w.sample = g.sample""", **FINAL_SQL))
def final_calls(t: Tables) -> DataFrame:
    f = final(t)
    return f.select(
        *GROUP, *[f"{x}_{c}" for c in ("full", "2field", "g_group", "report") for x in SLOTS],
        *[micro(f"{x}_{c}").alias(f"{x}_{c}") for c in ("fraction", "read_fraction") for x in SLOTS], *[F.col(f"{x}_read_count").cast("bigint").alias(f"{x}_read_count") for x in SLOTS],
        "source", micro("mean_mask_fraction").alias("mask_micro"), "report_level", "warning")


@query("copy_fractions")
def copy_fractions(t: Tables) -> DataFrame:
    f = final(t)
    return f.select(*GROUP, *[micro(f"{x}_copy_fraction_fit").alias(f"{x}_copy") for x in SLOTS], micro("copy_fit_error", 1e8).alias("error"), "copy_identifiability", micro("copy_chi_r").alias("chi"))


@query("compact_calls", with_(
    "SELECT g.sample, g.gene, " + ", ".join(f"CASE WHEN r.sample IS NULL THEN NULL WHEN mean_mask_fraction >= 0.15::double THEN {x}_2field ELSE {x}_full END AS {x}_allele" for x in SLOTS)
    + " FROM grid g LEFT JOIN rfd r ON r.sample = g.sample LEFT JOIN w ON w.sample = g.sample", **FINAL_SQL))
def compact_calls(t: Tables) -> DataFrame:
    return cl.compact_calls(final(t)).select(*GROUP, *[f"{x}_allele" for x in SLOTS])


HITS = """SELECT l_returnflag AS sample, l_linestatus AS gene, l_linenumber AS global_hap, concat('A*', lpad(cast(l_suppkey % 50 as string), 2, '0'), ':01:01') AS allele, cast(l_quantity as int) AS bitscore, cast(round(l_discount * 100) as int) AS pident, cast(l_partkey % 97 as int) AS length FROM {lineitem}"""


@query("best_exon_hit", with_(
    """SELECT sample, gene, global_hap, allele AS exon_best, substr(allele, 1, 7) AS exon_2field, bits AS score, len AS aligned_len, CASE WHEN global_hap <= 2 THEN 'R' ELSE 'D' END AS assignment FROM (SELECT *, row_number() OVER (PARTITION BY sample, gene, global_hap ORDER BY bits DESC, ident DESC, len DESC, allele) AS r FROM (
      SELECT sample, gene, global_hap, allele, sum(bitscore)::bigint AS bits, sum(pident * length)::bigint AS ident, sum(length)::bigint AS len FROM h GROUP BY ALL)) WHERE r = 1""", h=HITS))
def best_exon_hit(t: Tables) -> DataFrame:
    b = cl.best_exon_hit(t.view(HITS))
    return b.select("sample", "gene", "global_hap", "exon_best", "exon_2field", "score", "aligned_len", "assignment")


LIFT_Q = "SELECT concat('o', cast(o_orderkey as string)) AS sample, 'g' AS gene, " + ", ".join(f"concat('F', cast((o_custkey + {i} * (o_orderkey % 3)) % 5 as string)) AS f{i}" for i in range(1, 5)) + " FROM {orders}"
LIFT_OPT = "SELECT concat('o', cast(l_orderkey as string)) AS sample, 'g' AS gene, concat('F', cast(l_partkey % 5 as string)) AS family, concat('F', cast(l_partkey % 5 as string), ':', cast(l_partkey as string)) AS allele, max(l_suppkey * 10 + l_linenumber) AS ord FROM {lineitem} GROUP BY 1, 2, 3, 4"


@query("lift_alleles", with_(
    "SELECT sample, " + ", ".join(f"max(CASE WHEN p = {i} THEN coalesce(x, f) END) AS a{i}" for i in range(1, 5)) + """ FROM (SELECT u.sample, p, f, (SELECT arg_max(allele, n) FROM (SELECT o.allele, o.n FROM onum o WHERE o.sample = u.sample AND o.family = u.f AND o.n <= u.nth)) AS x FROM u) GROUP BY sample""",
    q=LIFT_Q, o0=LIFT_OPT, onum="SELECT sample, family, allele, row_number() OVER (PARTITION BY sample, family ORDER BY ord, allele) AS n FROM o0",
    u0=" UNION ALL ".join(f"SELECT sample, {i} AS p, f{i} AS f FROM q" for i in range(1, 5)), u="SELECT *, row_number() OVER (PARTITION BY sample, f ORDER BY p) AS nth FROM u0"))
def lift_alleles(t: Tables) -> DataFrame:
    q = t.view(LIFT_Q).select(*GROUP, F.array("f1", "f2", "f3", "f4").alias("quartet"))
    out = gates.lift_alleles(q, t.view(LIFT_OPT))
    return out.select("sample", *[F.get("lifted", F.lit(i)).alias(f"a{i + 1}") for i in range(4)])


@query("upsert_calls", """SELECT c_custkey AS k, c_mktsegment AS v, 'old' AS source, '' AS warning FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier)
  UNION ALL SELECT s_suppkey * 3, s_name, 'rescue', CASE WHEN s_suppkey % 2 = 0 THEN 'w;late' ELSE 'late' END FROM supplier""")
def upsert_calls(t: Tables) -> DataFrame:
    old = t.view("SELECT c_custkey AS k, c_mktsegment AS v, 'old' AS source, '' AS warning FROM {customer}")
    new = t.view("SELECT s_suppkey * 3 AS k, s_name AS v, CASE WHEN s_suppkey % 2 = 0 THEN 'w' ELSE '' END AS warning FROM {supplier}")
    return sinks.upsert(old, new, ["k"], source="rescue", warning="late").select("k", "v", "source", "warning")


@query("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resume_pending(t: Tables) -> DataFrame:
    done = t.view("SELECT DISTINCT l_orderkey AS o_orderkey FROM {lineitem} WHERE l_returnflag = 'R'")
    inputs = t.view("SELECT DISTINCT l_orderkey AS o_orderkey FROM {lineitem} WHERE l_linestatus = 'F'")
    return sinks.pending(t.orders.select("o_orderkey"), done, ["o_orderkey"], inputs)


ROOTS = "SELECT l_orderkey, l_linenumber, l_partkey, cast(l_suppkey % 3 as int) AS source_rank FROM {lineitem}"


@query("preferred_source", with_("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, min(source_rank) OVER (PARTITION BY l_orderkey) AS b FROM r) WHERE b = source_rank", r=ROOTS))
def preferred_source(t: Tables) -> DataFrame:
    return prefer_sources(t.view(ROOTS), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


STACK = "SELECT concat('o', cast(o_orderkey as string)) AS sample, 'g' AS gene, o_orderstatus AS a, o_orderpriority AS b, o_orderkey % 2 = 0 AS d, o_orderkey % 3 = 0 AS l, o_orderkey % 5 = 0 AS r FROM {orders}"


@query("strategy_stack", with_("SELECT sample, CASE WHEN r THEN 'rare' WHEN l THEN 'ld' WHEN d THEN 'direct' ELSE 'current' END AS reason, CASE WHEN r THEN a || 'r' WHEN l THEN b WHEN d THEN a || b ELSE a END AS first_slot FROM s", s=STACK))
def strategy_stack(t: Tables) -> DataFrame:
    s = t.view(STACK)
    call = lambda c: F.array(c, F.lit("x"))
    current = s.select(*GROUP, call(F.col("a")).alias("quartet"))
    props = [("direct", s.where("d").select(*GROUP, call(F.concat("a", "b")).alias("proposed"))), ("ld", s.where("l").select(*GROUP, call(F.col("b")).alias("proposed"))),
             ("rare", s.where("r").select(*GROUP, call(F.concat("a", F.lit("r"))).alias("proposed")))]
    return class2.stack_strategies(current, props).select("sample", "reason", F.get("chosen", F.lit(0)).alias("first_slot"))


CONSIST = "SELECT concat('o', cast(l_orderkey as string)) AS sample, concat('DRB1*', CASE l_partkey % 6 WHEN 0 THEN '03' WHEN 1 THEN '04' WHEN 2 THEN '15' WHEN 3 THEN '11' WHEN 4 THEN '07' ELSE '01' END, ':', lpad(cast(l_partkey % 9 as string), 2, '0')) AS family, cast(sum(cast(l_quantity as int)) as double) AS weight FROM {lineitem} GROUP BY 1, 2"


def _fix_sql(i: int, src: str) -> str:
    locus = "CASE WHEN substr({a}, 6, 2) IN ('03', '11') THEN 'DRB3' WHEN substr({a}, 6, 2) IN ('04', '07') THEN 'DRB4' WHEN substr({a}, 6, 2) = '15' THEN 'DRB5' ELSE 'absent' END"
    pick = f"(SELECT arg_min(family, o) FROM opt WHERE opt.sample = s.sample AND opt.locus = w{i} AND family <> f1 AND family <> f2 AND family <> f3 AND family <> f4)"
    cols = ", ".join(f"CASE WHEN w{i} <> 'absent' AND {locus.replace('{a}', f'f{i}')} <> w{i} THEN coalesce({pick}, f{i}) ELSE f{i} END AS f{i}" if x == i else f"f{x}" for x in range(1, 5))
    return f"SELECT sample, w1, w2, w3, w4, {cols} FROM {src} s"


@query("locus_consistency", with_(
    "SELECT sample, f1, f2, f3, f4 FROM c4", fm=CONSIST,
    opt="SELECT sample, family, CASE WHEN substr(family, 6, 2) IN ('03', '11') THEN 'DRB3' WHEN substr(family, 6, 2) IN ('04', '07') THEN 'DRB4' WHEN substr(family, 6, 2) = '15' THEN 'DRB5' ELSE 'absent' END AS locus, row_number() OVER (PARTITION BY sample ORDER BY weight DESC, family) AS o FROM fm",
    c0="SELECT sample, 'DRB3' AS w1, 'DRB4' AS w2, 'absent' AS w3, 'DRB5' AS w4, arg_min(family, o) AS f1, arg_min(family, o) AS f2, arg_max(family, o) AS f3, 'DRB1*01:01' AS f4 FROM opt GROUP BY sample HAVING count(CASE WHEN locus <> 'absent' THEN 1 END) > 0",
    c1=_fix_sql(1, "c0"), c2=_fix_sql(2, "c1"), c3=_fix_sql(3, "c2"), c4=_fix_sql(4, "c3")))
def locus_consistency(t: Tables) -> DataFrame:
    f = t.view(CONSIST).repartition("sample")  # one exchange for all that is asked of a sample
    order = F.struct(-F.col("weight"), F.col("family"))
    cur = f.groupBy("sample").agg(F.array(F.min_by("family", order), F.min_by("family", order), F.max_by("family", order), F.lit("DRB1*01:01")).alias("quartet"))
    want = cur.select("sample", F.array(*[F.lit(x) for x in ("DRB3*01:01", "DRB4*01:01", "NA", "DRB5*01:01")]).alias("quartet"))
    out = drb345.drb345_consistency(cur, want, f)
    return out.select("sample", *[F.get("new", F.lit(i)).alias(f"f{i + 1}") for i in range(4)])
