"""Site queries: line items play variant sites, suppliers play samples or genes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.operators import sites as st
from quadhap.plans.registry import Tables, micro, micro_sql, plain, query, with_

AF_SITES = """SELECT concat('s', cast(l_suppkey as string)) AS sample, l_returnflag AS chrom, 'T' AS alt, cast(l_quantity as int) + 20 AS ro,
  cast(l_linenumber * 2 + round(l_discount * 100) as int) AS ao FROM {lineitem}"""

# Histogram bins compared with the edges i*0.01 themselves.
HIST = dict(
    s=AF_SITES,
    f="SELECT sample, chrom, ao / (ro + ao) AS af FROM s WHERE ro + ao >= 30 AND ao / (ro + ao) BETWEEN 0.005 AND 0.995",
    x="SELECT sample, chrom, least(af, 1.0::double - af) AS v FROM f",
    b="SELECT sample, chrom, least(49, CASE WHEN v < k * 0.01::double THEN k - 1 WHEN v >= (k + 1) * 0.01::double THEN k + 1 ELSE k END) AS bin FROM (SELECT *, floor(v / 0.01::double)::int AS k FROM x)",
    g="SELECT sample, chrom, bin FROM b UNION ALL SELECT sample, 'all', bin FROM b",
    h="SELECT sample, chrom, bin, count(*) AS n FROM g GROUP BY ALL",
    dense="SELECT k.sample, k.chrom, i AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample, chrom FROM h) k CROSS JOIN range(0, 50) r(i) LEFT JOIN h ON h.sample = k.sample AND h.chrom = k.chrom AND h.bin = i",
    sm="SELECT *, n + coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0) AS s3 FROM dense WINDOW w AS (PARTITION BY sample, chrom ORDER BY bin)",
    pk="SELECT *, lag(s3) OVER w AS a, lead(s3) OVER w AS c, max(s3) OVER (PARTITION BY sample, chrom) AS top FROM sm WINDOW w AS (PARTITION BY sample, chrom ORDER BY bin)",
)


@query("chi_histogram", with_(
    f"""SELECT sample, chrom, sum(n)::bigint AS n_af, {micro_sql('2 * min(CASE WHEN bin BETWEEN 2 AND 48 AND s3 >= a AND s3 >= c AND s3 >= top * 0.15::double THEN bin + 0.5 END) * 0.01')} AS chi_micro,
    count(CASE WHEN bin BETWEEN 2 AND 48 AND s3 >= a AND s3 >= c AND s3 >= top * 0.15::double THEN 1 END)::int AS n_peaks FROM pk GROUP BY sample, chrom""", **HIST))
def chi_histogram(t: Tables) -> DataFrame:
    chi = st.chi_from_pooled_af(st.pooled_af(t.view(AF_SITES)), per_chrom=True)
    return chi.select("sample", F.coalesce("chrom", F.lit("all")).alias("chrom"), "n_af", micro("chi_r").alias("chi_micro"), F.size("peaks").alias("n_peaks"))


OBS = """SELECT concat('s', cast(l_suppkey as string)) AS sample, l_linestatus AS gene, l_linenumber % 2 AS g0, cast(floor(l_linenumber / 2) as int) % 2 AS g1, cast(floor(l_linenumber / 4) as int) % 2 AS g2,
  cast(l_partkey % 2 as int) AS g3, cast(l_quantity as int) AS dp, cast(floor(l_quantity * l_discount * 5) as int) + 1 AS n_alt, l_orderkey, l_linenumber FROM {lineitem}"""


def obs(t: Tables) -> DataFrame:
    o = t.view(OBS).withColumn("gt", F.array("g0", "g1", "g2", "g3")).withColumn("ad", F.array("dp", "n_alt"))
    return st.tetraploid_observations(o.withColumn("alt", F.lit("T")))


OBS_OK = f"SELECT *, n_alt / (dp + n_alt) AS af, g0 + g1 + g2 + g3 AS d FROM ({plain(OBS)}) WHERE dp + n_alt >= 10"


@query("chi_split", with_(
    f"""SELECT sample, n_points, CASE WHEN n_points > 1 THEN split END AS split, CASE WHEN n_points >= 8 THEN {micro_sql('major')} END AS major_micro FROM (
      SELECT sample, n::bigint AS n_points, i::bigint AS split, least(0.99::double, greatest(0.51::double, greatest(2 * (t1 - s1) / (n - i), 1 - 2 * s1 / i))) AS major FROM best WHERE r = 1
      UNION ALL SELECT sample, n, NULL, NULL FROM best WHERE n = 1)""",
    o=OBS_OK, p="SELECT sample, CASE WHEN d = 1 THEN af WHEN d = 3 THEN 1.0::double - af END AS x, l_orderkey, l_linenumber FROM o",
    q="SELECT * FROM p WHERE x > 0.02 AND x < 0.48",
    w="""SELECT sample, row_number() OVER k AS i, sum(x) OVER k AS s1, sum(x * x) OVER k AS s2, sum(x) OVER a AS t1, sum(x * x) OVER a AS t2, count(*) OVER a AS n FROM q
      WINDOW k AS (PARTITION BY sample ORDER BY x, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY sample)""",
    e="SELECT *, CASE WHEN i < n THEN round((s2 - s1 * s1 / i) + ((t2 - s2) - (t1 - s1) * (t1 - s1) / (n - i)), 12) END AS sse FROM w",
    best="SELECT *, row_number() OVER (PARTITION BY sample ORDER BY sse, i) AS r FROM e WHERE i < n OR n = 1"))
def chi_split(t: Tables) -> DataFrame:
    c = st.chi_from_gt(obs(t))
    return c.select("sample", "n_points", F.col("split").cast("bigint").alias("split"), micro("major").alias("major_micro"))


GT_SITES = """SELECT concat('s', cast(l_suppkey % 7 as string)) AS sample, l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'T,G' ELSE 'T' END AS alt,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE cast(l_quantity as int) END AS d0, cast(floor(l_tax * l_quantity * 12) as int) AS d1 FROM {lineitem}"""
CHI = "SELECT concat('s', cast(k as string)) AS sample, (k + 1) * 0.06 AS chi_r FROM (SELECT DISTINCT s_suppkey % 7 AS k FROM {supplier})"
DOSES = [(r, d) for r in range(3) for d in range(3)]
DOSE_VALUES = ", ".join(f"({r}, {d}, '{'/'.join(['1'] * r + ['0'] * (2 - r) + ['1'] * d + ['0'] * (2 - d))}')" for r, d in DOSES)


@query("reassign_genotypes", with_(
    f"""SELECT l_orderkey, l_linenumber, sample, disposition, CASE WHEN disposition = 'refitted' THEN n_r END AS n_r, CASE WHEN disposition = 'refitted' THEN n_d END AS n_d,
      CASE WHEN disposition = 'refitted' THEN gt END AS new_gt, CASE WHEN disposition = 'refitted' THEN {micro_sql('0.5 * n_r * chi_r + 0.5 * n_d * (1 - chi_r)')} END AS exp_micro FROM (
      SELECT *, CASE WHEN alt = 'T,G' OR d0 IS NULL THEN 'passed_through' WHEN d0 + d1 < 10 THEN 'dropped_low_depth' WHEN af < 0.05 THEN 'dropped_low_af' WHEN n_r + n_d = 0 THEN 'dropped_no_alt' ELSE 'refitted' END AS disposition
      FROM fit WHERE r = 1)""",
    s=GT_SITES, chi=CHI.replace("* 0.06", "* 0.06::double"),
    j="SELECT *, CASE WHEN d0 + d1 > 0 THEN d1 / (d0 + d1) ELSE 0 END AS af FROM s JOIN chi USING (sample)",
    fit=f"""SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, d0, d1, sample ORDER BY abs(af - (0.5 * n_r * chi_r + 0.5 * n_d * (1 - chi_r))), -(n_r + n_d), n_r, n_d) AS r
      FROM (SELECT *, row_number() OVER () AS rid FROM j), (VALUES {DOSE_VALUES}) v(n_r, n_d, gt)""".replace("PARTITION BY l_orderkey, l_linenumber, d0, d1, sample", "PARTITION BY rid")))
def reassign_genotypes(t: Tables) -> DataFrame:
    s = t.view(GT_SITES).withColumn("ad", F.array("d0", "d1"))
    chi = t.view(CHI.replace("* 0.06", "* cast(0.06 as double)"))
    r = st.reassign_genotypes(s, chi)
    return r.select("l_orderkey", "l_linenumber", "sample", "disposition", "n_r", "n_d", "new_gt", micro("exp_af").alias("exp_micro"))


SPLITS = list(combinations(range(4), 2))


def _residual_sql(split: tuple[int, int]) -> str:
    return "sum(abs(af - (" + " + ".join(f"g{h} * {'chi_r' if h in split else '(1 - chi_r)'} / 2" for h in range(4)) + ")))"


SIDE_CHI = "SELECT concat('s', cast(s_suppkey as string)) AS sample, (s_suppkey % 9 + 1) * cast(0.05 as double) AS chi_r FROM {supplier}"


@query("side_assignment", with_(
    f"""SELECT sample, gene, n_obs, CASE WHEN n_obs >= 3 THEN list_extract(['RRDD', 'RDRD', 'RDDR', 'DRRD', 'DRDR', 'DDRR'], list_position(l, list_min(l))) ELSE 'RRDD' END AS sides,
      CASE WHEN n_obs >= 3 THEN {micro_sql('list_min(l)')} END AS residual_micro
    FROM (SELECT sample, gene, count(*) AS n_obs, [{', '.join(f'round({_residual_sql(s)}, 12)' for s in SPLITS)}] AS l FROM o JOIN chi USING (sample) GROUP BY ALL)""",
    o=OBS_OK, chi=SIDE_CHI))
def side_assignment(t: Tables) -> DataFrame:
    s = st.side_assignment(obs(t).join(t.view(SIDE_CHI), "sample"))
    return s.select("sample", "gene", "n_obs", "sides", micro("residual").alias("residual_micro"))


PHASED = """SELECT concat('s', cast(l_suppkey as string)) AS sample, 'g' AS gene, cast(l_partkey as int) AS pos, 'A' AS ref, CASE WHEN l_linenumber = 2 THEN 'T,C' ELSE 'T' END AS alt,
  CASE WHEN l_discount < 0.09 THEN true ELSE false END AS phased, CASE WHEN l_tax < 0.01 THEN NULL ELSE cast(floor(l_partkey / 100) as int) END AS ps,
  l_linenumber % 2 AS g0, cast(floor(l_linenumber / 2) as int) % 2 AS g1, cast(floor(l_linenumber / 4) as int) % 2 AS g2, CASE WHEN l_returnflag = 'A' THEN NULL ELSE cast(l_orderkey % 2 as int) END AS g3,
  cast(l_quantity as int) AS dp, cast(floor(l_quantity * l_discount * 5) as int) + 1 AS n_alt, 100 AS start, 100000000 AS end_ FROM {lineitem}"""


def phased(t: Tables) -> DataFrame:
    p = t.view(PHASED).withColumnRenamed("end_", "end")
    return p.withColumn("gt", F.array("g0", "g1", "g2", "g3")).withColumn("ad", F.array("dp", "n_alt"))


PHASED_OK = f"SELECT *, coalesce(ps, pos) AS p, n_alt / (dp + n_alt) AS af FROM ({plain(PHASED)}) WHERE phased AND g3 IS NOT NULL"


@query("phase_blocks", with_(
    """SELECT sample, p AS ps, greatest(100, min(pos - 1)) AS lo, max(pos) AS hi, count(CASE WHEN alt = 'T' THEN 1 END)::int AS n_obs,
      coalesce(sum(CASE WHEN alt = 'T' THEN (pos - 1)::bigint * (g0 + 2 * g1 + 4 * g2 + 8 * g3) END), 0)::bigint AS fingerprint FROM o GROUP BY ALL""", o=PHASED_OK))
def phase_blocks(t: Tables) -> DataFrame:
    b = st.phase_blocks(phased(t))
    code = lambda g: F.get(g, F.lit(0)) + 2 * F.get(g, F.lit(1)) + 4 * F.get(g, F.lit(2)) + 8 * F.get(g, F.lit(3))
    mark = F.aggregate("obs", F.lit(0).cast("bigint"), lambda acc, o: acc + o.pos0.cast("bigint") * code(o.gt))
    return b.select("sample", "ps", "lo", "hi", F.size("obs").alias("n_obs"), mark.alias("fingerprint"))


@query("vaf_penalties", with_(
    "SELECT sample, p AS ps, " + ", ".join(
        micro_sql(f"coalesce(sum(CASE WHEN alt = 'T' THEN abs(af - ({' + '.join(f'g{h} * {0.13 / 2 if h in s else (1 - 0.13) / 2}' for h in range(4))})) END), 0)") + f" AS split{j}" for j, s in enumerate(SPLITS)) + " FROM o GROUP BY ALL",
    o=PHASED_OK))
def vaf_penalties(t: Tables) -> DataFrame:
    p = st.phase_blocks(phased(t)).withColumn("pen", st.vaf_penalties(F.lit(0.13)))
    return p.select("sample", "ps", *[micro(F.get("pen", F.lit(j))).alias(f"split{j}") for j in range(6)])


HAPTAGS = "SELECT concat('s', cast(l_suppkey as string)) AS sample, cast(floor(l_partkey / 100) as int) AS ps, cast(l_linenumber as int) AS hp, cast(l_partkey as int) - 30 AS pos0, cast(l_partkey as int) - 30 + cast(l_quantity as int) AS end0, CASE WHEN l_tax > 0.07 THEN 1024 ELSE 0 END AS flag FROM {lineitem}"


@query("haplotag_coverage", with_(
    "SELECT b.sample, b.ps, " + ", ".join(f"count(CASE WHEN hp = {i} THEN 1 END) AS c{i}" for i in range(1, 5)) + ", " + ", ".join(
        f"CASE WHEN count(hp) = 0 THEN 0 ELSE {micro_sql(' + '.join(f'abs(count(CASE WHEN hp = {h + 1} THEN 1 END) / count(hp) - {0.2 / 2 if h in s else 0.8 / 2})' for h in range(4)))} END AS split{j}" for j, s in enumerate(SPLITS))
    + " FROM b LEFT JOIN r ON r.sample = b.sample AND r.ps = b.ps AND pos0 < hi AND end0 > lo GROUP BY b.sample, b.ps",
    o=PHASED_OK, b="SELECT sample, p AS ps, greatest(100, min(pos - 1)) AS lo, max(pos) AS hi FROM o GROUP BY ALL",
    tags=HAPTAGS, r="SELECT * FROM tags WHERE flag = 0 AND hp <= 4"))
def haplotag_coverage(t: Tables) -> DataFrame:
    c = st.haplotag_coverage(t.view(HAPTAGS), st.phase_blocks(phased(t)))
    c = c.withColumn("pen", st.cov_penalties([F.col(f"c{i}") for i in range(1, 5)], F.lit(0.2)))
    return c.select("sample", "ps", "c1", "c2", "c3", "c4", *[micro(F.get("pen", F.lit(j))).alias(f"split{j}") for j in range(6)])


@query("best_phaseset", with_(
    "SELECT sample, ps, polymorphic, sites FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY polymorphic DESC, ps DESC) AS r FROM per) WHERE r = 1",
    o=PHASED, per="SELECT sample, ps, count(CASE WHEN list_unique([g0, g1, g2, g3]) + (g3 IS NULL)::int > 1 THEN 1 END) AS polymorphic, count(*) AS sites FROM o WHERE ps IS NOT NULL GROUP BY ALL"))
def best_phaseset(t: Tables) -> DataFrame:
    return st.best_phaseset(phased(t), ("sample",)).select("sample", "ps", "polymorphic", "sites")
