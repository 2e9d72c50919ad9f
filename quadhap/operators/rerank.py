"""Multi-channel reranking of quartet calls.

A locus is one ``(sample, gene)`` with a current quartet, an ordered candidate pool and
evidence channels: family shares (``em``), site allele fractions (``af``, ``disc``) and
fragment co-occurrence (``phase``). Lower channel values are better.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import dose, names
from quadhap.operators.calls import attach_ggroup
from quadhap.operators.quartet import DIGITS, TIE, family_fractions, quartet_residuals
from quadhap.operators.ranking import top_k

GROUP = ["sample", "gene"]
MAX_WEIGHT = 200.0  # depth beyond this does not count further


# ---------------------------------------------------------------- candidates

def candidate_union(sources: list[DataFrame]) -> DataFrame:
    """Ordered union ``(sample, gene, family, ord)`` of sources ``(sample, gene, family, ord)``; first position kept."""
    out = None
    for i, s in enumerate(sources):
        t = s.where("family is not null and family not in ('', 'NA')").select(*GROUP, "family", F.struct(F.lit(i).alias("src"), F.col("ord").cast("long").alias("o")).alias("at"))
        out = t if out is None else out.unionByName(t)
    first = out.groupBy(*GROUP, "family").agg(F.min("at").alias("at"))
    w = Window.partitionBy(*GROUP).orderBy("at", "family")
    return first.select(*GROUP, "family", (F.row_number().over(w) - 1).alias("ord"))


def candidates(current: DataFrame, baseline: DataFrame | None, families: DataFrame, top: int = 10, extra: DataFrame | None = None) -> DataFrame:
    """Current quartet, baseline quartet, heaviest families, then extra families, without repeats.

    ``current``/``baseline``: ``(sample, gene, quartet)``; ``extra``: ``(sample, gene, family, ord)``.
    """
    spell = lambda q: q.select(*GROUP, F.posexplode("quartet").alias("ord", "family"))
    heavy = family_fractions(families).where(F.col("ord") <= top).select(*GROUP, "family", "ord")
    heavy = heavy.join(current.select(*GROUP), GROUP, "left_semi")
    parts = [spell(current)] + ([spell(baseline)] if baseline is not None else []) + [heavy] + ([extra] if extra is not None else [])
    return candidate_union(parts)


def exon_candidates(support: DataFrame, min_support: int, max_rank: int) -> DataFrame:
    """Families of ``allele:count;…`` texts (``support_text``) passing support and rank, best first.

    The best entry of a family is the one with most support, then the better rank.
    """
    e = support.select(*GROUP, F.explode(names.parse_support("support_text")).alias("x")).select(*GROUP, "x.*")
    best = e.groupBy(*GROUP, "allele").agg(F.max(F.struct("support", (-F.col("rank")).alias("neg"))).alias("b"))
    ok = best.select(*GROUP, F.col("allele").alias("family"), F.col("b.support").alias("support"), (-F.col("b.neg")).alias("rank"))
    ok = ok.where((F.col("support") >= min_support) & (F.col("rank") <= max_rank))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("support"), "rank", "family")
    return ok.withColumn("ord", F.row_number().over(w))


def collapse_by_ggroup(pool: DataFrame, ggroups: DataFrame) -> DataFrame:
    """Keep the first candidate of every G group."""
    g = attach_ggroup(pool, "family", ggroups, "_g")
    w = Window.partitionBy(*GROUP, "_g").orderBy("ord")
    kept = g.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_g")
    order = Window.partitionBy(*GROUP).orderBy("ord")
    return kept.withColumn("ord", F.row_number().over(order) - 1)


# -------------------------------------------------------------- search spaces

def _slot(i: int) -> Column:
    return F.get("quartet", F.lit(i))


def _replace(slot: int, with_: Column) -> Column:
    return F.array(*[with_ if i == slot else _slot(i) for i in range(4)])


# Which current slot fills each slot of a side swap; the last swaps both sides whole.
SIDE_SWAPS = ((2, 1, 0, 3), (3, 1, 2, 0), (0, 2, 1, 3), (0, 3, 2, 1), (2, 3, 0, 1))
SLOT_SWAPS = ((0, 2), (0, 3), (1, 2), (1, 3), (0, 1), (2, 3))


def _distinct_quartets(raw: DataFrame, current: DataFrame, keep_current: bool) -> DataFrame:
    """First quartet per order-free key; the current one is dropped or kept (flag ``is_current``)."""
    k = raw.withColumn("_k", names.quartet_key("quartet"))
    first = k.groupBy(*GROUP, "_k").agg(F.min_by("quartet", "ord").alias("quartet"), F.min("ord").alias("ord"))
    cur = current.select(*GROUP, names.quartet_key("quartet").alias("_cur"))
    out = first.join(cur, GROUP).withColumn("is_current", F.col("_k") == F.col("_cur"))
    return (out if keep_current else out.where("not is_current")).drop("_k", "_cur")


def search_space(kind: str, current: DataFrame, pool: DataFrame, families: DataFrame | None = None, chi: DataFrame | None = None,
                 keep_current: bool = False) -> DataFrame:
    """Alternative quartets ``(sample, gene, quartet, ord, is_current)``.

    ``swap``: slots exchanged between the sides; ``one``: one slot replaced by a candidate;
    ``private_one``: one weakly supported slot replaced by one of the six heaviest families;
    ``neighbours``: any two slots exchanged or one slot replaced, slot order significant;
    ``full``: every pair times every pair of the pool, which the caller keeps small.
    """
    cur = current.select(*GROUP, "quartet")
    lists = pool.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "family"))), lambda s: s.family).alias("c"))
    j = cur.join(lists, GROUP)
    swaps = lambda perms: F.array(*[F.array(*[_slot(i) for i in p]) for p in perms])
    ones = F.flatten(F.array(*[F.transform(F.filter("c", lambda x: x != _slot(s)), lambda x: _replace(s, x)) for s in range(4)]))
    if kind == "swap":
        alts = F.filter(swaps(SIDE_SWAPS), lambda q: F.forall(q, lambda a: F.array_contains("c", a)))
    elif kind == "one":
        alts = ones
    elif kind == "neighbours":
        pairs = [[{x: y, y: x}.get(i, i) for i in range(4)] for x, y in SLOT_SWAPS]
        sorted_c = F.array_sort("c")
        all_ones = F.flatten(F.array(*[F.transform(sorted_c, lambda x: _replace(s, x)) for s in range(4)]))
        alts = F.array_distinct(F.concat(F.array(F.col("quartet")), swaps(pairs), all_ones))
        return j.select(*GROUP, F.col("quartet").alias("_cur"), F.posexplode(alts).alias("ord", "quartet")).select(
            *GROUP, "quartet", "ord", (F.col("quartet") == F.col("_cur")).alias("is_current")
        )
    elif kind == "private_one":
        f = family_fractions(families)
        near = cur.join(f, GROUP).where((F.col("ord") <= 6) | F.array_contains("quartet", F.col("family")))
        near = near.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("ord", "family", "fraction"))).alias("f"))
        j = j.join(near, GROUP, "left").join(chi.select("sample", "chi_r"), "sample")
        top = F.transform(F.filter("f", lambda s: s.ord <= 6), lambda s: s.family)
        share = dose.fraction_lookup(F.col("f"))
        parts = []
        for s in range(4):
            expected = F.col("chi_r") / 2 if s < 2 else (1.0 - F.col("chi_r")) / 2
            weak = share(_slot(s)) <= F.greatest(F.lit(0.03), expected * 0.25)
            reps = F.transform(F.filter(top, lambda x: x != _slot(s)), lambda x: _replace(s, x))
            parts.append(F.when(weak, reps).otherwise(F.array().cast("array<array<string>>")))
        alts = F.flatten(F.array(*parts))
    elif kind == "full":
        n = F.size("c")
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda k: F.array(F.get("c", i), F.get("c", k)))))
        j = j.withColumn("_p", pairs)
        rows = j.select(*GROUP, "_p", F.posexplode("_p").alias("r", "rp")).select(*GROUP, "r", "rp", F.posexplode("_p").alias("d", "dp"))
        raw = rows.select(*GROUP, F.concat("rp", "dp").alias("quartet"), (F.col("r") * 100000 + F.col("d")).alias("ord"))
        raw = raw.unionByName(cur.withColumn("ord", F.lit(1 << 30))) if keep_current else raw
        return _distinct_quartets(raw, cur, keep_current)
    else:
        raise ValueError(f"unknown search space: {kind}")
    raw = j.select(*GROUP, F.posexplode(alts).alias("ord", "quartet"))
    raw = raw.unionByName(cur.withColumn("ord", F.lit(1 << 30))) if keep_current else raw
    return _distinct_quartets(raw, cur, keep_current)


# --------------------------------------------------------------- site evidence

def site_genotypes(sites: DataFrame, spans: DataFrame, families: DataFrame) -> DataFrame:
    """``(gene, pos0, ref, alt, family, g)``: 0 = reference base, 1 = ALT base, NULL = neither or not covered.

    ``sites``: ``(gene, pos0, ref, alt)``; ``spans``: gap-free runs ``(gene, family, ref_start,
    allele_start, len)`` that map reference to allele positions; ``families``: ``(gene, family,
    seq)``. Runs are matched through 1 kb bins, so it is an equi-join.
    """
    s = sites.where((F.length("ref") == 1) & (F.length("alt") == 1)).select("gene", "pos0", F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct()
    last = F.col("ref_start") + F.col("len") - 1
    b = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ref_start") / 1024), F.floor(last / 1024))))
    hit = s.withColumn("bin", F.floor(F.col("pos0") / 1024)).join(b, ["gene", "bin"]).where((F.col("pos0") >= F.col("ref_start")) & (F.col("pos0") <= last))
    hit = hit.join(families.select("gene", "family", "seq"), ["gene", "family"])
    base = F.upper(F.substr(F.col("seq"), F.col("allele_start") + F.col("pos0") - F.col("ref_start") + 1, F.lit(1)))
    return hit.select("gene", "pos0", "ref", "alt", "family", F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1).alias("g"))


def site_matrix(sites: DataFrame, genotypes: DataFrame, pool: DataFrame) -> DataFrame:
    """``(sample, gene, site, af, w, g map<family,int>)`` with the depth-capped weight of every site.

    ``sites``: ``(sample, gene, site, af, dp)``; ``genotypes``: ``(gene, site, family, g)``.
    """
    g = sites.join(genotypes.where("g is not null"), ["gene", "site"]).join(pool.select(*GROUP, "family"), [*GROUP, "family"], "left_semi")
    maps = g.groupBy(*GROUP, "site").agg(F.map_from_entries(F.collect_list(F.struct("family", "g"))).alias("g"))
    return sites.join(maps, [*GROUP, "site"]).select(*GROUP, "site", "af", F.least(F.col("dp").cast("double"), F.lit(MAX_WEIGHT)).alias("w"), "g")


def _with_quartets(evidence: DataFrame, quartets: DataFrame) -> DataFrame:
    """Evidence rows times the quartets of their locus. A search space is a short list,
    sent to each evidence row once and spelled out there."""
    q = quartets.groupBy(*GROUP).agg(F.collect_list("quartet").alias("_qs"))
    return evidence.join(q, GROUP).withColumn("quartet", F.explode("_qs")).drop("_qs")


def _doses(g: str = "g") -> tuple[Column, Column, Column]:
    a = [F.element_at(F.col(g), _slot(i)) for i in range(4)]
    return 0.5 * (a[0] + a[1]), 0.5 * (a[2] + a[3]), a[0].isNotNull() & a[1].isNotNull() & a[2].isNotNull() & a[3].isNotNull()


def _first_least(per: DataFrame) -> DataFrame:
    """``(sample, gene, quartet, value, chi, n)``: of each quartet the first χ whose value is the least, equal to ``DIGITS`` digits of its size.

    Where values do not depend on χ, sums in another order differ in their last digits; such values are ties.
    """
    each = per.groupBy(*GROUP, "quartet").agg(F.min("value").alias("_least"), F.array_sort(F.collect_list(F.struct("chi_ord", "value", "chi", "n"))).alias("_v"))
    tie = F.col("_least") + TIE * F.greatest(F.lit(1.0), F.abs("_least"))
    b = F.get(F.filter("_v", lambda v: v["value"] <= tie), F.lit(0))
    return each.select(*GROUP, "quartet", b.alias("b")).select(*GROUP, "quartet", "b.value", "b.chi", "b.n")


SCORERS = ("af_l1", "count_l1", "binom_nll", "poisson_nll")


def site_scores(quartets: DataFrame, matrix: DataFrame, chi: DataFrame, scorer: str = "af_l1", chi_grid: DataFrame | None = None,
                min_sites: int = 30, only: Column | None = None, eps: float | None = 5e-3) -> DataFrame:
    """``(sample, gene, quartet, value, chi, n)`` over the sites where all four alleles are known.

    ``af_l1``: weighted mean |AF − expected|; ``count_l1``: Σ|ALT count − expected|;
    ``binom_nll``, ``poisson_nll``: negative log likelihoods. ``chi``: ``(sample, chi_r)``;
    ``chi_grid``: ``(sample, gene, grid array<double>)`` to choose χ per quartet (first
    minimum). ``only`` restricts sites; ``eps=None`` leaves expectations unclipped.
    """
    m = matrix if only is None else matrix.where(only)
    x = _with_quartets(m, quartets)
    x = x.join(chi.select("sample", F.array("chi_r").alias("_g")), "sample") if chi_grid is None else x.join(chi_grid.select(*GROUP, F.col("grid").alias("_g")), GROUP)
    r, d, known = _doses()
    x = x.withColumns({"r": r, "d": d}).where(known).select("*", F.posexplode("_g").alias("chi_ord", "chi"))
    pred = F.col("r") * F.col("chi") + F.col("d") * (1.0 - F.col("chi"))
    p = pred if eps is None else F.greatest(F.lit(eps), F.least(F.lit(1 - eps), pred))
    w, af = F.col("w"), F.col("af")
    alt = af * w
    if scorer == "af_l1":
        value = F.sum(w * F.abs(af - p)) / (F.sum(w) + 1e-9)
    elif scorer == "count_l1":
        value = F.sum(F.abs(alt - p * w))
    elif scorer == "poisson_nll":
        value = F.sum(p * w - alt * F.log(p * w + 1e-12))
    elif scorer == "binom_nll":
        value = F.sum(-(alt * F.log(p) + (w - alt) * F.log(1.0 - p)))
    else:
        raise ValueError(f"unknown scorer: {scorer}")
    per = x.groupBy(*GROUP, "quartet", "chi_ord").agg(F.round(value, DIGITS).alias("value"), F.min("chi").alias("chi"), F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return _first_least(per)


def discriminating(g: str = "g") -> Column:
    """Sites where some candidate carries the reference and another the ALT base."""
    v = F.map_values(g)
    return F.array_contains(v, 0) & F.array_contains(v, 1)


def _fit_af(pdf, top_n: int | None, top_k_rows: int, min_sites: int):
    """Exhaustive AF fit of one gene as nine matrix products over genotype doses.

    The group is sites × candidates: both bounded by the gene region and the nomenclature.
    """
    import numpy as np
    import pandas as pd

    fams = sorted({f for g in pdf["g"] for f, _ in g})
    col = {f: i for i, f in enumerate(fams)}
    geno = np.full((len(pdf), len(fams)), -1, dtype=np.int8)
    for row, g in enumerate(pdf["g"]):
        for f, v in g:
            geno[row, col[f]] = v
    af, w, chi = pdf["af"].to_numpy(), pdf["w"].to_numpy(), float(pdf["chi_r"].iloc[0])
    match = (w[:, None] * np.where(geno == 1, af[:, None], np.where(geno == 0, 1 - af[:, None], 0.0))).sum(axis=0)
    keep = np.argsort(-np.round(match, 9), kind="stable")[:top_n]
    a, b = np.triu_indices(len(keep))
    ga, gb = geno[:, keep[a]], geno[:, keep[b]]
    dose_of = np.where((ga < 0) | (gb < 0), -1, ga + gb)
    one_hot = [(dose_of == v).astype(float) for v in range(3)]
    known = sum(one_hot)
    cost = np.zeros((len(a), len(a)))
    for r in range(3):
        for d in range(3):
            h = w * np.abs(af - (0.5 * r * chi + 0.5 * d * (1 - chi)))
            cost += (one_hot[r] * h[:, None]).T @ one_hot[d]
    count, weight = known.T @ known, (known * w[:, None]).T @ known
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(count >= min_sites, cost / weight, np.inf)
    order = np.argsort(np.round(score, DIGITS), axis=None, kind="stable")[:top_k_rows]
    rows = []
    for rank, flat in enumerate(order, 1):
        r, d = np.unravel_index(flat, score.shape)
        if np.isfinite(score[r, d]):
            rows.append((pdf["sample"].iloc[0], pdf["gene"].iloc[0], rank, [fams[keep[i]] for i in (a[r], b[r], a[d], b[d])], float(score[r, d]), int(count[r, d])))
    return pd.DataFrame(rows, columns=["sample", "gene", "rank", "quartet", "score", "n_sites"])


def fit_quartet_af(matrix: DataFrame, chi: DataFrame, top_n: int | None = None, top_k_rows: int = 10, min_sites: int = 5) -> DataFrame:
    """Best quartets by weighted AF distance over all pairs of the alleles (of the ``top_n`` best-matching, if set):
    ``(sample, gene, rank, quartet, score, n_sites)``."""
    m = matrix.join(chi.select("sample", "chi_r"), "sample").withColumn("g", F.map_entries("g"))
    m = m.select(*GROUP, "site", "af", "w", "chi_r", F.transform("g", lambda e: F.array(e.key, e.value.cast("string"))).alias("g"))
    schema = "sample string, gene string, rank int, quartet array<string>, score double, n_sites int"

    def solve(pdf):
        pdf = pdf.sort_values("site").reset_index(drop=True)
        pdf["g"] = [[(k, int(v)) for k, v in g] for g in pdf["g"]]
        return _fit_af(pdf, top_n, top_k_rows, min_sites)

    return m.groupBy(*GROUP).applyInPandas(solve, schema)


# ------------------------------------------------------------------- phasing

def phase_pair_counts(observations: DataFrame, max_sites: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """Co-occurrence of site alleles on one fragment: ``(sample, gene, i, j, n00, n01, n10, n11)``.

    ``observations``: ``(sample, gene, fragment, site, allele 0/1)`` with ``site`` numbered
    from 0 in position order. A site seen with both alleles on a fragment is left out of
    it. A fragment lists its own site pairs, so fragments are not self-joined. A caller may
    limit the sites and the best-covered pairs; by default all are kept.
    """
    o = observations if max_sites is None else observations.where(F.col("site") < max_sites)
    one = o.groupBy(*GROUP, "fragment", "site").agg(F.min("allele").alias("a"), F.max("allele").alias("hi")).where("a = hi")
    frag = one.groupBy(*GROUP, "fragment").agg(F.array_sort(F.collect_list(F.struct("site", "a"))).alias("s")).where("size(s) > 1")
    # Fragments with the same observations are folded before pairs are listed.
    frag = frag.groupBy(*GROUP, "s").agg(F.count("*").alias("n"))
    left = frag.select(*GROUP, "s", "n", F.posexplode("s").alias("at", "x"))
    rest = F.slice("s", F.col("at") + 2, F.size("s"))
    pairs = left.select(*GROUP, "n", "x", F.explode(rest).alias("y"))
    cell = lambda a, b: F.sum(F.when((F.col("x.a") == a) & (F.col("y.a") == b), F.col("n")).otherwise(0)).alias(f"n{a}{b}")
    counts = pairs.groupBy(*GROUP, F.col("x.site").alias("i"), F.col("y.site").alias("j")).agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))
    if max_pairs is None:
        return counts
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    return top_k(counts, GROUP, [F.desc(total), F.asc("i"), F.asc("j")], max_pairs).drop("rank")


def phase_matrix(pair_counts: DataFrame, site_map: DataFrame) -> DataFrame:
    """Pair counts with the genotype maps of both sites (``gi``, ``gj``); ``site_map``: ``(sample, gene, site, g)``."""
    gi = site_map.select(*GROUP, F.col("site").alias("i"), F.col("g").alias("gi"))
    gj = site_map.select(*GROUP, F.col("site").alias("j"), F.col("g").alias("gj"))
    return pair_counts.join(gi, [*GROUP, "i"], "left").join(gj, [*GROUP, "j"], "left")


def phase_nll(quartets: DataFrame, matrix: DataFrame, chi: DataFrame, min_pairs: int = 5, smooth: float = 1e-3,
              all_known: DataFrame | None = None, chi_grid: DataFrame | None = None) -> DataFrame:
    """Mean negative log likelihood of the pair counts: ``(sample, gene, quartet, value, chi, n)``.

    Pairs with an unknown allele of the quartet are skipped, while the normaliser counts
    every pair. With ``all_known`` (the pool) only pairs known for every candidate are
    used, and the normaliser counts those.
    """
    m = matrix.withColumn("pairs_n", F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    if all_known is not None:
        pool = all_known.groupBy(*GROUP).agg(F.collect_list("family").alias("_pool"))
        have = lambda g: F.forall("_pool", lambda a: F.element_at(F.col(g), a).isNotNull())
        m = m.join(pool, GROUP).where("gi is not null and gj is not null").where(have("gi") & have("gj")).drop("_pool")
    total = m.groupBy(*GROUP).agg(F.greatest(F.sum("pairs_n"), F.lit(1)).alias("total"))
    x = _with_quartets(m.where("gi is not null and gj is not null"), quartets)
    x = x.join(chi.select("sample", F.array("chi_r").alias("_g")), "sample") if chi_grid is None else x.join(chi_grid.select(*GROUP, F.col("grid").alias("_g")), GROUP)
    bucket = [2 * F.element_at("gi", _slot(h)) + F.element_at("gj", _slot(h)) for h in range(4)]
    x = x.withColumn("_b", F.array(*bucket)).where(F.forall("_b", lambda v: v.isNotNull()))
    x = x.select("*", F.posexplode("_g").alias("chi_ord", "chi"))
    w = [F.col("chi") / 2] * 2 + [(1.0 - F.col("chi")) / 2] * 2
    ll = F.lit(0.0)
    for cell, name in enumerate(("n00", "n01", "n10", "n11")):
        mass = sum((F.when(F.get("_b", F.lit(h)) == cell, w[h]).otherwise(0.0) for h in range(1, 4)), F.when(F.get("_b", F.lit(0)) == cell, w[0]).otherwise(0.0))
        ll = ll - F.col(name) * F.log((mass + smooth) / (1.0 + 4 * smooth))
    per = x.groupBy(*GROUP, "quartet", "chi_ord").agg(F.sum(ll).alias("nll"), F.min("chi").alias("chi"), F.count("*").alias("n")).where(F.col("n") >= min_pairs)
    per = per.join(total, GROUP).withColumn("value", F.round(F.col("nll") / F.col("total"), DIGITS))
    return _first_least(per)


def phase_plus_binom(quartets: DataFrame, matrix: DataFrame, phase: DataFrame, binom_at_phase_chi: DataFrame) -> DataFrame:
    """Phase value plus the per-site binomial value taken at the phase channel's χ."""
    b = binom_at_phase_chi.select(*GROUP, "quartet", (F.col("value") / F.greatest(F.lit(1), F.col("n"))).alias("_b"))
    return quartets.select(*GROUP, "quartet").join(phase, [*GROUP, "quartet"]).join(b, [*GROUP, "quartet"]).withColumn("value", F.col("value") + F.col("_b")).drop("_b")


# ------------------------------------------------------------------- channels

def channel_table(quartets: DataFrame, families: DataFrame, chi: DataFrame, matrix: DataFrame | None = None, phase: DataFrame | None = None,
                  min_sites: int = 30, min_disc: int = 10, min_pairs: int = 5) -> DataFrame:
    """Quartets with their ``em``, ``af``, ``disc`` and ``phase`` values (NULL where evidence is too thin)."""
    q = quartets.join(chi.select("sample", "chi_r"), "sample")
    out = quartet_residuals(q, families, "chi_r", "em").drop("chi_r")
    null = F.lit(None).cast("double")
    if matrix is None:
        out = out.withColumns({"af": null, "disc": null})
    else:
        af = site_scores(quartets, matrix, chi, "af_l1", min_sites=min_sites, eps=None)
        disc = site_scores(quartets, matrix, chi, "af_l1", min_sites=min_disc, only=discriminating(), eps=None)
        for name, df in (("af", af), ("disc", disc)):
            out = out.join(df.select(*GROUP, "quartet", F.col("value").alias(name)), [*GROUP, "quartet"], "left")
    if phase is None:
        return out.withColumn("phase", null)
    ph = phase_nll(quartets, phase, chi, min_pairs).select(*GROUP, "quartet", F.col("value").alias("phase"))
    return out.join(ph, [*GROUP, "quartet"], "left")


# Fixed values: (strategy, candidate set, search space, channels) and the margin per channel.
STRATEGIES = (
    ("C0_full_EM_AF", "c0", "full", ("em", "af")),
    ("C0_swap_EM_AF", "c0", "swap", ("em", "af")),
    ("C0_one_EM_AF", "c0", "one", ("em", "af")),
    ("C1_full_EM_AF", "c1", "full", ("em", "af")),
    ("C1_swap_EM_AF", "c1", "swap", ("em", "af")),
    ("C0_full_EM_DISC", "c0", "full", ("em", "disc")),
    ("C0_swap_EM_DISC", "c0", "swap", ("em", "disc")),
    ("C0_swap_EM_PHASE", "c0", "swap", ("em", "phase")),
    ("C0_one_EM_PHASE", "c0", "one", ("em", "phase")),
    ("C0_swap_AF_PHASE", "c0", "swap", ("af", "phase")),
    ("C0_swap_EM_AF_PHASE", "c0", "swap", ("em", "af", "phase")),
    ("C0_one_EM_AF_PHASE", "c0", "one", ("em", "af", "phase")),
    ("C1_swap_EM_AF_PHASE", "c1", "swap", ("em", "af", "phase")),
)
MARGINS = {"em": 0.01, "af": 0.005, "disc": 0.005, "phase": 0.0005}


def multi_channel_gate(rows: DataFrame, strategies=STRATEGIES, margins: dict[str, float] = MARGINS) -> DataFrame:
    """Alternative that beats the current quartet by the margin on every channel, with the largest total gain.

    ``rows``: ``(sample, gene, space, quartet, ord, is_current, em, af, disc, phase)`` where
    ``space`` is ``<candidate set>_<search>``; the current quartet appears in each space.
    Returns ``(sample, gene, strategy, status, proposed, gain)`` with status ``propose``,
    ``hold``, or ``skip`` when a channel has no value for the current quartet.
    """
    plan = F.array(*[
        F.struct(F.lit(n).alias("strategy"), F.lit(f"{c}_{s}").alias("space"), F.array(*[F.lit(x) for x in ch]).alias("channels")) for n, c, s, ch in strategies
    ])
    values = F.create_map(*[x for c in margins for x in (F.lit(c), F.col(c))])
    r = rows.withColumn("_v", values).withColumn("_s", F.explode(F.filter(plan, lambda p: p.space == F.col("space"))))
    r = r.select(*GROUP, "quartet", "ord", "is_current", "_v", "_s.strategy", "_s.channels")
    cur = r.where("is_current").select(*GROUP, "strategy", F.col("_v").alias("_c"))
    margin = F.create_map(*[x for c, m in margins.items() for x in (F.lit(c), F.lit(m))])
    j = r.join(cur, [*GROUP, "strategy"])
    gains = F.transform("channels", lambda c: F.struct((F.element_at("_c", c) - F.element_at("_v", c)).alias("g"), F.element_at(margin, c).alias("m")))
    j = j.withColumn("_g", gains).withColumn("skip", F.exists("channels", lambda c: F.element_at("_c", c).isNull()))
    ok = ~F.col("is_current") & F.forall("_g", lambda x: F.coalesce(F.round(x.g, DIGITS) >= x.m, F.lit(False)))
    gain = F.round(F.aggregate("_g", F.lit(0.0), lambda acc, x: acc + x.g), DIGITS)
    j = j.withColumns({"_ok": ok, "gain": gain})
    best = F.min_by(F.when(F.col("_ok"), F.struct("quartet", "gain")), F.when(F.col("_ok"), F.struct(-F.col("gain"), F.col("ord"))))
    out = j.groupBy(*GROUP, "strategy").agg(F.bool_or("skip").alias("skip"), best.alias("b"))
    status = F.when(F.col("skip"), "skip").when(F.col("b").isNotNull(), "propose").otherwise("hold")
    return out.select(*GROUP, "strategy", status.alias("status"), F.when(~F.col("skip"), F.col("b.quartet")).alias("proposed"),
                      F.when(~F.col("skip"), F.coalesce("b.gain", F.lit(0.0))).alias("gain"))


@dataclass(frozen=True)
class JointStrategy:
    name: str
    channels: tuple[str, ...]
    margin: float
    prior: float = 0.0


# Joint strategies (search space and χ mode are chosen when the rows are built).
JOINT_STRATEGIES = (
    JointStrategy("joint_full_fixed", ("em", "af"), 0.05),
    JointStrategy("joint_full_hier", ("em", "af"), 0.05),
    JointStrategy("joint_full_phase_hier", ("em", "af", "phase"), 0.05),
    JointStrategy("disagreement_resolver", ("em", "af"), 0.08, 0.12),
    JointStrategy("one_position_repair", ("em", "af"), 0.04, 0.04),
    JointStrategy("rd_swap_repair", ("em", "af", "phase"), 0.04, 0.02),
    JointStrategy("private_support_repair", ("em", "af"), 0.03, 0.02),
)


def chi_window(chi: DataFrame, width: float, step: float) -> DataFrame:
    """``grid``: χ values around the sample's estimate, kept inside [0.005, 0.995]."""
    lo, hi = F.greatest(F.lit(0.005), F.col("chi_r") - width), F.least(F.lit(0.995), F.col("chi_r") + width)
    n = F.floor((hi + 1e-9 - lo) / step).cast("int")
    return chi.withColumn("grid", F.transform(F.sequence(F.lit(0), n), lambda i: lo + i * F.lit(step)))


def joint_score(rows: DataFrame, strategy: JointStrategy) -> DataFrame:
    """Mean of range-normalised channels plus a prior on the distance from the current quartet.

    ``rows``: ``(sample, gene, quartet, current, ord, is_current, <channels>)``. A channel is
    scaled by its minimum and third quartile over the locus; missing values cost nothing,
    and a channel without any value is left out. Returns one row per locus with
    ``status`` (``propose``, ``hold_current_best``, ``hold_low_gap``), ``chosen``, ``gap``,
    ``conflict`` and ``abstain``.
    """
    ch = list(strategy.channels)
    stats = rows.groupBy(*GROUP).agg(*[F.min(c).alias(f"_lo_{c}") for c in ch], *[F.percentile(c, F.lit(0.75)).alias(f"_hi_{c}") for c in ch])
    j = rows.join(stats, GROUP)
    parts = [F.when(F.col(f"_lo_{c}").isNotNull(), F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1e-9)), F.lit(0.0))) for c in ch]
    used = F.filter(F.array(*parts), lambda v: v.isNotNull())
    j = j.withColumn("_u", used).where("size(_u) > 0")
    mean = F.aggregate("_u", F.lit(0.0), lambda acc, v: acc + v) / F.size("_u")
    j = j.withColumn("score", F.round(mean + strategy.prior * names.quartet_distance(F.col("quartet"), F.col("current")), DIGITS))
    order = Window.partitionBy(*GROUP).orderBy("score", "ord")
    j = j.withColumn("rank", F.row_number().over(order))
    cells = F.struct(*ch)
    agg = j.groupBy(*GROUP).agg(
        F.min_by(F.struct("quartet", "score", "is_current", cells.alias("v")), "rank").alias("b"),
        F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.first("current").alias("current"),
        F.min(F.when(F.col("is_current"), F.col("score"))).alias("current_score"),
        F.min_by(F.when(F.col("is_current"), cells), F.when(F.col("is_current"), F.col("rank"))).alias("cv"),
    )
    gap = F.round(F.col("second") - F.col("b.score"), DIGITS)
    low = F.coalesce(gap < strategy.margin, F.lit(False))
    status = F.when(F.col("b.is_current"), "hold_current_best").when(low, "hold_low_gap").otherwise("propose")
    conflict = F.lit(False)
    for c in ch:
        conflict = conflict | F.coalesce(F.col(f"b.v.{c}") > F.col(f"cv.{c}"), F.lit(False))
    return agg.select(
        *GROUP, F.lit(strategy.name).alias("strategy"), status.alias("status"), F.when(status == "propose", F.col("b.quartet")).otherwise(F.col("current")).alias("chosen"),
        F.col("b.quartet").alias("best"), F.col("b.score").alias("best_score"), "current_score", gap.alias("gap"), conflict.alias("conflict"), (low | conflict).alias("abstain"),
    )


def rank_with_gap(scored: DataFrame) -> DataFrame:
    """Best quartet and its distance to the second: ``(sample, gene, quartet, value, chi, gap)`` from ``site_scores``."""
    two = top_k(scored, GROUP, [F.asc("value"), F.asc("quartet")], 2)
    return two.groupBy(*GROUP).agg(F.min_by(F.struct("quartet", "value", "chi"), "rank").alias("b"), F.max("value").alias("v2"), F.count("*").alias("n")).where("n = 2").select(
        *GROUP, "b.*", F.round(F.col("v2") - F.col("b.value"), DIGITS).alias("gap")
    )


def dose_rerank(current: DataFrame, families: DataFrame, chi: DataFrame, pool: DataFrame, homozygous_penalty: float = 0.02,
                min_gain: float = 0.0) -> DataFrame:
    """Best neighbour of the current quartet by residual: ``(sample, gene, current, best, current_residual, best_residual, changed)``.

    A recipient pair homozygous for a donor allele pays ``homozygous_penalty``, so the
    minor source is not erased lightly. Loci with fewer than two candidates are left alone,
    as are gains below ``min_gain``.
    """
    size = pool.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") >= 2).select(*GROUP)
    near = search_space("neighbours", current, pool.join(size, GROUP, "left_semi"))
    scored = quartet_residuals(near.join(chi.select("sample", "chi_r"), "sample"), families, "chi_r")
    erased = (_slot(0) == _slot(1)) & F.array_contains(F.slice("quartet", 3, 2), _slot(0))
    scored = scored.withColumn("penalised", F.round(F.col("residual") + F.when(erased, homozygous_penalty).otherwise(0.0), DIGITS))
    best = scored.groupBy(*GROUP).agg(
        F.min_by(F.struct("quartet", "penalised"), F.struct("penalised", "ord")).alias("b"), F.max(F.when(F.col("is_current"), F.col("residual"))).alias("cur")
    ).join(current.select(*GROUP, F.col("quartet").alias("current")), GROUP)
    keep = (F.col("b.quartet") != F.col("current")) & (F.round(F.col("cur") - F.col("b.penalised"), DIGITS) >= min_gain)
    return best.select(
        *GROUP, "current", F.when(keep, F.col("b.quartet")).otherwise(F.col("current")).alias("best"), F.col("cur").alias("current_residual"),
        F.col("b.penalised").alias("best_residual"), keep.alias("changed"),
    )


def dose_pool(current: DataFrame, families: DataFrame, others: DataFrame | None = None, top: int = 8, min_fraction: float = 0.003) -> DataFrame:
    """Pool of the dose rerank: heaviest families with a minimum share, the current call and other versions' calls."""
    heavy = family_fractions(families).where((F.col("ord") <= top) & (F.col("fraction") >= min_fraction)).select(*GROUP, "family", "ord")
    heavy = heavy.join(current.select(*GROUP), GROUP, "left_semi")
    spell = lambda q: q.select(*GROUP, F.posexplode("quartet").alias("ord", "family"))
    return candidate_union([heavy, spell(current)] + ([spell(others)] if others is not None else []))


def kmer_dose_rerank(current: DataFrame, support: DataFrame, chi: DataFrame, min_hits: int = 3, min_unique: int = 100, max_number: int = 100,
                     top: int = 8, min_gain: float = 0.05) -> DataFrame:
    """Dose rerank on family-specific k-mer support ``(sample, gene, family, reads, unique_kmers)``."""
    f = support.where((F.col("reads") >= min_hits) & (F.col("unique_kmers") >= min_unique) & (names.allele_number("family") <= max_number))
    f = f.select(*GROUP, "family", F.col("reads").cast("double").alias("weight"))
    return dose_rerank(current, f, chi, dose_pool(current, f, top=top, min_fraction=0.0), homozygous_penalty=0.0, min_gain=min_gain)


@dataclass(frozen=True)
class EnsembleGate:
    """Margins of the exon/ensemble strategies. No truth-derived score takes part."""

    exon_min_support: int = 3
    exon_max_rank: int = 3
    em_gain: float = 0.020
    af_gain: float = 0.002
    disc_gain: float = 0.002
    phase_gain: float = 0.0002


def ensemble_strategies(rows: DataFrame, exon: DataFrame, gate: EnsembleGate = EnsembleGate()) -> DataFrame:
    """``exon_inject_em``, ``disc_panel`` and ``ensemble_gate``: ``(sample, gene, strategy, chosen, overridden)``.

    ``rows``: the full space with channels and ``current``; ``exon``: ``(sample, gene,
    family, support, rank)``. The best quartet by one channel replaces the current one
    when its gains, and the exon support of its alleles, are sufficient.
    """
    lists = exon.groupBy(*GROUP).agg(F.collect_list(F.struct("family", "support", "rank")).alias("_e"))
    ch = ("em", "af", "disc", "phase")
    cells = F.struct("quartet", *ch)
    agg = rows.groupBy(*GROUP).agg(
        F.first("current").alias("current"), F.min_by(F.when(F.col("is_current"), cells), F.when(F.col("is_current"), F.col("ord"))).alias("cur"),
        *[F.min_by(F.when(F.col(c).isNotNull(), cells), F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col("ord")))).alias(f"by_{c}") for c in ("em", "disc")],
    ).join(lists, GROUP, "left")

    def gain(alt: str, c: str) -> Column:
        return F.coalesce(F.round(F.col(f"cur.{c}") - F.col(f"{alt}.{c}"), DIGITS), F.lit(float("-inf")))

    hits = F.filter("_e", lambda e: F.array_contains(F.col("by_em.quartet"), e.family))
    best = F.array_max(F.transform(hits, lambda e: F.struct(e.support.alias("support"), (-e["rank"]).alias("neg"))))
    exon_ok = F.coalesce((best.support >= gate.exon_min_support) & (-best.neg <= gate.exon_max_rank), F.lit(False))
    independent = (gain("by_em", "af") >= gate.af_gain) | (gain("by_em", "disc") >= gate.disc_gain) | (gain("by_em", "phase") >= gate.phase_gain)
    rules = {
        "exon_inject_em": ("by_em", exon_ok & (gain("by_em", "em") >= gate.em_gain)),
        "disc_panel": ("by_disc", (gain("by_disc", "em") >= gate.em_gain) & (gain("by_disc", "disc") >= gate.disc_gain)),
        "ensemble_gate": ("by_em", (gain("by_em", "em") >= gate.em_gain) & independent & exon_ok),
    }
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), F.when(ok, F.col(f"{src}.quartet")).otherwise(F.col("current")).alias("chosen"), ok.alias("overridden")) for n, (src, ok) in rules.items()])
    return agg.select(*GROUP, F.explode(each).alias("x")).select(*GROUP, "x.*")
