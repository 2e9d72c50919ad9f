"""Search of the four-haplotype quartet (two recipient, two donor) that explains family evidence.

A haplotype of the recipient carries χ/2 of the reads, one of the donor (1−χ)/2.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadhap.functions import dose, names
from quadhap.operators.ranking import top_k
from quadhap.session import cut_lineage

GROUP = ["sample", "gene"]
PAIRS = list(combinations_with_replacement(range(4), 2))
DIGITS = 12  # scores equal to this many digits count as ties and fall to the ordinal
TIE = 5e-13  # half of the last of them
TIE_NLL = 1e-6, 1e-10  # a likelihood bound must miss by more than this, absolute and relative, which covers the rounding of its sums


def family_fractions(families: DataFrame) -> DataFrame:
    """``(sample, gene, family, weight, fraction, ord)``; ``ord`` ranks by weight, then name."""
    g = Window.partitionBy(*GROUP)
    f = families.select(*GROUP, "family", "weight").withColumn("_t", F.sum("weight").over(g)).where("_t > 0")
    f = f.withColumn("fraction", F.col("weight") / F.col("_t")).drop("_t")
    return f.withColumn("ord", F.row_number().over(g.orderBy(F.desc("weight"), "family")))


def candidate_pool(families: DataFrame, top_n: int | None, min_frac: float, forced: DataFrame | None = None,
                   restrict: DataFrame | None = None) -> DataFrame:
    """Candidates per (sample, gene): those with a share strictly above ``min_frac`` (of the ``top_n`` heaviest, if set),
    plus forced families (share 0 when unseen). Groups listed in ``restrict`` use only those families
    and the forced ones. ``ord`` ranks the pool by weight, then name."""
    f = family_fractions(families)
    wanted = F.col("heavy")
    cols = [*GROUP, "family", "weight", "fraction"]
    f = f.withColumn("heavy", (F.lit(True) if top_n is None else F.col("ord") <= top_n) & (F.col("fraction") > min_frac))
    for extra, flag in ((forced, "is_forced"), (restrict, "is_listed")):
        if extra is None:
            continue
        e = extra.select(*GROUP, "family").distinct().withColumn(flag, F.lit(True))
        f = f.join(e.join(f.select(*GROUP).distinct(), GROUP, "left_semi"), [*GROUP, "family"], "full")
        wanted = wanted | F.col(flag)
    if restrict is not None:
        limited = restrict.select(*GROUP).distinct().withColumn("limited", F.lit(True))
        f = f.join(limited, GROUP, "left")
        listed = F.coalesce(F.col("is_listed"), F.lit(False))
        if forced is not None:
            listed = listed | F.coalesce(F.col("is_forced"), F.lit(False))
        wanted = F.when(F.coalesce("limited", F.lit(False)), listed).otherwise(F.coalesce(wanted, F.lit(False)))
    pool = f.where(F.coalesce(wanted, F.lit(False))).select(*cols).na.fill(0.0, ["weight", "fraction"])
    w = Window.partitionBy(*GROUP).orderBy(F.desc("weight"), "family")
    return pool.withColumn("ord", F.row_number().over(w) - 1)


def _dose_terms(obs: list[Column], i: Column, j: Column, k: Column, m: Column, chi: Column) -> Column:
    """Σ over the listed candidates of |o − e| − o; a candidate outside the quartet adds nothing."""
    total = F.lit(0.0)
    for x, o in enumerate(obs):
        n_r = (i == x).cast("int") + (j == x).cast("int")
        n_d = (k == x).cast("int") + (m == x).cast("int")
        total = total + F.when(o.isNotNull(), F.abs(o - dose.expected_dose(n_r, n_d, chi)) - o).otherwise(0.0)
    return total


def chi_values(chi: Column, grid: tuple[float, float, float] | None) -> Column:
    if grid is None:
        return F.array(chi.cast("double"))
    lo, hi, step = grid
    n = int((hi + 1e-9 - lo) / step)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(float(lo)) + i * F.lit(float(step)))


def _slots_cost(slots: list[Column], chi: Column) -> Column:
    """Σ |o − e| − o over the distinct members of four slots ``(ord, family, fraction)``."""
    total = F.lit(0.0)
    for x, slot in enumerate(slots):
        is_first = F.lit(True)
        for other in slots[:x]:
            is_first = is_first & (other["ord"] != slot["ord"])
        n_r, n_d = (sum(((slots[y]["ord"] == slot["ord"]).cast("int") for y in side), F.lit(0)) for side in ((0, 1), (2, 3)))
        total = total + F.when(is_first, F.abs(slot["fraction"] - dose.expected_dose(n_r, n_d, chi)) - slot["fraction"]).otherwise(0.0)
    return total


def _listed_pairs(members: Column, by: str) -> Column:
    """All pairs (a, b) of a list of members with a not behind b in ``by``: ``family`` (the name) or ``ord`` (the weight rank)."""
    pairs = F.flatten(F.transform(members, lambda a: F.transform(members, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.filter(pairs, lambda p: p["a"][by] <= p["b"][by])


def fit_quartet_l1(families: DataFrame, chi: DataFrame, top_n: int | None = None, min_frac: float = 0.002, forced: DataFrame | None = None,
                   restrict: DataFrame | None = None, chi_grid: tuple[float, float, float] | None = None,
                   chi_prior: float = 0.0, scope: str = "candidates", min_pool: int = 2, slot_order: str = "name") -> DataFrame:
    """Quartet with the least Σ|observed − expected|: ``(sample, gene, quartet, score, chi_fit, chi_r)``.

    ``families``: ``(sample, gene, family, weight)``; ``chi``: ``(sample, chi_r)``. With a
    ``(lo, hi, step)`` grid χ is fitted too, with ``chi_prior * |χ − chi_r|`` added.

    Expected share e costs a candidate with share o the amount ``max(−e, e − 2o)``, which
    never grows with o. Swapping an unused heavier candidate in for a lighter one thus
    never worsens a quartet, and at most three others are in the way: the four heaviest
    candidates always hold an optimum, for every χ. So the least score takes 100 quartets
    per group however large the pool.

    Many quartets reach it, because a candidate at or above its expected share costs the
    same as any heavier one. The first in order wins: both sides are listed by ``slot_order``, and
    quartets are ordered by the weight ranks of their four slots as listed. Members that can stand in
    such a quartet are the four heaviest, their equals, and those at or above the smallest
    expected share; shares add up to one, so they are few. The recipient pair is found
    first (the best donor pair for it is among the heaviest and itself), then the donor pair.

    ``scope`` sets which families the score sums over: the pool, or ``all``. Slots of a
    side are listed by ``name`` or by ``rank`` (heavier first).
    """
    by = {"name": "family", "rank": "ord"}[slot_order]
    pool = candidate_pool(families, top_n, min_frac, forced, restrict)
    members = F.array_sort(F.collect_list(F.struct("ord", "family", "fraction")))
    base = F.sum("fraction") if scope == "candidates" else F.lit(1.0)
    groups = pool.groupBy(*GROUP).agg(members.alias("all"), F.count("*").alias("n_pool"), base.alias("base"))
    groups = groups.where(F.col("n_pool") >= min_pool).join(chi.select("sample", "chi_r"), "sample").withColumn("c", F.slice("all", 1, 4))
    prior = lambda x: chi_prior * F.abs(x - F.col("chi_r")) if chi_prior > 0 else F.lit(0.0)
    patterns = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijkm", r + d)]) for r, d in product(PAIRS, PAIRS)])
    trial = groups.withColumn("p", F.explode(patterns)).where("greatest(p.j, p.m) < size(c)")
    trial = trial.select("*", F.posexplode(chi_values(F.col("chi_r"), chi_grid)).alias("chi_ord", "chi"))
    obs = [F.get("c", F.lit(x))["fraction"] for x in range(4)]
    score = F.col("base") + _dose_terms(obs, *[F.col(f"p.{n}") for n in "ijkm"], F.col("chi")) + prior(F.col("chi"))
    scored = trial.withColumn("score", F.round(score, DIGITS)).groupBy(*GROUP, "chi_ord").agg(
        F.min("score").alias("score"), *[F.first(n).alias(n) for n in ("chi", "chi_r", "base", "all")]
    )
    at_best = scored.groupBy(*GROUP).agg(
        F.min("score").alias("score"), F.collect_list(F.struct("chi_ord", "chi", "score")).alias("x"), *[F.first(n).alias(n) for n in ("chi_r", "base", "all")]
    ).withColumn("x", F.array_sort(F.filter("x", lambda x: x["score"] <= F.col("score") + TIE)))
    smallest = F.array_min(F.transform("x", lambda x: F.least(x["chi"], 1.0 - x["chi"]) / 2))
    fourth = F.coalesce(F.get("all", F.lit(3))["fraction"], F.lit(0.0))
    best = at_best.withColumn("few", F.filter("all", lambda m: (m["ord"] < 4) | (m["fraction"] >= fourth) | (m["fraction"] >= smallest - 1e-9)))

    def first_pair(rows: DataFrame, slots: list[Column], pair: Column) -> DataFrame:
        """Of rows with a trial quartet, the first ``pair`` per group that reaches the least score."""
        rows = rows.withColumn("x1", F.explode("x"))
        reached = F.col("base") + _slots_cost(slots, F.col("x1.chi")) + prior(F.col("x1.chi"))
        hit = rows.where(F.round(reached, DIGITS) <= F.col("score") + TIE)
        order = F.struct(pair["a"]["ord"], pair["b"]["ord"], "x1.chi_ord")
        return hit.groupBy(*GROUP).agg(F.min_by(F.struct(pair.alias("p"), F.col("x1.chi").alias("chi")), order).alias("won"))

    near = lambda p: F.array_distinct(F.concat(F.slice("all", 1, 4), F.array(p["a"], p["b"])))
    slots = [F.col("r")["a"], F.col("r")["b"], F.col("d")["a"], F.col("d")["b"]]
    tries = best.withColumn("r", F.explode(_listed_pairs(F.col("few"), by))).withColumn("d", F.explode(_listed_pairs(near(F.col("r")), by)))
    with_r = best.join(first_pair(tries, slots, F.col("r")).select(*GROUP, F.col("won.p").alias("r")), GROUP)
    done = with_r.join(first_pair(with_r.withColumn("d", F.explode(_listed_pairs(F.col("few"), by))), slots, F.col("d")), GROUP)
    sides = [F.col("r"), F.col("won.p")]
    quartet = F.array(*[p[n]["family"] for p in sides for n in "ab"])
    return done.select(*GROUP, quartet.alias("quartet"), "score", F.col("won.chi").alias("chi_fit"), "chi_r")


def family_logweights(alignments: DataFrame, temperature: float = 2.0, family_agg: str = "max") -> DataFrame:
    """``(sample, gene, read, family, logw)`` from ``(sample, gene, read, family, score)`` alignments."""
    w = Window.partitionBy(*GROUP, "read")
    a = alignments.withColumn("lw", (F.col("score") - F.max("score").over(w)) / temperature)
    m = a.groupBy(*GROUP, "read", "family")
    if family_agg == "max":
        return m.agg(F.max("lw").alias("logw"))
    if family_agg == "logsum":
        return m.agg(F.log(F.sum(F.exp("lw"))).alias("logw"))
    raise ValueError(f"unknown family_agg: {family_agg}")


def likelihood_classes(read_families: DataFrame, pool: DataFrame) -> DataFrame:
    """``(sample, gene, sig, n_pool, n)`` per class of equal reads: the candidates it supports with their log weights, the candidates of the group, the reads.

    Reads that support no candidate form one class at the floor.
    """
    n = pool.groupBy(*GROUP).agg(F.count("*").cast("int").alias("n_pool"))
    hits = read_families.join(pool.select(*GROUP, "family", "ord"), [*GROUP, "family"], "left")
    entry = F.when(F.col("ord").isNotNull(), F.struct("ord", "logw"))
    sig = hits.groupBy(*GROUP, "read").agg(F.array_sort(F.collect_list(entry)).alias("sig"))
    return sig.groupBy(*GROUP, "sig").agg(F.count("*").alias("n")).join(n, GROUP).select(*GROUP, "sig", "n_pool", "n")


ABSENT, NO_RECIPIENT = -1, -2
#: Quartets per group whose exact value the first round gives, and recipients tried for each donor pair to find them.
FIRST_ROUND, TRIED = 24, 3


def _supported_pairs(ends: Column) -> Column:
    """Pairs ``k, m`` of the listed candidates, of which the first stands for an absent one; ``k`` is absent only where ``m`` is."""
    pairs = F.flatten(F.transform(ends, lambda a: F.transform(ends, lambda b: F.struct(a.alias("k"), b.alias("m")))))
    return F.filter(pairs, lambda p: (p["m"]["o"] == ABSENT) | ((p["k"]["o"] != ABSENT) & (p["k"]["o"] <= p["m"]["o"])))


def likelihood_terms(classes: DataFrame, chis: DataFrame, log_floor: float = -25.0) -> DataFrame:
    """``(sample, gene, chi_ord, k, m, i, term)``: log likelihoods folded over all reads, to be added up by :func:`three_slots`.

    A class differs from a read at the floor only in the candidates it supports. What it adds
    to a quartet is split into what each single one, each two and each three of these add beyond
    their parts, so a class gives rows for its own candidates only, never for the pool's quartets.
    ``k, m``: donor candidates or ``ABSENT``; ``i``: a recipient candidate, ``ABSENT``, or
    ``NO_RECIPIENT`` for likelihoods without recipient share.
    """
    floor = F.lit(math.exp(log_floor))
    c = classes.join(chis, GROUP).withColumn("s", F.transform("sig", lambda s: F.struct(s["ord"].cast("int").alias("o"), F.exp(s["logw"]).alias("e"))))
    none = F.struct(F.lit(ABSENT).alias("o"), F.lit(None).cast("double").alias("e"))
    ends = F.concat(F.array(none), F.col("s"))
    donors = _supported_pairs(ends)
    recipients = F.concat(F.array(F.struct(F.lit(NO_RECIPIENT).alias("o"), F.lit(0.0).alias("e")), F.struct(F.lit(ABSENT).alias("o"), F.lit(None).cast("double").alias("e"))), F.col("s"))
    rows = c.select(*GROUP, "n", "chi_ord", "chi", F.explode(donors).alias("d"), recipients.alias("rs")).select("*", F.explode("rs").alias("r"))
    x, y = F.coalesce("d.k.e", floor), F.coalesce("d.m.e", floor)
    like = lambda a, b, z: F.log((1.0 - F.col("chi")) / 2 * (a + b) + F.col("chi") / 2 * z)

    def beyond(z: Column) -> Column:
        one = like(x, floor, z) - like(floor, floor, z)
        both = like(x, y, z) - like(x, floor, z) - like(floor, y, z) + like(floor, floor, z)
        return F.when(F.col("d.k.o") == ABSENT, like(floor, floor, z)).when(F.col("d.m.o") == ABSENT, one).otherwise(both)

    z = F.coalesce("r.e", floor)
    term = F.when(F.col("r.o") < 0, beyond(z)).otherwise(beyond(z) - beyond(floor))
    return rows.groupBy(*GROUP, "chi_ord", F.col("d.k.o").alias("k"), F.col("d.m.o").alias("m"), F.col("r.o").alias("i")).agg(F.sum(F.col("n") * term).alias("term"))


def three_slots(terms: DataFrame, pool: DataFrame) -> DataFrame:
    """``(sample, gene, chi_ord, k, m, base, gains array<struct<gain, i>>)``: of every donor pair, the log likelihood without a recipient and what each recipient candidate alone adds, best first."""
    each = pool.select(*GROUP, F.col("ord").cast("int").alias("ord"))
    grid = terms.select(*GROUP, "chi_ord").distinct()
    pairs = grid.join(each.withColumnRenamed("ord", "k"), GROUP).join(each.withColumnRenamed("ord", "m"), GROUP).where("k <= m")
    parts = [(ABSENT, ABSENT), ("k", ABSENT), ("m", ABSENT), ("k", "m")]
    named = F.array(*[F.struct(*[(F.lit(v) if isinstance(v, int) else F.col(v)).alias(n) for n, v in zip(("pk", "pm"), p)]) for p in parts])
    listed = pairs.select("*", F.explode(named).alias("p")).select(*GROUP, "chi_ord", "k", "m", "p.pk", "p.pm")
    # a term is kept by donors with its candidates as an array: three entries to a supported candidate at most
    held = terms.groupBy(*GROUP, "chi_ord", F.col("k").alias("pk"), F.col("m").alias("pm")).agg(F.collect_list(F.struct("i", "term")).alias("t"))
    found = listed.join(held, [*GROUP, "chi_ord", "pk", "pm"]).select(*GROUP, "chi_ord", "k", "m", F.explode("t").alias("t"))
    summed = found.groupBy(*GROUP, "chi_ord", "k", "m", F.col("t.i").alias("i")).agg(F.sum("t.term").alias("term"))
    per = summed.groupBy(*GROUP, "chi_ord", "k", "m").agg(
        F.max(F.when(F.col("i") == NO_RECIPIENT, F.col("term"))).alias("base"), F.max(F.when(F.col("i") == ABSENT, F.col("term"))).alias("plain"),
        F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "term"))).alias("own"))
    sizes = each.groupBy(*GROUP).agg(F.count("*").cast("int").alias("n_pool"))
    own = lambda i: F.coalesce(F.get(F.filter("own", lambda x: x["i"] == i), F.lit(0))["term"], F.lit(0.0))
    gains = F.transform(F.sequence(F.lit(0), F.col("n_pool") - 1), lambda i: F.struct((F.col("plain") + own(i) - F.col("base")).alias("gain"), i.alias("i")))
    return per.join(sizes, GROUP).select(*GROUP, "chi_ord", "k", "m", "base", F.sort_array(gains, False).alias("gains"))


#: Terms of quartets that a task holds, and likelihoods it computes at once.
HELD_TERMS, AT_ONCE = 1 << 21, 1 << 21


def _class_terms(o: np.ndarray, e: np.ndarray, n: np.ndarray, chi: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, second, term`` of classes with equally many candidates, given as rows of ``o`` (sorted) and ``e``: the members of each
    pair, as columns, and of each class what every pair of recipients and of donors adds beyond its parts, times ``n``."""
    s = o.shape[1]
    a, b = np.triu_indices(s)
    # no candidate, each single one, each two; column 0 stands for the absent one
    first, second = np.concatenate([[0], np.arange(s) + 1, a + 1]), np.concatenate([np.zeros(s + 1, np.int64), b + 1])
    e = np.concatenate([np.full((len(o), 1), floor), e], axis=1)
    z = e[:, first] + e[:, second]
    t = np.log((chi / 2)[:, None, None] * z[:, :, None] + ((1.0 - chi) / 2)[:, None, None] * z[:, None, :])
    for _ in range(2):  # recipients, then donors
        t[:, s + 1 :] += t[:, :1] - t[:, 1 + a] - t[:, 1 + b]
        t[:, 1 : s + 1] -= t[:, :1]
        t = t.transpose(0, 2, 1)
    o = np.concatenate([np.full((len(o), 1), ABSENT), o], axis=1)
    return o[:, first], o[:, second], t * n[:, None, None]


def quartet_terms(classes: DataFrame, chis: DataFrame, log_floor: float = -25.0) -> DataFrame:
    """``(sample, gene, chi_ord, i, j, k, m, term)``: log likelihoods of whole quartets folded over all reads, to be added up by :func:`folded_nll`.

    As in :func:`likelihood_terms` a class gives terms for its own candidates only: what each
    pair of recipients and pair of donors among them adds beyond its parts, ``ABSENT`` for none.
    Terms alike are added up inside a task before they travel.
    """
    floor = math.exp(log_floor)
    rows = classes.join(chis, GROUP).select(*GROUP, "chi_ord", "chi", F.transform("sig", lambda s: s["ord"].cast("int")).alias("o"), F.transform("sig", lambda s: F.exp(s["logw"])).alias("e"), F.col("n").cast("double").alias("n"), F.col("n_pool").cast("long").alias("n_pool"))
    schema = pa.schema([(c, pa.string()) for c in GROUP] + [(c, pa.int32()) for c in ("chi_ord", *"ijkm")] + [("term", pa.float64())])

    def run(batches):
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def folded():
            keys, values = (np.concatenate([h[i] for h in held], axis=-1) for i in (0, 1))
            order = np.lexsort(keys)
            keys, values = keys[:, order], values[order]
            at = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            return keys[:, at], np.add.reduceat(values, at)

        def out():
            keys, values = folded()
            listed = list(groups)
            columns = [pa.array([g[c] for g in listed], pa.string()).take(pa.array(keys[0])) for c in range(2)]
            pairs = [x - 1 for p in (1, 2) for x in (keys[p] >> 31, keys[p] & 0x7FFFFFFF)]
            of = np.array([g[2] for g in listed])[keys[0]]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(c.astype(np.int32)) for c in (of, *pairs)], pa.array(values)], schema=schema)

        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(*(col[c].to_pylist() for c in (*GROUP, "chi_ord")))], np.int64)
            lists, chi, n = col["o"], col["chi"].to_numpy(), col["n"].to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            begin = np.cumsum(sizes) - sizes
            o, e = lists.flatten().to_numpy().astype(np.int64), col["e"].flatten().to_numpy()
            for s in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == s)
                step = max(1, AT_ONCE // ((s + 1) * (s + 2) // 2) ** 2)
                for first in range(0, len(rows), step):
                    some = rows[first : first + step]
                    at = begin[some][:, None] + np.arange(s)
                    k, m, term = _class_terms(o[at], e[at], n[some], chi[some], floor)
                    pair = (k + 1) << 31 | (m + 1)
                    keys = np.stack([x.ravel() for x in np.broadcast_arrays(group[some][:, None, None], pair[:, :, None], pair[:, None, :])])
                    held.append((keys, term.ravel()))
                    size += term.size
                    if size >= HELD_TERMS:
                        held[:] = [folded()]
                        size = len(held[0][1])
                        if size >= HELD_TERMS // 2:
                            yield out()
                            held.clear()
                            size = 0
        if held:
            yield out()

    made = rows.mapInArrow(run, "sample string, gene string, chi_ord int, i int, j int, k int, m int, term double")
    return made.groupBy(*GROUP, "chi_ord", *"ijkm").agg(F.sum("term").alias("term"))


def folded_nll(terms: DataFrame, quartets: DataFrame) -> DataFrame:
    """``nll`` of listed quartets ``(sample, gene, i, j, k, m, chi_ord, chi)`` from :func:`quartet_terms`, but for the rounding of their sums: recipient pairs first, then donor pairs."""
    key = [*GROUP, "chi_ord"]

    def parts(a: str, b: str) -> Column:
        absent = F.lit(ABSENT)
        pairs = ((absent, absent), (F.col(a), absent), (F.col(b), absent), (F.col(a), F.col(b)))
        return F.explode(F.array(*[F.struct(p.alias("a"), q.alias("b")) for p, q in pairs])).alias("p")

    held = terms.groupBy(*key, F.col("i").alias("pi"), F.col("j").alias("pj")).agg(F.collect_list(F.struct(F.col("k").alias("pk"), F.col("m").alias("pm"), "term")).alias("t"))
    pairs = quartets.select(*key, "i", "j").distinct().select("*", parts("i", "j")).select(*key, "i", "j", F.col("p.a").alias("pi"), F.col("p.b").alias("pj"))
    found = pairs.join(held, [*key, "pi", "pj"]).select(*key, "i", "j", F.explode("t").alias("t"))
    summed = found.groupBy(*key, "i", "j", "t.pk", "t.pm").agg(F.sum("t.term").alias("term"))
    listed = quartets.select("*", parts("k", "m")).select(*key, "chi", *"ijkm", F.col("p.a").alias("pk"), F.col("p.b").alias("pm"))
    return listed.join(summed, [*key, "i", "j", "pk", "pm"]).groupBy(*key, "chi", *"ijkm").agg(F.sum(-F.col("term")).alias("nll"))


def quartet_nll(classes: DataFrame, quartets: DataFrame, log_floor: float = -25.0) -> DataFrame:
    """``nll`` of listed quartets ``(sample, gene, i, j, k, m, chi_ord, chi)``, exact, and the reads.

    The quartets of a group are one short row that meets each of its classes and is spelled out
    there; sums combine map-side to one row per quartet and task.
    """
    def value(i: Column) -> Column:
        hit = F.get(F.filter("sig", lambda s: s.ord == i), F.lit(0))
        return F.exp(F.coalesce(hit.logw, F.lit(float(log_floor))))

    likelihoods = F.transform(F.sequence(F.lit(0), F.col("n_pool") - 1), value).alias("e")
    listed = quartets.groupBy(*GROUP).agg(F.collect_list(F.struct("i", "j", "k", "m", "chi_ord", "chi")).alias("q"))
    x = classes.select(*GROUP, likelihoods, "n").join(listed, GROUP).select(*GROUP, "e", "n", F.explode("q").alias("q"))
    e = lambda slot: F.get("e", F.col(f"q.{slot}"))
    like = F.log(F.col("q.chi") / 2 * (e("i") + e("j")) + (1.0 - F.col("q.chi")) / 2 * (e("k") + e("m")))
    return x.groupBy(*GROUP, *[F.col(f"q.{c}").alias(c) for c in ("i", "j", "k", "m", "chi_ord", "chi")]).agg(F.sum(-F.col("n") * like).alias("nll"), F.sum("n").alias("n_reads"))


def fit_quartet_likelihood(read_families: DataFrame, families: DataFrame, chi: DataFrame, top_n: int | None = None, min_frac: float = 0.002,
                           forced: DataFrame | None = None, restrict: DataFrame | None = None,
                           chi_grid: tuple[float, float, float] | None = None, log_floor: float = -25.0,
                           chi_prior: float = 0.0, dose_prior: float = 0.0) -> DataFrame:
    """Quartet with the highest read likelihood: ``(sample, gene, quartet, nll, gap, chi_fit, n_reads)``.

    ``gap`` is the distance to the second-best (quartet, χ) of the search; priors are charges per read.

    The search is best-first. The logarithm is concave, so two recipient candidates add at
    most what each alone adds to a donor pair; that bounds every quartet from tables of donor
    pairs and single candidates, which are folded over the reads once. The most promising
    quartets get their exact value first; then only those whose bound reaches the second best of
    them. Where these are many, as they are once a group has many reads, the reads are folded into
    what pairs of pairs of candidates add, which values any number of quartets, and only those that
    may be among the first two meet the reads. The result is that of the full enumeration.
    """
    pool = candidate_pool(families, top_n, min_frac, forced, restrict)
    big_enough = pool.groupBy(*GROUP).agg(F.count("*").alias("c")).where("c >= 2").select(*GROUP)
    pool = cut_lineage(pool.join(big_enough, GROUP, "left_semi"))
    classes = cut_lineage(likelihood_classes(read_families.join(big_enough, GROUP, "left_semi"), pool))
    reads = classes.groupBy(*GROUP).agg(F.sum("n").alias("reads")).join(chi.select("sample", "chi_r"), "sample")
    chis = reads.select(*GROUP, F.posexplode(chi_values(F.col("chi_r"), chi_grid)).alias("chi_ord", "chi"))
    charge = chi_prior * F.col("reads") * F.abs(F.col("chi") - F.col("chi_r"))
    slots = three_slots(likelihood_terms(classes, chis, log_floor), pool).join(chis, [*GROUP, "chi_ord"]).join(reads, GROUP)
    # least: no quartet with this donor pair can have a smaller value
    slots = cut_lineage(slots.select(*GROUP, "chi_ord", "chi", "k", "m", "gains", "reads", (charge - F.col("base")).alias("base")).withColumn("least", F.col("base") - 2 * F.get("gains", F.lit(0))["gain"]))

    def bounded(rows: DataFrame, gains: Column) -> DataFrame:
        """Quartets of donor pairs with recipients from ``gains``, and the bound of each. A second copy of a candidate at most doubles a read's likelihood."""
        a = rows.select("*", F.posexplode(gains).alias("at", "a"))
        both = a.select("*", F.explode(F.slice(gains, F.col("at") + 1, F.size(gains))).alias("b"))
        return both.select(*GROUP, F.least("a.i", "b.i").alias("i"), F.greatest("a.i", "b.i").alias("j"), "k", "m", "chi_ord", "chi",
            (F.col("base") - F.col("a.gain") - F.when(F.col("a.i") == F.col("b.i"), F.least(F.col("b.gain"), F.col("reads") * math.log(2))).otherwise(F.col("b.gain"))).alias("bound"))

    members = pool.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("ord", "family", "fraction"))).alias("c"))
    q = F.array(*[F.get("c", F.col(x))["family"] for x in "ijkm"])

    def priced(scored: DataFrame) -> DataFrame:
        scored = scored.join(members, GROUP).join(reads.select(*GROUP, "chi_r"), GROUP)
        nll = F.col("nll") + chi_prior * F.col("n_reads") * F.abs(F.col("chi") - F.col("chi_r"))
        if dose_prior > 0:
            nll = nll + dose_prior * F.col("n_reads") * dose.quartet_residual(q, dose.fraction_lookup(F.col("c")), 1.0, F.col("chi"))
        return scored.select(*GROUP, q.alias("quartet"), "chi", "n_reads", F.round(nll, 9).alias("nll"), F.struct("i", "j", "k", "m", "chi_ord").alias("ord"))

    def exact(quartets: DataFrame) -> DataFrame:
        return priced(quartet_nll(classes, quartets, log_floor))

    def reach_of(values: DataFrame) -> DataFrame:
        """What a value must not exceed to be among the first two."""
        two = top_k(values, GROUP, [F.asc("nll"), F.asc("ord")], 2).groupBy(*GROUP).agg(F.max("nll").alias("second"), F.count("*").alias("n"))
        return cut_lineage(two.select(*GROUP, F.when(F.col("n") > 1, F.col("second") + TIE_NLL[0] + TIE_NLL[1] * F.abs("second")).otherwise(F.lit(float("inf"))).alias("reach")))

    tried = top_k(bounded(slots, F.slice("gains", 1, TRIED)), GROUP, [F.asc("bound"), *[F.asc(c) for c in ("i", "j", "k", "m", "chi_ord")]], FIRST_ROUND)
    reach = reach_of(exact(tried))
    left = bounded(slots.join(reach, GROUP).where("least <= reach"), F.col("gains")).join(reach, GROUP).where("bound <= reach")
    left = cut_lineage(left.select(*GROUP, *"ijkm", "chi_ord", "chi"))
    # a class meets every quartet that is left, or the pairs of pairs of its own candidates
    s = F.size("sig")
    folds = classes.groupBy(*GROUP).agg(F.count("*").alias("n_classes"), F.sum(F.pow((s + 1) * (s + 2) / 2, F.lit(2.0))).alias("folded"))
    grid = chis.groupBy(*GROUP).agg(F.count("*").alias("n_chi"))
    many = left.groupBy(*GROUP).agg(F.count("*").alias("n_left")).join(folds, GROUP).join(grid, GROUP).where("n_classes * n_left > folded * n_chi").select(*GROUP)
    many = cut_lineage(many)
    terms = quartet_terms(classes.join(many, GROUP, "left_semi"), chis, log_floor)
    values = folded_nll(terms, left.join(many, GROUP, "left_semi")).join(reads.select(*GROUP, F.col("reads").alias("n_reads")), GROUP)
    values = cut_lineage(priced(values))
    near = values.join(reach_of(values), GROUP).where("nll <= reach").select(*GROUP, "ord.*", "chi")
    listed = near.unionByName(left.join(many, GROUP, "left_anti"))
    two = top_k(exact(listed), GROUP, [F.asc("nll"), F.asc("ord")], 2)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return two.groupBy(*GROUP).agg(
        F.min_by("quartet", "rank").alias("quartet"), first("nll").alias("nll"), (F.max("nll") - F.min("nll")).alias("gap"),
        first("chi").alias("chi_fit"), first("n_reads").alias("n_reads"), F.count("*").alias("n_ranked"),
    ).withColumn("gap", F.when(F.col("n_ranked") > 1, F.col("gap"))).drop("n_ranked")


def forced_gap_zero(fit: DataFrame, forced_quartets: DataFrame) -> DataFrame:
    """Gap 0 where the winner equals a forced quartet listed in another slot order.

    A forced quartet whose pairs are not in pool order is searched a second time and
    ties with itself. ``forced_quartets``: ``(sample, gene, forced)``.
    """
    q, f = F.col("quartet"), F.col("forced")
    twice = (names.quartet_key(q) == names.quartet_key(f)) & (q != f)
    return fit.join(forced_quartets, GROUP, "left").withColumn("gap", F.when(twice, F.lit(0.0)).otherwise(F.col("gap"))).drop("forced")


def rescue_recipient_minor(fit: DataFrame, families: DataFrame, chi: DataFrame, min_frac: float = 0.001, min_count: float = 20.0,
                           max_frac: float = 0.08) -> DataFrame:
    """Replace a donor-like recipient pair by (heavier donor allele, minor allele).

    Applies when the recipient pair holds nothing the donor lacks and 0 < χ < 0.45. The
    minor allele is the heaviest credible family outside the donor pair without an
    expression suffix. Adds ``minor``; unchanged rows have it NULL.
    """
    f = family_fractions(families).select(*GROUP, "family", "weight", "fraction")
    j = fit.join(chi.select("sample", F.col("chi_r").alias("_chi")), "sample").join(f, GROUP)
    donors = F.slice("quartet", 3, 2)
    eligible = (
        F.forall(F.slice("quartet", 1, 2), lambda a: F.array_contains(F.slice("quartet", 3, 2), a))
        & (F.col("_chi") > 0) & (F.col("_chi") < 0.45) & ~F.array_contains(donors, F.col("family"))
        & ~names.has_expression_suffix("family") & (F.col("weight") >= min_count) & F.col("fraction").between(min_frac, max_frac)
    )
    d1, d2 = F.get("quartet", F.lit(2)), F.get("quartet", F.lit(3))
    pick = j.groupBy(*GROUP).agg(
        F.min_by(F.when(eligible, F.col("family")), F.when(eligible, F.struct(-F.col("weight"), F.col("family")))).alias("minor"),
        F.coalesce(F.max(F.when(F.col("family") == d1, F.col("weight"))), F.lit(0.0)).alias("w1"),
        F.coalesce(F.max(F.when(F.col("family") == d2, F.col("weight"))), F.lit(0.0)).alias("w2"),
    )
    out = fit.join(pick, GROUP, "left")
    shared = F.when(F.col("w1") >= F.col("w2"), d1).otherwise(d2)
    return out.withColumn("quartet", F.when(F.col("minor").isNotNull(), F.array(shared, F.col("minor"), d1, d2)).otherwise(F.col("quartet"))).drop("w1", "w2")


def collapse_low_private(fit: DataFrame, families: DataFrame, max_frac: float = 0.02, dose_ratio: float = 0.20, top_n: int = 4,
                         chi: str = "chi_fit") -> DataFrame:
    """Replace barely supported recipient-only alleles by a donor or top allele when that fits better.

    Recipient slots are tried one after the other; a replacement must lower the
    residual (over all families) by more than 1e-9. Adds ``collapsed`` (old→new texts)
    and refreshes ``score`` where something changed.
    """
    f = family_fractions(families).select(*GROUP, "family", "fraction", "ord")
    near = fit.select(*GROUP, "quartet").join(f, GROUP).where((F.col("ord") <= top_n) | F.array_contains("quartet", F.col("family")))
    near = near.groupBy(*GROUP).agg(
        F.collect_list(F.struct("family", "fraction")).alias("_f"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") <= top_n, F.struct("ord", "family")))), lambda s: s.family).alias("_top"),
    )
    d = fit.join(near, GROUP, "left")
    share = dose.fraction_lookup(F.col("_f"))
    c = F.col(chi)
    d = d.withColumns({
        "_q": F.col("quartet"),
        "_cands": F.array_distinct(F.concat(F.slice("quartet", 3, 2), F.coalesce("_top", F.array().cast("array<string>")))),
        "collapsed": F.array().cast("array<string>"),
    })
    for slot in (0, 1):
        allele = F.get("_q", F.lit(slot))
        frac = share(allele)
        tiny = ~F.array_contains(F.slice("_q", 3, 2), allele) & (frac < max_frac) & (frac < c / 2 * dose_ratio) & (c > 0) & (c < 0.5)
        current = F.round(dose.quartet_residual(F.col("_q"), share, 1.0, c), DIGITS)

        def trial(rep: Column, pos: Column) -> Column:
            t = F.array(*[rep if x == slot else F.get("_q", F.lit(x)) for x in range(4)])
            return F.struct(F.round(dose.quartet_residual(t, share, 1.0, c), DIGITS).alias("residual"), pos.alias("pos"), rep.alias("rep"))

        others = F.filter(F.transform("_cands", trial), lambda s: s.rep != F.get("_q", F.lit(slot)))
        d = d.withColumns({"_cur": current, "_best": F.array_min(others), "_tiny": tiny})
        hit = F.col("_tiny") & (F.col("_best.residual") < F.col("_cur") - 1e-9)
        replaced = F.array(*[F.col("_best.rep") if x == slot else F.get("_q", F.lit(x)) for x in range(4)])
        text = F.concat(F.get("_q", F.lit(slot)), F.lit("->"), F.col("_best.rep"))
        d = d.withColumns({
            "_q": F.when(hit, replaced).otherwise(F.col("_q")),
            "collapsed": F.when(hit, F.array_append("collapsed", text)).otherwise(F.col("collapsed")),
        })
    changed = F.size("collapsed") > 0
    d = d.withColumn("quartet", F.col("_q"))
    if "score" in fit.columns:
        d = d.withColumn("score", F.when(changed, F.round(dose.quartet_residual(F.col("_q"), share, 1.0, c), DIGITS)).otherwise(F.col("score")))
    return d.drop("_f", "_top", "_q", "_cands", "_cur", "_best", "_tiny")


def quartet_residuals(quartets: DataFrame, families: DataFrame, chi: str = "chi_r", out: str = "residual", digits: int = DIGITS) -> DataFrame:
    """Residual over all families of any table of quartets ``(sample, gene, quartet, chi)``.

    Every distinct slot allele looks up its share once; the rest of the sum is the total.
    """
    members = quartets.select(*GROUP, "quartet").distinct().withColumn("family", F.explode(F.array_distinct("quartet")))
    f = family_fractions(families).select(*GROUP, "family", "fraction")
    shares = members.join(f, [*GROUP, "family"], "left").groupBy(*GROUP, "quartet").agg(
        F.collect_list(F.struct("family", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))).alias("_f")
    )
    value = dose.quartet_residual(F.col("quartet"), dose.fraction_lookup(F.col("_f")), 1.0, F.col(chi))
    return quartets.join(shares, [*GROUP, "quartet"]).withColumn(out, F.round(value, digits)).drop("_f")
