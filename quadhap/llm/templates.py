"""Recurring line templates, found with a fixed-depth parse tree in column functions only.

A line's tokens (runs of other than space, tab, form feed and carriage return) that hold a
digit are variable fields and read ``<*>``. The tree's levels are the token count and the first
``DEPTH`` tokens. Leaves that occur in few contexts cannot hold a recurring template and are
left at once. In the others, the most frequent line is the leaf's template; lines that agree
with it in at least ``SIMILAR`` of their tokens belong to it and their other tokens are
variable; each remaining line is a template of its own.

A template recurs if it occurs between at least ``CONTEXTS`` different pairs of neighbouring
lines, and those are at least half of the different texts that hold it: boilerplate stands in
ever different company, while the lines of copied documents keep theirs. All lines of recurring
templates are dropped, and nothing else of a text changes.

Lines, contexts and templates are told apart by 64-bit hashes, texts by MD5.

Defined cases: a null text stays null and has no lines; empty lines are never dropped; equal
texts get equal results, so repeated rows need no care; an empty table gives an empty result;
columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadhap.llm.common import cut_lineage, unused

DEPTH = 3
SIMILAR = 0.6
CONTEXTS = 10
_SPACE = r"[ \t\r\f]+"
_FIELD = "<*>"


def masked(text: Column) -> Column:
    """Tokens with a digit as ``<*>``, single spaces, none at the ends of lines."""
    fields = F.regexp_replace(text, r"[^ \t\r\f\n]*[0-9][^ \t\r\f\n]*", _FIELD)
    return F.regexp_replace(F.regexp_replace(fields, _SPACE, " "), r"(?m)^ | $", "")


def text_key(text: Column) -> Column:
    return F.md5(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """``key, pos, line, leaf, context`` of the non-empty lines: masked line, its place in the tree, and its neighbours' hash. Rows with equal texts have equal keys."""
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").select(text_key(F.col("text")).alias("key"), masked(F.col("text")).alias("masked"))
    neighbours = F.transform(
        F.array(F.split("masked", "\n", -1)),
        lambda ls: F.transform(
            ls,
            lambda l, i: F.struct(
                i.alias("pos"), l.alias("line"),
                F.xxhash64(F.coalesce(F.try_element_at(ls, F.when(i > 0, i).otherwise(F.size(ls) + 1)), F.lit("\n")), F.coalesce(F.try_element_at(ls, i + 2), F.lit("\n"))).alias("context"),
            ),
        ),
    )
    rows = text.select("key", F.inline(F.flatten(neighbours))).where("line <> ''")
    lead = F.substring_index("line", " ", DEPTH)
    return rows.withColumn("leaf", F.xxhash64(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))), lead))


def recurring_lines(docs: DataFrame, contexts: int = CONTEXTS, similar: float = SIMILAR) -> DataFrame:
    """``key, pos``: the lines to drop of each text."""
    lines = lines_of(docs)
    # a context counts once for each leaf, however often it occurs
    spread = lines.groupBy("leaf", "context").agg(F.lit(1).alias("one")).groupBy("leaf").count()
    # stored tables on both sides of a join let it split a leaf or line that very many rows share
    common = cut_lineage(spread.where(F.col("count") >= contexts).select("leaf"))
    open_lines = cut_lineage(lines.join(common, "leaf", "left_semi"))
    kinds = cut_lineage(open_lines.groupBy("leaf", "line").agg(F.count("*").alias("n")))
    most = F.struct((-F.col("n")).alias("n"), "line")
    tops = cut_lineage(kinds.groupBy("leaf").agg(F.min(most)["line"].alias("top")))
    same = F.size(F.filter(F.zip_with(F.split("line", " "), F.split("top", " "), lambda a, b: a == b), lambda x: x))
    belongs = same >= similar * F.size(F.split("line", " "))
    template = F.when(belongs, F.col("top")).otherwise(F.col("line"))
    named = cut_lineage(kinds.join(tops, "leaf").select("leaf", "line", F.xxhash64("leaf", template).alias("template")))
    marked = cut_lineage(open_lines.join(named, ["leaf", "line"]).select("key", "pos", "context", "template"))
    seen = marked.groupBy("template").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("texts"))
    dropped = cut_lineage(seen.where((F.col("contexts") >= contexts) & (2 * F.col("contexts") >= F.col("texts"))).select("template"))
    return marked.join(dropped, "template", "left_semi").select("key", "pos")


def drop_recurring(docs: DataFrame, contexts: int = CONTEXTS, similar: float = SIMILAR) -> DataFrame:
    """The documents, columns kept, without the lines of recurring templates, and ``dropped_lines``: their numbers, from 0."""
    gone = recurring_lines(docs, contexts, similar).groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    key, cut = (unused(name, docs) for name in ("gone_key", "gone"))
    gone = cut_lineage(gone.withColumnsRenamed({"key": key, "gone": cut}))  # stored, so the join can split a text with very many copies
    text = F.col("text").cast("string")
    joined = docs.join(gone, text_key(text) == F.col(key), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda l, i: ~F.array_contains(cut, i)), "\n")
    changed = F.when(F.col(cut).isNull(), text).otherwise(kept)
    none = F.array().cast("array<int>")
    return joined.select(*(changed.alias(c) if c == "text" else docs[c] for c in docs.columns if c != "dropped_lines"), F.coalesce(cut, none).alias("dropped_lines"))


def summarise(cleaned: DataFrame) -> DataFrame:
    """Counts and digest of :func:`drop_recurring`'s texts."""
    kept = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return cleaned.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), kept.cast("bigint").alias("n_kept"), F.size("dropped_lines").cast("bigint").alias("n_dropped"),
        F.array_join("dropped_lines", ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def oracle() -> str:
    """The same in DuckDB SQL. There, templates are compared as texts and contexts as pairs of lines."""
    digit = r"[^ \t\r\f\n]*[0-9][^ \t\r\f\n]*"
    return f"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
split AS (SELECT text, list_transform(string_split(regexp_replace(regexp_replace(text, '{digit}', '{_FIELD}', 'g'), '{_SPACE}', ' ', 'g'), chr(10)), lambda l: regexp_replace(regexp_replace(l, '^ ', ''), ' $', '')) AS ls FROM texts),
positions AS (SELECT text, ls, unnest(range(0, len(ls))) AS pos FROM split),
lines AS (SELECT text, pos, ls[pos + 1] AS line, CASE WHEN pos > 0 THEN ls[pos] ELSE chr(10) END AS before, CASE WHEN pos + 1 < len(ls) THEN ls[pos + 2] ELSE chr(10) END AS behind FROM positions WHERE ls[pos + 1] <> ''),
leafed AS (SELECT *, len(string_split(line, ' ')) AS n_tokens, array_to_string(string_split(line, ' ')[1:{DEPTH}], ' ') AS lead FROM lines),
common AS (SELECT n_tokens, lead FROM (SELECT DISTINCT n_tokens, lead, before, behind FROM leafed) GROUP BY ALL HAVING count(*) >= {CONTEXTS}),
opened AS (SELECT l.* FROM leafed l SEMI JOIN common c ON l.n_tokens = c.n_tokens AND l.lead = c.lead),
kinds AS (SELECT n_tokens, lead, line, count(*) AS n FROM opened GROUP BY ALL),
tops AS (SELECT n_tokens, lead, line AS top FROM kinds QUALIFY row_number() OVER (PARTITION BY n_tokens, lead ORDER BY n DESC, line) = 1),
named AS (SELECT k.n_tokens, k.lead, k.line,
  CASE WHEN len(list_filter(range(1, k.n_tokens + 1), lambda i: string_split(k.line, ' ')[i] = string_split(t.top, ' ')[i])) >= {SIMILAR} * k.n_tokens THEN t.top ELSE k.line END AS template
  FROM kinds k JOIN tops t ON k.n_tokens = t.n_tokens AND k.lead = t.lead),
marked AS (SELECT o.text, o.pos, o.before, o.behind, n.n_tokens, n.lead, n.template FROM opened o JOIN named n ON o.n_tokens = n.n_tokens AND o.lead = n.lead AND o.line = n.line),
dropped AS (SELECT n_tokens, lead, template FROM marked GROUP BY ALL HAVING count(DISTINCT (before, behind)) >= {CONTEXTS} AND 2 * count(DISTINCT (before, behind)) >= count(DISTINCT text)),
gone AS (SELECT m.text, list(DISTINCT m.pos ORDER BY m.pos) AS gone FROM marked m SEMI JOIN dropped d ON m.n_tokens = d.n_tokens AND m.lead = d.lead AND m.template = d.template GROUP BY m.text),
done AS (SELECT d.doc_id, d.text, g.gone, list_transform(list_filter(range(0, len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(coalesce(g.gone, []), i)), lambda i: string_split(d.text, chr(10))[i + 1]) AS kept FROM documents d LEFT JOIN gone g ON d.text = g.text)
SELECT doc_id, coalesce(len(kept), 0)::BIGINT AS n_kept, coalesce(len(gone), 0)::BIGINT AS n_dropped, coalesce(array_to_string(gone, ','), '') AS dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM done"""
