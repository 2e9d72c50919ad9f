"""Fill-in-the-middle transformation with one counted-quantifier match per text.

A text is a row of units: white space with the word behind it, or white space alone. Their
number comes from ``regexp_count``; the two cuts are drawn from a hash of the document's id.
A pattern made for the row, ``(unit{a})(unit{b-a})(rest)`` with possessive quantifiers, captures
prefix, middle and suffix in one match. Possessive quantifiers also keep the matcher from
recursing once per unit, so texts of any length fit its stack.

Defined cases: null and empty texts are ``plain`` with no units; so are texts that hold a marker
themselves, whatever was drawn, because they could not be taken apart again; prefix, middle or
suffix may be empty; a null id draws like an empty string; repeated rows and ids are treated
row by row; an empty table gives an empty result. Other columns pass through; one named like
an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Shares in percent: of texts that change, and of those that put the suffix first.
RATE = 50
SUFFIX_FIRST = 80


def draws(doc_id: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """The first ``n`` 32-bit numbers of a document's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents with ``n`` (units), ``form`` (plain, psm, spm), ``output``, ``prefix_chars`` and ``middle_chars``; ``text`` is never null."""
    made = ("text", "n", "form", "output", "prefix_chars", "middle_chars")
    others = [docs[c] for c in docs.columns if c not in made]
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(*others, text.alias("text")).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    marked = F.exists(F.array(*map(F.lit, (PREFIX, SUFFIX, MIDDLE))), lambda m: F.contains(F.col("text"), m))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [h % (F.col("n") + 1) for h in (h1, h2)]
    first, second = F.least(*cuts), F.greatest(*cuts)
    units = lambda count: F.concat(F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), units(first), units(second - first), F.lit("(.*)"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    done = counted.withColumn("form", form).withColumn("output", output)
    # parts hold no marker, so each marker occurs once in a changed output
    at = {m: F.instr("output", m) for m in (PREFIX, SUFFIX, MIDDLE)}
    behind_prefix = F.when(F.col("form") == "psm", at[SUFFIX]).otherwise(at[MIDDLE])
    changed = lambda c: F.when(F.col("form") != "plain", c.cast("bigint"))
    return done.withColumns({
        "prefix_chars": changed(behind_prefix - at[PREFIX] - len(PREFIX)),
        "middle_chars": changed(F.length("output") - at[MIDDLE] + 1 - len(MIDDLE)),
    })


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def summarise(changed: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, the last from output and form alone."""
    back = restored(F.col("output"), F.col("form"))
    return changed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def oracle() -> str:
    """The same rows in DuckDB: units listed one by one and joined again."""
    draw = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (SELECT *, len(u)::BIGINT AS n, least({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1)) AS a, greatest({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {draw(2)} % 100 >= {RATE} THEN 'plain' WHEN {draw(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (SELECT *, {part(1, 'a')} AS p, {part('a + 1', 'b')} AS m, {part('b + 1', 'n')} AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM parts"""
