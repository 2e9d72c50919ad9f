"""Registered queries of the corpus operators and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadhap.llm import bpe_encode, decontaminate, fill_middle, language, near_vectors, nearest, passages, pii, prefix_trie, simhash, templates, token_counts, token_files
from quadhap.llm.common import table, vocabulary_file

#: Searches take every row whose id is divisible by this as a query.
QUERY_STEP = 20
TOKEN_LIMIT = 512


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.summarise(pii.find_pii(table(spark, folder, "documents")))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("id") % QUERY_STEP == 0)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.all_passages(table(spark, folder, "documents")).drop("row")


def op6_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.summarise(templates.drop_recurring(table(spark, folder, "documents")))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judge(decontaminate.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_encode.round_trip(table(spark, folder, "documents"), vocabulary_file("byte_bpe_multi_50k.tiktoken"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, folder, "conversations"))


def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.summarise(fill_middle.fill_in_middle(table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_language, op3_nearest, op4_simhash, op5_passages, op6_templates, op7_token_files, op8_decontaminate, op9_token_counts, op10_bpe, op11_prefix_trie, op12_near_vectors, op13_fill_middle)
}

_FOLDED = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAMINATE_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS id, {_FOLDED} AS ws FROM benchmark),
windows AS (SELECT id, len(w) AS size, array_to_string(w, ' ') AS w FROM (SELECT id, unnest([ws[i:i + least(len(ws), {decontaminate.WINDOW}) - 1] for i in range(1, len(ws) - least(len(ws), {decontaminate.WINDOW}) + 2)]) AS w FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS ws FROM documents),
places AS (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM docs, sizes WHERE len(ws) >= size),
found AS (SELECT DISTINCT p.r, p.pos, p.size, w.id FROM (SELECT r, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS w FROM places) p JOIN windows w ON p.size = w.size AND p.w = w.w),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS k FROM found) GROUP BY r),
ids AS (SELECT r, count(DISTINCT id) AS n_items, sha256(string_agg(DISTINCT id, ',' ORDER BY id)) AS digest FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""

NEAREST_SQL = f"""
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= {nearest.K}"""

ORACLES: dict[str, str] = {"op3_nearest": NEAREST_SQL, "op6_templates": templates.oracle(), "op8_decontaminate": DECONTAMINATE_SQL, "op11_prefix_trie": prefix_trie.oracle(), "op12_near_vectors": near_vectors.oracle(), "op13_fill_middle": fill_middle.oracle()}
