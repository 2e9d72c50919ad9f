"""The pipeline against its stages' brute-force forms, and the registered queries."""

import base64
import hashlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quadhap.llm import language, templates
from quadhap.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import FOLDER
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash import plain_classes, plain_fingerprint


def test_pipeline_against_plain(spark, documents):
    model = language.fit(documents)
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    known = [d for d, (lang, _, _) in zip(docs, language.infer([t for _, t in docs], model)) if lang != "und"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", known)
    dropped = {r[0]: {int(p) for p in r[1].split(",") if p} for r in con.execute(f"SELECT doc_id, dropped FROM ({templates.oracle()})").fetchall()}
    cut = {d: "\n".join(line for i, line in enumerate(t.split("\n")) if i not in dropped[d]) for d, t in known}
    component = plain_classes({d: plain_fingerprint(t) for d, t in cut.items()})
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {d: t for d, t in cut.items() if component[d] == d}
    clean = {d: t for d, t in kept.items() if not plain_hits(t, items, 13)[4]}
    assert len(clean) < len(kept) < len(docs)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d, t in clean.items():
        ids = library.encode_ordinary(t)
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert set(got) == want and len(got) == len(want)


def test_stages_keep_columns_and_take_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, "12"), (None, "some words in a row"), (4, "some words in a row"), (4, "some words in a row"), (5, "w " * 30_000)] + [(10 + i, f"the text number {i}", "en") for i in range(20)]
    docs = make(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert name == "encoding" or out.columns == docs.columns
        assert stage(spark, docs.where("doc_id > 999"), FOLDER).count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_every_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        order = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
