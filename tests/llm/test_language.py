"""Language mixtures: held-out accuracy, proportions, defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quadhap.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("out", language.held_out(F.col("doc_id"))).collect()
    out = [r for r in rows if r["out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["mixture"].values()) - 1) < 1e-6 for r in rows)


def test_mixture_is_found(spark, documents):
    model = language.fit(documents)
    text = {lang: documents.where(f"lang = '{lang}'").orderBy("doc_id").first()["text"] * 20 for lang in ("de", "fr")}
    both = text["de"][:4000] + "\n" + text["fr"][:2000]
    (lang, score, mix), (pure, one, _) = language.infer([both, text["de"][:4000]], model)
    assert lang == "de" and set(mix) == {"de", "fr"} and 0.5 < score < 0.85
    assert pure == "de" and one == 1.0


def test_long_texts_are_fitted_whole(documents):
    model = language.fit(documents)
    text = {lang: documents.where(f"lang = '{lang}'").orderBy("doc_id").first()["text"] for lang in ("en", "es")}
    long = (text["en"] + " ") * 20 + (text["es"] + " ") * (400_000 // len(text["es"]))
    assert language.infer([long], model)[0][0] == "es"


def test_defined_cases(make):
    rows = [(5, "the cat sat on the mat and the dog", "en"), (1, "der hund und die katze sind hier", "de"), (2, None, "en"), (3, "", None), (4, "12 … !!", "de"), (None, "the dog", "en"), (5, "the cat sat on the mat and the dog", "en"), (7, "x", None), (8, "é", "fr"), (9, "中", None)]
    docs = make([r for r in rows for _ in range(2)])
    found = language.predict(docs, language.fit(docs)).collect()
    assert len(found) == 20
    by_id = {r["doc_id"]: r["lang_pred"] for r in found}
    assert by_id[2] == by_id[3] == by_id[4] == "und" and by_id[7] != "und" and by_id[8] != "und" and by_id[9] != "und" and by_id[5] == "en"
    kept = language.keep_known(docs, language.fit(docs))
    assert kept.columns == docs.columns and kept.count() == 14


def test_nothing_to_learn_and_empty(make):
    docs = make([(1, "abc"), (2, None)])
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs)).collect()} == {"und"}
    none = docs.where("doc_id > 9")
    assert language.predict(none, language.fit(none)).count() == 0
