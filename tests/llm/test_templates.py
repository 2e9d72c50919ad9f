"""Line templates against the SQL, and on planted boilerplate."""

import duckdb
from pyspark.sql import functions as F

from quadhap.llm import templates


def agree(docs):
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    cur = con.execute(templates.oracle())
    names = [d[0] for d in cur.description]
    got = sorted(map(repr, (tuple(r) for r in templates.summarise(templates.drop_recurring(docs)).select(*names).collect())))
    assert got == sorted(map(repr, cur.fetchall()))


def filler(i):
    return f"line {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)} of its own"


def test_boilerplate_goes_and_copies_stay(make):
    rows = [(i, f"{filler(i)}\nPosted by user{i} on day {i}\n{filler(i + 40)}") for i in range(12)]
    copied = "\n".join(filler(200 + i) for i in range(5))
    rows += [(100 + i, copied) for i in range(30)]
    rows += [(200 + i, f"{filler(300 + i)}\nWritten long ago by the old hand {'abcdefghijkl'[i]}\n{filler(340 + i)}") for i in range(12)]
    docs = make(rows)
    out = {r["doc_id"]: r for r in templates.drop_recurring(docs).collect()}
    assert all(out[i]["text"] == f"{filler(i)}\n{filler(i + 40)}" and out[i]["dropped_lines"] == [1] for i in range(12))
    assert all(out[100 + i]["text"] == copied for i in range(30))
    assert all(out[200 + i]["dropped_lines"] == [1] for i in range(12))
    agree(docs)


def test_defined_cases(make):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x " * 50_000), (None, "a\nb"), (5, "a\nb"), (5, "a\nb"), (6, " lead\ttab \n1 2 3\n<*>"), (7, "é 中\r\nü")]
    rows += [(20 + i, f"{filler(i)}\nThe same line\n") for i in range(11)]
    docs = make(rows)
    out = templates.drop_recurring(docs)
    assert out.columns == [*docs.columns, "dropped_lines"] and out.count() == len(rows)
    same = {r["doc_id"]: r["text"] for r in out.collect()}
    assert same[1] is None and same[2] == "" and same[3] == "\n\n" and same[20] == f"{filler(0)}\n"
    agree(docs)
    assert templates.drop_recurring(docs.where("doc_id > 999")).count() == 0


def test_columns_with_its_own_names(make):
    docs = make([(20 + i, f"{filler(i)}\nThe same line\n") for i in range(11)])
    for name in ("gone", "gone_key", "key", "Gone", "dropped_lines", "line", "pos"):
        docs = docs.withColumn(name, F.lit(name)) if name != "Gone" else docs
    out = templates.drop_recurring(docs)
    assert out.columns == [*(c for c in docs.columns if c != "dropped_lines"), "dropped_lines"]
    assert all(r["dropped_lines"] == [1] and r["gone"] == "gone" and r["gone_key"] == "gone_key" for r in out.collect())


def test_real_rows(documents):
    agree(documents)
