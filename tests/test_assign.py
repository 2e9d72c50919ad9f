"""Family support and overlaps of reads dealt to tasks by their number."""

import random

from pyspark.sql import functions as F

from quadhap.operators import assign


def test_a_task_gets_a_bounded_number_of_alignments(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice("st"), f"r{i}", f, rng.randint(0, 20)) for i in range(400) for f in rng.choices("abcd", k=rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "sample string, qname string, family string, score int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    plain = [sorted(map(tuple, d.collect())) for d in (assign.family_support(df), assign.family_overlaps(df, pairs))]
    monkeypatch.setattr(assign, "TASK_ROWS", 40)
    held = assign._flagged(df, 5).groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in held) == len(rows) and max(r.n for r in held) < 4 * 40
    assert [sorted(map(tuple, d.collect())) for d in (assign.family_support(df), assign.family_overlaps(df, pairs))] == plain
