"""Evaluation meets calls and truth in one shuffle."""

import random
from collections import Counter

from quadhap.operators import evaluate
from quadhap.plans import REGISTRY


def test_overlap_counts_repeats(spark):
    rng = random.Random(8)
    names = ["A*01:01", "A*01:02", "A*02:01", "NA"]
    calls = [(f"s{i}", "PATIENT", "A", rng.choice(names)) for i in range(30) for _ in range(rng.randint(0, 3))]
    truth = [(f"s{i}", "PATIENT", "A", rng.choice(names)) for i in range(30) for _ in range(rng.randint(0, 3))]
    schema = "sample string, side string, gene string, allele string"
    gg = spark.createDataFrame([("A*01:01:01", "A*01:01:01G")], "member string, grp string")
    got = evaluate.evaluate_calls(spark.createDataFrame(calls + [(None, "PATIENT", "A", "NA")], schema), spark.createDataFrame(truth, schema), gg, ("2field",)).collect()
    c, t = ({k: Counter(a for s, _, _, a in rows if s == k) for k in {s for s, *_ in rows}} for rows in (calls, truth))
    assert {r["sample"]: (r.hits, r.total) for r in got} == {s: (sum((c[s] & t[s]).values()), sum(t[s].values())) for s in set(c) & set(t)}


def test_two_fields_need_no_join(spark):
    plan = REGISTRY["evaluate_two_field"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan
