"""Steps of the call table that may not grow into joins and shuffles of their own."""

from quadhap.operators import calls
from quadhap.plans import REGISTRY


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_ggroups_in_one_join(spark):
    gg = spark.createDataFrame([("A*01:01", "x"), ("A*02:01:01", "y"), ("A*03:01:01", "z"), ("A*03:01", "first"), ("A*04:01:02:01", "w")], "member string, grp string")
    names = ["A*01:01", "HLA-A*02:01", "A*02:01:01N", "A*03:01", "A*04:01:02", "A*04:01", "A*05:01", "A*01:01G", "A*01", None]
    df = calls.attach_ggroup(spark.createDataFrame([(n,) for n in names], "a string"), "a", gg, "g")
    assert joins(df) == 1
    assert {r.a: r.g for r in df.collect()} == dict(zip(names, ["x", "y", "y", "first", "w", "A*04:01", "A*05:01", "A*01:01G", "A*01", "NA"]))


def test_copy_fit_without_join(spark):
    df = spark.createDataFrame([(["a", "b", "a", "NA"], [0.25, 0.5, 0.25, None], 0.3), (["NA"] * 4, [None] * 4, None)], "families array<string>, support array<double>, chi_r double")
    fit = calls.fit_copy_fractions(df)
    assert joins(fit) == 0
    assert [r.copies is None for r in fit.collect()] == [False, True]


def test_call_table_joins_groups_only(spark):
    # calls, families, mask and χ once each, and the nomenclature
    assert joins(REGISTRY["final_calls"].run(spark, "/root/testdata/sf0.001")) <= 5
