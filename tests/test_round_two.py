"""Missing numbers, ties and unlabelled rows."""

from pyspark.sql import functions as F

from loanloom.functions.loan import fixed_text
from loanloom.operators.features import stratified_test_flag
from loanloom.operators.ranked import running_totals


def test_nan_is_not_ranked(spark):
    df = spark.createDataFrame([(-5.0,), (float("nan"),), (3.0,), (7.0,)], "x double")
    got = running_totals(df, "x", {"n": F.lit(1)}).collect()
    assert sorted((r.x, r.n_before) for r in got) == [(-5.0, 0), (3.0, 1), (7.0, 2)]


def test_exact_ties_print_to_even(spark):
    values = [0.0625, 2.5625, 0.0005, -0.1875, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(fixed_text(F.col("x"))).collect()] == [f"{v:.3f}" for v in values]


def test_unlabelled_rows_stay(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", None), ("d", 1)], "loan_id string, label int")
    rows = {r.loan_id: r.is_test for r in stratified_test_flag(df, 0.5).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["c"] is False
