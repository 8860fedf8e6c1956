"""The default-prediction workflow end to end, with small learners."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from checks import views
from loanloom.operators import evaluate as E
from loanloom.operators import features as X
from loanloom.operators import models as M
from loanloom.operators.joins import zip_centroids
from loanloom.plans import default_model as D
from loanloom.session import materialized


@pytest.fixture(scope="module")
def prepared(spark, data):
    combined = D.combined_table(views.loan_acq(spark, data), views.loan_perf(spark, data), "row_seq")
    rows = materialized(D.model_rows(combined, zip_centroids(views.zips(spark, data))))
    prep = D.learn_preparation(rows)
    vectors = materialized(prep.assemble(rows))
    return rows, prep, vectors, X.stratified_split(vectors, 0.25)


def test_preparation_is_complete(prepared):
    rows, prep, vectors, (train, test) = prepared
    assert vectors.count() == rows.count() == train.count() + test.count()
    assert len(vectors.first()["features"]) == len(prep.feature_names) == len(set(prep.feature_names))
    shares = vectors.groupBy("label").count().join(
        test.groupBy("label").agg(F.count("*").alias("t")), "label"
    )
    for r in shares.collect():
        assert abs(r["t"] - r["count"] * 0.25) <= 0.5


def test_later_cohort_uses_the_fitted_levels(prepared):
    rows, prep, _, _ = prepared
    later = rows.withColumn("state", F.lit("ELSEWHERE"))
    assert prep.apply(later).columns == prep.apply(rows).columns


def test_forest(spark, prepared):
    _, prep, _, (train, test) = prepared
    forest = M.forest(train, trees=5, depth=3)
    assert sum(E.confusion_counts(M.score(forest, test)).first()) == test.count()
    top = M.importance(spark, forest, prep.feature_names, 20).collect()
    assert len(top) == 20 and top[0]["score"] >= top[-1]["score"]


def test_any_number_may_be_missing(prepared):
    rows, prep, _, _ = prepared
    gone = rows.withColumns({c: F.lit(None).cast("double") for c in ("orig_rt", "log_oltv", "latitude")})
    assert prep.assemble(gone).count() == rows.count()
    assert prep.frame(gone).columns[2:] == prep.open_names


def test_driver_contract(spark, data):
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    report = entry_points.entry(spark)
    assert report.columns[0] == "vin_yr" and report.count() > 1


def test_partitions_grow_in_number(spark, monkeypatch):
    df = spark.createDataFrame([(i % 500, None if i % 7 == 0 else float(i)) for i in range(1000)], "loan_id int, x double").coalesce(1)
    assert X.in_small_parts(df) is df
    monkeypatch.setattr(X, "PARTITION_ROWS", 50)
    parts = X.in_small_parts(df)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 100
    assert sorted(map(str, parts.collect())) == sorted(map(str, df.collect()))
