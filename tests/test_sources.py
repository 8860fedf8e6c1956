"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from checks import views
from loanloom import schema
from loanloom.operators import features as X
from loanloom.operators.joins import cohort_overlap, outer_join, outer_join_unique
from loanloom.plans.default_model import combined_table
from loanloom.plans.loan_table import build_loan_table
from loanloom.plans.reports import status_counts
from loanloom.sources import readers, writers


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """Two quarterly file pairs that share some loan ids."""
    root = tmp_path_factory.mktemp("files")
    acq = views.loan_acq(spark, data)
    perf = views.loan_perf(spark, data).drop("row_seq").coalesce(1)
    for q, part in (("2007Q3", "loan_id < '000000000800'"), ("2007Q4", "loan_id >= '000000000700'")):
        for name, df in (("Acquisition", acq), ("Performance", perf)):
            out = df.filter(part).toPandas()
            out.to_csv(root / f"{name}_{q}.txt", sep="|", header=False, index=False)
    return str(root)


def test_schemas():
    assert [len(s.fields) for s in (schema.ACQUISITION, schema.PERFORMANCE, schema.COMBINED)] == [25, 31, 55]


def test_read_and_prune(spark, folder):
    acq = readers.read_acquisitions(spark, f"{folder}/Acquisition_2007Q3.txt")
    assert acq.schema == schema.ACQUISITION or acq.columns == schema.ACQUISITION.fieldNames()
    assert acq.filter("zip_3 = '007'").count() > 0  # leading zeros survive
    assert acq.filter("dti is null").count() > 0 and acq.filter("num_bo = ''").count() == 0
    cut = readers.read_performance(spark, f"{folder}/Performance_*.txt", ["loan_id", "fcc_dte"])
    scan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<loan_id:string,fcc_dte:string>" in scan


def test_quarters_stay_apart(spark, folder):
    acq, perf = readers.read_quarters(spark, folder)
    assert {r[0] for r in acq.select("quarter").distinct().collect()} == {"2007Q3", "2007Q4"}
    keys = ("quarter", "loan_id")
    loans = build_loan_table(acq, perf, keys=keys)
    twice = loans.groupBy("loan_id").count().filter("count = 2").count()
    assert twice > 0
    assert loans.count() == acq.select(*keys).union(perf.select(*keys)).distinct().count()


def test_combined_round_trip(spark, data, tmp_path):
    combined = combined_table(views.loan_acq(spark, data), views.loan_perf(spark, data).drop("row_seq"))
    assert combined.columns == schema.COMBINED.fieldNames()
    writers.write_combined(combined, str(tmp_path / "c"))
    back = readers.read_combined(spark, str(tmp_path / "c"))
    assert back.exceptAll(combined).count() == 0 and combined.exceptAll(back).count() == 0
    few = readers.read_combined(spark, str(tmp_path / "c"), ["loan_id", "delq_status", "zero_bal_code", "disp_dt"])
    assert few.count() == combined.count()


def test_cohort_and_zip_files(spark, tmp_path):
    (tmp_path / "cohort.txt").write_text("Default|x\n1|2.5\n0|3.5\n")
    assert readers.read_cohort(spark, str(tmp_path / "cohort.txt")).agg(F.sum("x")).first()[0] == 6
    (tmp_path / "zips.csv").write_text("zipcode,latitude,longitude\n00501,40.8,-73.0\n")
    assert readers.read_zip_dimension(spark, str(tmp_path / "zips.csv")).first()["zipcode"] == "00501"


def test_snapshot_and_reports(spark, data, tmp_path):
    loans = views.loan_acq(spark, data).select("loan_id", F.substring("orig_dte", 4, 4).alias("vin_yr"))
    writers.write_snapshot(loans, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("vin_yr = 1997").count() > 0
    report = status_counts(loans, "vin_yr")
    writers.write_reports({"by_year": report, "again": report}, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r/by_year")).count() == report.count()


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_outer_joins_with_and_without_a_hot_key(spark, limit):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "loan_id string, x int")
    right = spark.createDataFrame([("a", 9), ("c", 8)], "loan_id string, y int")
    want = {("a", 1, 9), ("a", 2, 9), ("a", 3, 9), ("b", 4, None), ("c", None, 8)}
    for join in (outer_join, outer_join_unique):
        got = join(left, right, ("loan_id",), limit).select("loan_id", "x", "y").collect()
        assert {tuple(r) for r in got} == want and len(got) == 5


def test_overlap_sides(spark):
    x = spark.createDataFrame([("a", 1), ("b", 2)], "loan_id string, v int")
    y = spark.createDataFrame([("b", 3), ("c", 4)], "loan_id string, v int")
    out = {r["loan_id"]: (r["v_x"], r["v_y"], r["side"]) for r in cohort_overlap(x, y).collect()}
    assert out == {"a": (1, None, "left_only"), "b": (2, 3, "both"), "c": (None, 4, "right_only")}


def test_unseen_levels_have_only_zeros(spark):
    fit = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "c string")
    later = spark.createDataFrame([("q",), ("z",)], "c string")
    known = X.levels(fit, ["c"])
    assert [tuple(r) for r in X.one_hot(later, ["c"], known).collect()] == [(0, 0), (0, 1)]


def test_imputation_fills_every_gap(spark, data):
    df = views.loan_acq(spark, data).select("orig_rt", "oltv", "dti", "num_bo")
    out = X.impute(df, ["dti", "num_bo"], ["orig_rt", "oltv"])
    assert out.columns == df.columns
    assert out.filter("dti is null or num_bo is null").count() == 0
    assert {r[0] for r in out.select("num_bo").distinct().collect()} <= {"1", "2"}


def test_ties_keep_their_place_in_the_file(spark, tmp_path):
    """Rows of one loan and month, told apart only by their place in a text file of several splits."""
    from loanloom import schema
    from loanloom.sources import readers
    from pyspark.sql import functions as F

    width = len(schema.PERFORMANCE.fields)
    names = [f.name for f in schema.PERFORMANCE.fields]
    for quarter, many in (("2007Q3", 4000), ("2007Q4", 30)):
        with open(tmp_path / f"Performance_{quarter}.txt", "w") as out:
            for i in range(many):
                cells = [""] * width
                cells[names.index("loan_id")] = f"L{i % 3}"
                cells[names.index("monthly_rpt_prd")] = "01/01/2007"
                cells[names.index("servicer_name")] = f"{quarter}-{i}"
                out.write("|".join(cells) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df = readers.read_performance(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        rows = df.select("servicer_name", "row_seq").orderBy("row_seq").collect()
        assert [r[0] for r in rows] == [f"2007Q3-{i}" for i in range(4000)] + [f"2007Q4-{i}" for i in range(30)]
        last = df.repartition(7).groupBy("loan_id").agg(F.max_by("servicer_name", "row_seq").alias("s")).collect()
        assert {r.loan_id: r.s for r in last} == {"L0": "2007Q4-27", "L1": "2007Q4-28", "L2": "2007Q4-29"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
