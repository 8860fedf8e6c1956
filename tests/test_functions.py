"""Hand cases of the single-row measures and missing-value rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from loanloom.functions import dates as D
from loanloom.functions import loan as L
from loanloom.functions import nulls as N
from loanloom.plans import loan_table, reports


def value(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_if_else_keeps_unknown(spark):
    out = N.if_else(F.col("x") > 1, F.lit("a"), F.lit("b"))
    assert value(spark, out, "x int", (None,)) is None
    assert value(spark, out, "x int", (2,)) == "a"
    assert value(spark, out, "x int", (0,)) == "b"


def test_membership_is_never_unknown(spark):
    assert value(spark, N.is_in(F.col("x"), ["F"]), "x string", (None,)) is False


def test_row_sum_and_ratio(spark):
    schema, row = "a double, b double, c double", (100.0, 10.0, None)
    assert value(spark, L.final_upb(F.col("a"), F.col("b"), F.col("c")), schema, row) == 90
    assert value(spark, N.row_sum(F.col("c"), F.col("c")), schema, row) == 0
    assert value(spark, N.ratio(F.lit(0.0), F.lit(0.0))) is None
    assert value(spark, N.floor_at_zero(F.col("c")), schema, row) is None
    assert value(spark, L.fixed_text(F.col("c"), 3, "%"), schema, row) == "NaN%"
    assert value(spark, L.fixed_text(F.col("a"), 3, "%"), schema, row) == "100.000%"


def test_lowest_scores(spark):
    schema, b, c = "b double, c double", F.col("b"), F.col("c")
    assert value(spark, L.lowest_score(b, c), schema, (None, 700.0)) == 700
    assert value(spark, L.lowest_score_borrower_first(b, c), schema, (None, 700.0)) is None
    assert value(spark, L.lowest_score(b, c), schema, (700.0, None)) == 700
    assert value(spark, L.lowest_score_borrower_first(b, c), schema, (700.0, None)) == 700
    assert value(spark, L.lowest_score_borrower_first(b, c), schema, (700.0, 650.0)) == 650


@pytest.mark.parametrize(
    "score, bucket",
    [(619.0, "[0-620)"), (620.0, "[620-660)"), (780.0, "[780+)"), (None, "MissingFICO"), (-1.0, "NA")],
)
def test_fico_bucket(spark, score, bucket):
    assert value(spark, L.fico_bucket(F.col("x")), "x double", (score,)) == bucket


@pytest.mark.parametrize(
    "zb, delq, status",
    [("01", 0, "P"), ("02", None, "T"), ("03", 3, "S"), ("06", 0, "R"), ("09", None, "F"), ("15", 1, "N"),
     ("16", 1, "L"), (None, 999, "X"), (None, 12, "9"), (None, 0, "C"), (None, 4, "4"), (None, None, None),
     ("", None, None), ("77", 2, "2")],
)
def test_last_status(spark, zb, delq, status):
    expr = L.last_status(F.col("z"), F.col("d"))
    assert value(spark, expr, "z string, d int", (zb, delq)) == status


def test_delinquency_codes(spark):
    for text, months in (("X", 999), ("3", 3), ("", None), (None, None)):
        assert value(spark, L.delinquency_months(F.col("x")), "x string", (text,)) == months


@pytest.mark.parametrize(
    "delq, upb, month, want",
    [(None, None, None, None), (7, None, 3, 0.0), (6, None, 3, 100.0), (6, None, 8, 0.0), (6, 55.0, 3, 55.0),
     (None, None, 3, None), (None, 55.0, 3, 55.0), (None, None, 9, 0.0)],
)
def test_event_upb(spark, delq, upb, month, want):
    expr = L.event_upb(F.col("d"), F.col("u"), F.col("m"), F.lit(100.0))
    assert value(spark, expr, "d int, u double, m int", (delq, upb, month)) == want


def test_month_distances(spark):
    schema = "lpi string, zb string, disp date"
    lpi, zb, disp = D.parse_day(F.col("lpi")), D.parse_month(F.col("zb")), F.col("disp")
    day = datetime.date(2009, 3, 31)
    both = ("01/01/2008", "12/2008", day)
    assert value(spark, L.months_lpi_to_disposition(lpi, disp), schema, both) == 14
    assert value(spark, L.months_zero_balance_to_disposition(zb, disp), schema, both) == 3
    blank = ("", "", day)
    assert value(spark, L.months_lpi_to_disposition(lpi, disp), schema, blank) == 0
    assert value(spark, L.months_zero_balance_to_disposition(zb, disp), schema, blank) is None
    open_ = ("01/01/2008", "12/2008", None)
    assert value(spark, L.months_lpi_to_disposition(lpi, disp), schema, open_) == 0
    assert value(spark, L.months_zero_balance_to_disposition(zb, disp), schema, open_) == 0


def test_default_labels(spark):
    schema, zb, disp = "z string, d string", F.col("z"), F.col("d")
    assert value(spark, L.default_label(zb, disp), schema, ("09", None)) == 1
    assert value(spark, L.default_label(zb, disp, True), schema, ("09", None)) is None
    assert value(spark, L.default_label(zb, disp), schema, ("16", None)) == 0
    assert value(spark, L.default_label(zb, disp), schema, (None, None)) is None


def test_rounding_and_dates(spark):
    assert value(spark, L.round_half_even(F.col("x")), "x double", (2.5,)) == 2
    assert value(spark, L.round_half_even(F.col("x")), "x double", (3.5,)) == 4
    month, year = D.month_and_year(F.col("x"))
    assert value(spark, month, "x string", ("07/2003",)) == 7
    assert value(spark, year, "x string", ("07/2003",)) == 2003
    assert value(spark, D.parse_month(F.col("x")), "x string", ("",)) is None


def test_log_of_non_positive_is_missing(spark):
    assert value(spark, L.log_feature(F.col("x")), "x double", (0.0,)) is None
    assert value(spark, L.log_feature(F.col("x"), -1), "x double", (1.0,)) == 0


def test_weighted_mean_skips_missing_values(spark):
    loans = spark.createDataFrame(
        [("1999", 1.0, 1.0), ("1999", None, 5.0), ("1999", 3.0, 1.0)], "vin_yr string, oltv double, orig_amt double"
    )
    report = reports.grouped_report(
        loans, "vin_yr", {"m": reports._weighted_mean("m", F.col("oltv"), F.col("orig_amt"))}
    )
    assert [(r["vin_yr"], r["m"]) for r in report.collect()] == [("1999", 2.0), ("Total", 2.0)]


def test_crosstab_drops_missing_and_fills_empty_cells(spark):
    loans = spark.createDataFrame(
        [("P", "1999"), ("P", "1999"), ("R", "2000"), (None, "1999"), ("R", None)], "purpose string, vin_yr string"
    )
    rows = [tuple(r) for r in reports.purpose_by_vintage(loans).collect()]
    assert rows == [("P", 2, 0, 2), ("R", 0, 1, 1), ("Sum", 2, 1, 3)]


def test_missing_vintage_is_a_group_of_its_own(spark):
    loans = spark.createDataFrame([("1999", 5.0), (None, 7.0)], "vin_yr string, orig_amt double")
    m = {"loans": reports._count("loans"), "amt": reports._total("amt", F.col("orig_amt"))}
    rows = [tuple(r) for r in reports.grouped_report(loans, "vin_yr", m).collect()]
    assert rows == [(None, 1, 7.0), ("1999", 1, 5.0), ("Total", 2, 12.0)]


def test_summary_statistics(spark):
    from loanloom.operators.profile import summary

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    row = summary(df, ["x"]).first()
    assert tuple(row)[1:] == (1, 1.75, 2.5, 2.5, 3.25, 4, 1)


def test_working_columns_are_dropped(spark, data):
    from checks import views

    out = loan_table.build_loan_table(
        views.loan_acq(spark, data), views.loan_perf(spark, data), row_seq="row_seq"
    )
    assert not set(out.columns) & set(loan_table._WORKING_COLUMNS)
    assert len(set(c.lower() for c in out.columns)) == len(out.columns)
    assert {"modir_total", "net_loss", "fce_upb", "vin_yr"} <= set(out.columns)


def test_net_loss_identity_and_totals(spark, data):
    from checks import views

    loans = loan_table.build_loan_table(
        views.loan_acq(spark, data), views.loan_perf(spark, data), row_seq="row_seq", keep_working=True
    ).persist()
    off = loans.filter(
        F.abs(
            F.col("net_loss")
            - N.row_sum(*[F.col(c) for c in ("last_upb", "int_cost", "total_expense", "total_proceeds")])
        )
        > 1e-6
    ).filter(L.disposed(F.col("last_stat"), F.col("disp_dt")))
    assert off.count() == 0
    report = reports.historical_net_loss(loans).collect()
    total = [r for r in report if r["vin_yr"] == "Total"][0]
    groups = [r for r in report if r["vin_yr"] != "Total"]
    assert sum(r["loan_count"] for r in groups) == total["loan_count"]
    assert sum(r["total_net_loss"] for r in groups) == pytest.approx(total["total_net_loss"])
    book = reports.workbook(loans)
    assert len(book) == 10 and all(r.count() for r in book.values())
    loans.unpersist()


def test_sparse_indicators_of_very_many_levels(spark):
    from pyspark.ml.functions import vector_to_array

    from loanloom.operators.features import sparse_indicators

    df = spark.range(100_000).selectExpr("id", "concat('v', lpad(id, 6, '0')) AS wide", "CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END AS few", "'x' AS one")
    model = sparse_indicators(df, ["wide", "few", "one"])
    assert len(model.names) == 99_999 + 1 and model.columns == ("wide", "few")
    later = spark.createDataFrame(
        [(0, "v000000", "a", "x"), (1, "v000007", "b", "y"), (2, "unseen", None, None), (3, None, "c", "x")], "id long, wide string, few string, one string"
    )
    out = model.transform(later)
    assert out.columns == ["id", "wide", "few", "one", "indicators"]
    found = {r.id: r.indicators for r in out.collect()}
    assert found[0].size == 100_000 and found[0].indices.tolist() == []
    assert [model.names[k] for k in found[1].indices] == ["wide_v000007", "few_b"] and set(found[1].values) == {1.0}
    assert found[2].indices.tolist() == found[3].indices.tolist() == []
    assert out.select(vector_to_array("indicators").alias("a")).selectExpr("max(size(a))").first()[0] == 100_000


def test_density_is_one(spark):
    """Every curve's points times their spacing add up to 1, whatever the range of the values."""
    import random

    from loanloom.operators.profile import density

    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.uniform(0, 400_000), rng.gauss(6, 0.3), rng.choice([180.0, 360.0]), None) for _ in range(500)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0)], "label int, wide double, narrow double, two double, none double")
    out = density(df, ["wide", "narrow", "two", "none"], {0: 0.2, 1: 2.0})
    areas = {(r["label"], r["column"]): (r["area"], r["n"]) for r in out.groupBy("label", "column").agg(
        F.sum(F.col("density") * F.when(F.col("label") == 0, 0.1).otherwise(1.0)).alias("area"), F.count("*").alias("n")
    ).collect()}
    assert set(areas) == {(y, c) for y in (0, 1) for c in ("wide", "narrow", "two")}
    assert all(abs(a - 1) < 1e-6 for a, _ in areas.values())
    # two values far apart: no points in between
    assert areas[(0, "two")][1] < 60
