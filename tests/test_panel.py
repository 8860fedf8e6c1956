"""Panel operators: hand cases, and big loans against the ordinary way."""

import random

import pytest
from pyspark.sql import functions as F

from checks import views
from loanloom.operators import panel as P
from loanloom.plans.loan_table import build_loan_table

COLUMNS = (
    "loan_id string, period date, row_seq bigint, last_upb double, non_int_upb double, mod_flag string, "
    "last_rt double, delq int, zero_bal_code string, maturity_date string, prin_forg_upb double"
)


def rows(spark, *upbs, loan="a", **more):
    base = {"non_int_upb": None, "mod_flag": "N", "last_rt": 5.0, "delq": 0, "zero_bal_code": None,
            "maturity_date": "01/2030", "prin_forg_upb": None}
    import datetime

    data = []
    for i, u in enumerate(upbs):
        row = {"loan_id": loan, "period": datetime.date(2001 + i // 12, 1 + i % 12, 1), "row_seq": i, "last_upb": u}
        row |= {k: (more[k][i] if k in more else v) for k, v in base.items()}
        data.append(tuple(row[c.split()[0]] for c in COLUMNS.split(", ")))
    return spark.createDataFrame(data, COLUMNS)


@pytest.mark.parametrize(
    "raw, filled",
    [
        ((0.0, None, 5.0, None, 0.0, 4.0), [0.0, 0.0, 5.0, 5.0, 5.0, 4.0]),
        ((None, 0.0, 5.0), [None, None, 5.0]),
        ((None, None), [None, None]),
    ],
)
@pytest.mark.parametrize("limit", [None, 1])
def test_carry_forward(spark, raw, filled, limit):
    out = P.carry_forward(rows(spark, *raw), big_loan_rows=limit).orderBy("period").collect()
    assert [r["upb"] for r in out] == filled
    assert [r["prev_upb"] for r in out] == [None, *filled[:-1]]
    assert [r["month_no"] for r in out] == list(range(1, len(raw) + 1))


def test_carry_forward_is_idempotent(spark):
    once = P.carry_forward(rows(spark, 0.0, None, 5.0, None, 0.0, 4.0))
    again = P.carry_forward(once.withColumn("last_upb", F.col("upb")).drop("upb", "non_int", "prev_upb", "month_no"))
    assert sorted(r["upb"] for r in again.collect()) == sorted(r["upb"] for r in once.collect())


@pytest.mark.parametrize("limit", [None, 1])
def test_running_cost_stays_missing_after_a_gap(spark, limit):
    panel = rows(spark, 1200.0, 1200.0, 1200.0, mod_flag=["Y"] * 3, last_rt=[4.0, None, 4.0])
    acq = spark.createDataFrame([("a", 5.0)], "loan_id string, orig_rt double")
    out = P.modification_costs(panel, acq, big_loan_rows=limit).orderBy("period").collect()
    assert [r["c_modir_cost"] for r in out] == [1.0, None, None]


@pytest.mark.parametrize("limit", [None, 1])
def test_last_row_fill(spark, limit):
    panel = rows(spark, 3.0, 0.0, 7.0, 0.0).unionByName(rows(spark, 0.0, loan="b"))
    out = P.fill_last_row(panel, "last_upb", big_loan_rows=limit).orderBy("loan_id", "period").collect()
    assert [r["last_upb_filled"] for r in out] == [3.0, 0.0, 7.0, 7.0, 0.0]


def test_first_event_keeps_a_missing_balance(spark):
    panel = rows(spark, None, None, 9.0, delq=[2, 7, 8])
    event = P.first_events(panel).first()
    assert (event["f180_upb"], event["f180_delq"], event["f180_month"]) == (None, 7, 2)


def test_unknown_delinquency_is_no_event(spark):
    assert P.first_events(rows(spark, 1.0, delq=[999])).first()["f180_dte"] is None


def skewed_panel(spark):
    """One loan with most rows, ties, copies and gaps; some ordinary loans."""
    import datetime

    rnd = random.Random(7)
    data = []
    for loan, n in (("hot", 400), ("a", 5), ("b", 1), ("", 30)):
        for i in range(n):
            row = (
                loan,
                rnd.choice([None, *[datetime.date(2001, m, 1) for m in range(1, 13)]]),
                rnd.choice([None, 0.0, 100.0, 250.0]),
                rnd.choice([None, 0.0, 40.0]),
                rnd.choice(["Y", "N", None]),
                rnd.choice([4.0, 5.0]),
                rnd.choice([0, 3, 6, 7, 999, None]),
                rnd.choice([None, "03", "01"]),
                rnd.choice(["01/2030", None]),
                rnd.choice([None, 5.0]),
            )
            data += [row] * rnd.choice([1, 1, 3])
    names = [c for c in COLUMNS.split(", ") if not c.startswith("row_seq")]
    df = spark.createDataFrame(data, ", ".join(names))
    return df.withColumn("row_seq", F.xxhash64(*df.columns))


def collected(df):
    cols = sorted(df.columns)
    shown = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()]
    return sorted(shown, key=repr)


def test_big_loans_match_the_ordinary_way(spark):
    panel = skewed_panel(spark).persist()
    acq = spark.createDataFrame([("hot", 6.0), ("a", 5.5), ("", 7.0)], "loan_id string, orig_rt double")
    assert P.split_by_size(panel, big_loan_rows=100)[1].block
    for run in (
        lambda n: P.carry_forward(panel, big_loan_rows=n),
        lambda n: P.modification_costs(panel, acq, big_loan_rows=n),
        lambda n: P.fill_last_row(panel, "last_upb", big_loan_rows=n),
        lambda n: P.loan_flags(panel, big_loan_rows=n),
        lambda n: P.first_events(panel, big_loan_rows=n),
        lambda n: P.collapse(panel, big_loan_rows=n),
    ):
        assert collected(run(None)) == collected(run(20))


def test_panel_is_shuffled_once(spark, data):
    """Panel and acquisitions need one exchange each; windows add none.  No job runs while the plan is built."""
    acq = spark.read.parquet(f"{data}/orders.parquet").selectExpr(*_acq_like())
    perf = views.loan_perf(spark, data)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    build_loan_table(acq, perf, row_seq="row_seq")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(jobs)
    loans = build_loan_table(acq, perf, row_seq="row_seq", big_loan_rows=None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = loans._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert "BatchEvalPython" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _acq_like():
    from loanloom import schema

    typed = {f.name: f.dataType.simpleString() for f in schema.ACQUISITION.fields}
    return [
        "lpad(cast(o_orderkey as string), 12, '0') AS loan_id"
        if n == "loan_id"
        else f"cast(NULL as {t}) AS {n}"
        for n, t in typed.items()
    ]


def test_missing_and_outlying_positions_of_a_hot_loan(spark):
    """Blocks follow the rows: a hot loan whose positions are missing, equal or far out."""
    names = [c for c in COLUMNS.split(", ")]
    base = skewed_panel(spark)
    seqs = [None, 0, 1, 2, 3, 10**15, -(10**15), *range(10, 60)]
    picked = F.get(F.array(*[F.lit(x).cast("bigint") for x in seqs]), F.pmod(F.xxhash64(*base.columns), F.lit(len(seqs))).cast("int"))
    panel = base.withColumn("row_seq", picked).withColumn("row_seq", F.when(F.col("loan_id") == "hot", F.col("row_seq")).otherwise(F.xxhash64(*base.columns)))
    # ties in (period, row_seq) are given one order, so that both ways can be compared
    panel = panel.dropDuplicates(["loan_id", "period", "row_seq"]).persist()
    assert names and panel.filter("row_seq IS NULL").count() > 0
    for run in (P.carry_forward, P.loan_flags, P.first_events, P.collapse):
        assert collected(run(panel, big_loan_rows=None)) == collected(run(panel, big_loan_rows=10))
    hot = P.split_by_size(panel, big_loan_rows=10)[1].rows
    sizes = [r["count"] for r in hot.filter("loan_id = 'hot'").groupBy("block").count().collect()]
    assert len(sizes) > 3 and max(sizes) <= 0.7 * sum(sizes)


def test_very_many_equal_rows(spark):
    """Copies of a row are written out run by run and numbered as long."""
    rows = spark.createDataFrame([("hot", 3 * P.RUN + 5)], "loan_id string, copies bigint").withColumn("block", F.lit(0))
    out = P.PanelPart(rows, ("loan_id",), P.BLOCK).expand()
    assert out.schema["copy"].dataType.simpleString() == "bigint"
    assert out.agg(F.count("*"), F.min("copy"), F.max("copy"), F.count_distinct("copy")).first() == (3 * P.RUN + 5, 1, 3 * P.RUN + 5, 3 * P.RUN + 5)


def test_outer_joins_with_hot_keys(spark):
    from loanloom.operators import joins as J

    left = spark.createDataFrame([("h", i) for i in range(30)] + [("a", 1), ("b", 2), (None, 3)], "loan_id string, x int")
    right = spark.createDataFrame([("h", 1.0), ("a", 2.0), ("c", 3.0), (None, 4.0)], "loan_id string, y double")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for join, other in ((J.outer_join_unique, right), (J.outer_join, right.unionByName(right))):
        assert collected(join(left, other, hot_key_rows=10)) == collected(left.join(other, ["loan_id"], "full"))
        assert collected(join(left, other)) == collected(join(left, other, hot_key_rows=None))
    J.outer_join(left, right)
    assert jobs >= 0


def test_reports_read_the_closing_fields_they_need(spark, data):
    """Counting statuses carries two closing fields, not the whole row."""
    from checks.registry import loans
    from loanloom.plans.reports import status_counts

    plan = status_counts(loans(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    collapsed = [line for line in plan.splitlines() if "Aggregate [loan_id" in line and "is_last" in line]
    assert collapsed and all(line.count("is_last") <= 2 * 2 for line in collapsed)
    assert "fcc_cost" not in plan.split("Relation")[0]
