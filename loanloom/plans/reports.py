"""Vintage, disposition and count reports over the loan table.

Every report first reduces the loans to one row of sums per group; totals and
margins are then rolled up from those few rows, so the loan table is read once
per report.  Reports hold numbers; ``display_report`` turns them into text.
"""

from dataclasses import dataclass
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions import loan as L
from loanloom.functions.nulls import equals, is_in, ratio
from loanloom.operators.profile import summary

TOTAL, MARGIN = "Total", "Sum"


@dataclass(frozen=True)
class Measure:
    """``finish`` combines named sums over a group's loans into one number."""

    sums: dict[str, Column]
    finish: Column


def _total(name: str, x: Column) -> Measure:
    return Measure({name: x}, F.coalesce(F.col(name), F.lit(0.0)))


def _count(name: str, cond: Column | None = None) -> Measure:
    hit = F.lit(1) if cond is None else F.when(cond, 1).otherwise(0)
    return Measure({name: hit}, F.col(name))


def _total_where(name: str, cond: Column, x: Column) -> Measure:
    return _total(name, F.when(cond, x))


def _mean(name: str, x: Column) -> Measure:
    n = F.when(x.isNotNull(), 1).otherwise(0)
    return Measure({name + "_s": x, name + "_n": n}, ratio(F.col(name + "_s"), F.col(name + "_n")))


def _weighted_mean(name: str, x: Column, w: Column) -> Measure:
    """Mean of the present ``x`` weighted with ``w``."""
    sums = {name + "_s": x * w, name + "_w": F.when(x.isNotNull(), w)}
    return Measure(sums, ratio(F.col(name + "_s"), F.col(name + "_w")))


def _share(name: str, num: Column, den: Column, scale: int = 1) -> Measure:
    value = ratio(F.coalesce(F.col(name + "_a"), F.lit(0.0)), F.coalesce(F.col(name + "_b"), F.lit(0.0)))
    return Measure({name + "_a": num, name + "_b": den}, value * scale if scale != 1 else value)


def grouped_report(loans: DataFrame, key: str, measures: dict[str, Measure]) -> DataFrame:
    """One row per key value (a missing one included), then a ``Total`` row."""
    sums = {n: x for m in measures.values() for n, x in m.sums.items()}
    groups = loans.groupBy(key).agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    rolled = groups.rollup(key).agg(
        F.grouping(key).alias("is_total"), *[F.sum(n).alias(n) for n in sums]
    )
    label = F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col(key))
    return (
        rolled.select(
            "is_total", label.alias(key), *[m.finish.alias(n) for n, m in measures.items()]
        )
        .orderBy("is_total", F.asc_nulls_first(key))
        .drop("is_total")
    )




def acquisition_statistics(loans: DataFrame, key: str = "vin_yr") -> DataFrame:
    """Origination volume, balance-weighted scores, ratios and rate."""
    amt = F.col("orig_amt")

    def weighted(name: str, column: str, places: int | None = None) -> Measure:
        m = _weighted_mean(name, F.col(column), amt)
        return m if places is None else Measure(m.sums, L.round_half_even(m.finish, places))

    mean = _mean("avg_orig_upb", amt)
    return grouped_report(
        loans,
        key,
        {
            "loan_count": _count("loan_count"),
            "total_orig_upb": _total("total_orig_upb", amt),
            "avg_orig_upb": Measure(mean.sums, L.round_half_even(mean.finish)),
            "borrower_score": weighted("borrower_score", "cscore_b", 0),
            "co_borrower_score": weighted("co_borrower_score", "cscore_c", 0),
            "ltv": weighted("ltv", "oltv"),
            "cltv": weighted("cltv", "ocltv"),
            "dti": weighted("dti", "dti"),
            "note_rate": weighted("note_rate", "orig_rt"),
        },
    )


def _gone() -> Column:
    return L.disposed(F.col("last_stat"), F.col("disp_dt"))


def _status_tests() -> dict[str, Column]:
    stat = F.col("last_stat")
    return {
        "active": is_in(stat, L.ACTIVE_STATUS),
        "prepaid": equals(stat, "P"),
        "repurchased": equals(stat, "R"),
        "alternative": is_in(stat, L.ALTERNATIVE_STATUS),
        "reo": equals(stat, "F"),
        "modified": L.modified(F.col("mod_flag")),
    }


def _net_loss_rate() -> Measure:
    return _share("net_loss_rate", F.when(_gone(), F.col("net_loss")), F.col("orig_amt"))


def performance_counts(loans: DataFrame, key: str = "vin_yr") -> DataFrame:
    """Loans by closing status, default UPB and net loss rate."""
    t, upb = _status_tests(), F.col("last_upb")
    return grouped_report(
        loans,
        key,
        {
            "loan_count": _count("loan_count"),
            "total_orig_upb": _total("total_orig_upb", F.col("orig_amt")),
            "active_count": _count("active_count", t["active"]),
            "active_upb": _total_where("active_upb", t["active"], upb),
            "prepaid_count": _count("prepaid_count", t["prepaid"]),
            "repurchased_count": _count("repurchased_count", t["repurchased"]),
            "alternative_count": _count("alternative_count", t["alternative"]),
            "reo_count": _count("reo_count", t["reo"]),
            "modified_count": _count("modified_count", t["modified"]),
            "default_upb": _total_where("default_upb", _gone(), upb),
            "net_loss_rate": _net_loss_rate(),
        },
    )


def performance_balances(loans: DataFrame, key: str = "vin_yr") -> DataFrame:
    """Closing UPB by status, default UPB and net loss rate."""
    t, upb = _status_tests(), F.col("last_upb")
    order = ("active", "prepaid", "reo", "alternative", "repurchased", "modified")
    by_status = {f"{s}_upb": _total_where(f"{s}_upb", t[s], upb) for s in order}
    return grouped_report(
        loans,
        key,
        {
            "loan_count": _count("loan_count"),
            "total_orig_upb": _total("total_orig_upb", F.col("orig_amt")),
            **by_status,
            "default_upb": _total_where("default_upb", _gone(), upb),
            "net_loss_rate": _net_loss_rate(),
        },
    )


# Report column -> loan field, as a percentage of the disposed UPB.
LOSS_SHARES = {
    "interest_pct": "int_cost",
    "liquidation_expense_pct": "tot_liq_ex",
    "foreclosure_cost_pct": "fcc_cost",
    "preservation_cost_pct": "pp_cost",
    "recovery_cost_pct": "ar_cost",
    "misc_expense_pct": "ie_cost",
    "tax_pct": "tax_cost",
    "total_cost_pct": "total_cost",
    "sales_proceeds_pct": "ns_procs",
    "enhancement_proceeds_pct": "ce_procs",
    "repurchase_proceeds_pct": "rmw_procs",
    "other_proceeds_pct": "o_procs",
    "total_proceeds_pct": "tot_procs",
    "severity_pct": "net_loss",
}


def historical_net_loss(loans: DataFrame, key: str = "vin_yr") -> DataFrame:
    """Loss components of disposed credit events, by ``vin_yr`` or ``disp_yr``."""
    gone, upb = _gone(), F.col("last_upb")
    lost = F.when(gone, upb)
    shares = {
        name: _share(name, F.when(gone, F.col(field)), lost, 100)
        for name, field in LOSS_SHARES.items()
    }
    return grouped_report(
        loans,
        key,
        {
            "loan_count": _count("loan_count", gone),
            "liquidation_upb": _total("liquidation_upb", lost),
            "default_upb_pct": _share("default_upb_pct", lost, F.col("orig_amt"), 100),
            **shares,
            "total_net_loss": _total_where("total_net_loss", gone, F.col("net_loss")),
        },
    )


def headings(df: DataFrame, column: str) -> list:
    """Distinct present values in order, for the columns of a wide report."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    return [r[0] for r in rows.collect()]


def crosstab(
    loans: DataFrame, row: str, col: str, columns: Iterable | None = None, row_order: Column | None = None
) -> DataFrame:
    """Counts of row x column with ``Sum`` margins; missing values are left out.

    ``columns`` gives the headings when they are known already.
    """
    cells = loans.dropna(subset=[row, col]).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    names = list(columns) if columns is not None else headings(cells, col)
    rolled = cells.cube(row, col).agg(
        F.sum("n").alias("n"), F.grouping(row).alias("all_rows"), F.grouping(col).alias("all_cols")
    )
    label = F.when(F.col("all_rows") == 1, MARGIN).otherwise(F.col(row))
    order = ["all_rows", row] if row_order is None else ["all_rows", row_order, row]
    wide = rolled.groupBy(F.col("all_rows"), label.alias(row)).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("all_cols") == 0) & (F.col(col) == v), F.col("n"))), F.lit(0))
            .alias(str(v))
            for v in names
        ],
        F.sum(F.when(F.col("all_cols") == 1, F.col("n"))).alias(MARGIN),
    )
    return wide.orderBy(*order).drop("all_rows")


def purpose_by_vintage(loans: DataFrame, vintages=None) -> DataFrame:
    return crosstab(loans, "purpose", "vin_yr", vintages)


def occupancy_by_vintage(loans: DataFrame, vintages=None) -> DataFrame:
    return crosstab(loans, "occ_stat", "vin_yr", vintages)


def fico_by_vintage(loans: DataFrame, vintages=None) -> DataFrame:
    bucketed = loans.withColumn("fico_bkt", L.fico_bucket(F.col("cscore_mn")))
    return crosstab(bucketed, "fico_bkt", "vin_yr", vintages, L.fico_bucket_rank(F.col("fico_bkt")))


def status_counts(loans: DataFrame, column: str = "last_stat") -> DataFrame:
    """Counts per closing status and their sum."""
    counts = loans.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    rolled = counts.rollup(column).agg(F.sum("n").alias("n"), F.grouping(column).alias("is_total"))
    label = F.when(F.col("is_total") == 1, MARGIN).otherwise(F.col(column))
    shown = rolled.select("is_total", label.alias(column), "n")
    return shown.orderBy("is_total", column).drop("is_total")


def origination_summary(loans: DataFrame) -> DataFrame:
    """Statistics of score, LTV and amount: one row per statistic."""
    columns = ["cscore_mn", "oltv", "orig_amt"]
    return transpose(summary(loans, columns), "column", "stat", columns)


def transpose(report: DataFrame, key: str, measure: str = "measure", columns=None) -> DataFrame:
    """Measures as rows, key values as columns, in the report's order.

    A report has a handful of rows; its key values become the headings.
    """
    names = [c for c in report.columns if c != key]
    values = columns if columns is not None else [r[0] for r in report.select(key).collect()]
    long = report.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [key], names, measure, "value"
    )
    wide = long.groupBy(measure).agg(
        *[F.max(F.when(F.col(key).eqNullSafe(v), F.col("value"))).alias(str(v)) for v in values]
    )
    return wide.orderBy(F.array_position(F.lit(names), F.col(measure)))


def display_report(report: DataFrame, places: int = 3) -> DataFrame:
    """Fractional measures as fixed-point text, percentages with a sign."""
    shown = {}
    for f in report.schema.fields:
        if f.name.endswith("_pct"):
            shown[f.name] = L.fixed_text(F.col(f.name), places, "%")
        elif f.name in ("ltv", "cltv", "dti", "note_rate"):
            shown[f.name] = L.fixed_text(F.col(f.name), places)
    return report.withColumns(shown) if shown else report


def workbook(loans: DataFrame) -> dict[str, DataFrame]:
    """All ten reports.  Persist ``loans`` first: each report is one job."""
    vintages = headings(loans, "vin_yr")
    loss = historical_net_loss(loans, "vin_yr")
    disposition = historical_net_loss(loans, "disp_yr")
    return {
        "vint_refi_counts": purpose_by_vintage(loans, vintages),
        "vint_occ_counts": occupancy_by_vintage(loans, vintages),
        "vint_last_stat_counts": status_counts(loans),
        "summary_stats": origination_summary(loans),
        "vint_fico_counts": fico_by_vintage(loans, vintages),
        "aqsn_stat": acquisition_statistics(loans),
        "perf_stat_counts": performance_counts(loans),
        "perf_stat_sums": performance_balances(loans),
        "orig_loss_stat": transpose(loss, "vin_yr"),
        "disp_loss_stat": transpose(disposition, "disp_yr"),
    }
