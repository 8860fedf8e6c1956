"""Loan table: one row per loan with closing status, costs and net loss."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions import dates as D
from loanloom.functions import loan as L
from loanloom.functions.nulls import blank_to_null, null_to_blank, row_sum
from loanloom.operators import panel as P
from loanloom.operators.joins import outer_join_unique

LIQUIDATION_COSTS = ("fcc_cost", "pp_cost", "ar_cost", "ie_cost", "tax_cost")
PROCEEDS = ("ns_procs", "ce_procs", "rmw_procs", "o_procs")

_NOT_KEPT_FROM_ACQUISITIONS = ("seller_name", "product_type")
_NOT_KEPT_FROM_PANEL = (
    "servicer_name",
    "loan_age",
    "months_to_legal_mat",
    "adj_month_to_mat",
)
_WORKING_COLUMNS = (
    "period",
    "maturity_date",
    "delq",
    "zb_dte",
    "lpi_months",
    "total_expense",
    "total_proceeds",
    "ever_modified",
    "mod_upb_sum",
    "mod_rate_upb_sum",
    "modir_gap",
    "fce_delq",
    "fce_month",
    "f180_delq",
    "f180_month",
)


def prepare_acquisitions(acq: DataFrame, keys=P.KEYS) -> DataFrame:
    """Derived origination fields; seller and product are not carried on."""
    return acq.drop(*_NOT_KEPT_FROM_ACQUISITIONS).withColumns(
        {
            **{k: null_to_blank(F.col(k)) for k in keys},
            "cscore_mn": L.lowest_score(F.col("cscore_b"), F.col("cscore_c")),
            "orig_val": L.home_value(F.col("orig_amt"), F.col("oltv")),
            "ocltv": L.combined_ltv(F.col("ocltv"), F.col("oltv")),
        }
    )


def closing_measures(loans: DataFrame) -> DataFrame:
    """Status, interest, expenses, proceeds and loss of every closing row."""
    c = F.col
    loans = loans.withColumns(
        {
            "last_upb": c("upb"),
            "non_int_upb": -c("non_int"),
            "prin_forg_upb": -c("prin_forg_upb"),
            "fin_upb": L.final_upb(c("upb"), c("non_int"), c("prin_forg_upb")),
            "last_stat": L.last_status(c("zero_bal_code"), c("delq")),
            "lpi_months": L.months_lpi_to_disposition(
                D.parse_day(c("lpi_dte")), c("disp_dt")
            ),
            "zb2disp": L.months_zero_balance_to_disposition(
                D.parse_month(blank_to_null(c("zb_dte"))), c("disp_dt")
            ),
        }
    ).drop("upb", "non_int")
    event = L.credit_event(c("last_stat"))
    gone = L.disposed(c("last_stat"), c("disp_dt"))
    costs = [c(x) for x in LIQUIDATION_COSTS]
    procs = [c(x) for x in PROCEEDS]
    loans = loans.withColumns(
        {
            "int_cost": L.interest_cost(gone, c("fin_upb"), c("last_rt"), c("lpi_months")),
            "total_expense": L.gated_sum(gone, *costs),
            "total_proceeds": -L.gated_sum(gone, *procs),
        }
    )
    loss = (c("last_upb"), c("int_cost"), c("total_expense"), c("total_proceeds"))
    return loans.withColumns(
        {
            "net_loss": L.gated_sum(gone, *loss),
            "net_sev": F.when(gone, L.ratio(row_sum(*loss), c("last_upb"))).otherwise(0.0),
            "total_cost": L.gated_sum(event, c("last_upb"), c("int_cost"), *costs),
            "tot_procs": L.gated_sum(event, *procs),
            "tot_liq_ex": L.gated_sum(event, *costs),
            "last_dte": F.coalesce("disp_dt", "period"),
        }
    )


def finish_loans(combined: DataFrame) -> DataFrame:
    """Fields that need both origination and closing data."""
    c = F.col
    combined = combined.withColumns(
        {
            "vin_yr": D.year_text(D.parse_month(c("orig_dte"))),
            "act_yr": D.year_text(c("last_dte")),
            "disp_yr": F.coalesce(D.year_text(c("disp_dt")), F.lit(D.NO_DISPOSITION)),
            "f180_upb": L.event_upb(c("f180_delq"), c("f180_upb"), c("f180_month"), c("orig_amt")),
            "fce_upb": L.event_upb(c("fce_delq"), c("fce_upb"), c("fce_month"), c("orig_amt")),
            "c_modir_cost": P.total_rate_reduction_cost(c("orig_rt")),
        }
    )
    gone_modified = L.disposed(c("last_stat"), c("disp_dt")) & L.modified(c("mod_flag"))
    lost_rate = c("zb2disp") * ((c("orig_rt") - c("last_rt")) / 1200) * c("last_upb")
    lost_forbearance = c("zb2disp") * (c("last_rt") / 1200) * -c("non_int_upb")
    gone_forborne = gone_modified & c("non_int_upb").isNotNull()
    combined = combined.withColumns(
        {
            "modir_total": F.when(gone_modified, lost_rate).otherwise(0.0) + c("c_modir_cost"),
            "modfb_total": F.when(gone_forborne, lost_forbearance).otherwise(0.0)
            + c("c_modfb_cost"),
        }
    )
    return combined.withColumn(
        "modtot_cost", row_sum(c("modfg_cost"), c("modir_total"), c("modfb_total"))
    )


def build_loan_table(
    acq: DataFrame,
    perf: DataFrame,
    keys=P.KEYS,
    row_seq: str | None = None,
    big_loan_rows: int | None = P.BIG_LOAN_ROWS,
    keep_working: bool = False,
) -> DataFrame:
    """Acquisitions full outer collapsed panel, with every derived loan field.

    The panel is shuffled once (on the loan key) and reduced to one row per loan
    before it meets the acquisitions.  Use ``keys=("quarter", "loan_id")`` when
    the same loan id occurs in several quarterly files.
    """
    narrow = perf.drop(*_NOT_KEPT_FROM_PANEL)
    panel = P.prepare_panel(narrow, row_seq, keys)
    closed = closing_measures(P.collapse(panel, keys, big_loan_rows))
    out = finish_loans(outer_join_unique(prepare_acquisitions(acq, keys), closed, keys, big_loan_rows))
    return out if keep_working else out.drop(*_WORKING_COLUMNS)
