"""Column expressions for single-row loan measures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom.functions.dates import whole_months
from loanloom.functions.nulls import (
    equals,
    floor_at_zero,
    if_else,
    is_in,
    null_to_blank,
    ratio,
    row_sum,
)

# Status codes and buckets.
UNKNOWN_DELINQUENCY = 999
STATUS_BY_ZERO_BALANCE = {
    "01": "P",
    "02": "T",
    "03": "S",
    "06": "R",
    "09": "F",
    "15": "N",
    "16": "L",
}
CREDIT_EVENT_STATUS = ("F", "S", "T", "N")
ACTIVE_STATUS = ("C", "1", "2", "3", "4", "5", "6", "7", "8", "9")
ALTERNATIVE_STATUS = ("S", "T")
DEFAULT_ZERO_BALANCE = ("02", "03", "09", "15")
HEALTHY_ZERO_BALANCE = ("01", "06", "16")
FIRST_EVENT_ZERO_BALANCE = ("03", "09")
SEVERE_DELINQUENCY_MONTHS = 6
EARLY_MONTHS = 6
SERVICING_FEE = 0.0035
FICO_BREAKS = (620, 660, 700, 740, 780)
FICO_LABELS = ("[0-620)", "[620-660)", "[660-700)", "[700-740)", "[740-780)", "[780+)")
BAD_FICO, MISSING_FICO = "NA", "MissingFICO"
BAD_ZIP_PREFIX = "000"


# --- origination -----------------------------------------------------------


def lowest_score(borrower: Column, co_borrower: Column) -> Column:
    """Lower of the two credit scores, or the one that is present."""
    return F.least(borrower, co_borrower)


def lowest_score_borrower_first(borrower: Column, co_borrower: Column) -> Column:
    """As :func:`lowest_score`, but missing whenever the borrower's is missing."""
    return F.when(borrower.isNotNull(), F.least(borrower, co_borrower))


def home_value(orig_amt: Column, oltv: Column) -> Column:
    return ratio(orig_amt, oltv / 100)


def combined_ltv(ocltv: Column, oltv: Column) -> Column:
    return F.coalesce(ocltv, oltv)


def fico_bucket(score: Column) -> Column:
    out = F.when(score.isNull(), MISSING_FICO).when(score < 0, BAD_FICO)
    for upper, label in zip(FICO_BREAKS, FICO_LABELS):
        out = out.when(score < upper, label)
    return out.otherwise(FICO_LABELS[-1])


def fico_bucket_rank(bucket: Column) -> Column:
    """Sort key of :func:`fico_bucket`; missing scores come last."""
    labels = (BAD_FICO, *FICO_LABELS, MISSING_FICO)
    return F.array_position(F.lit(list(labels)), bucket)


def zip_prefix(zipcode: Column) -> Column:
    return F.substring(zipcode, 1, 3)


def valid_zip_prefix(zip_3: Column) -> Column:
    return F.nullif(zip_3, F.lit(BAD_ZIP_PREFIX))


def log_feature(x: Column, sign: int = 1) -> Column:
    return sign * F.ln(x)


# --- one panel row ---------------------------------------------------------


def delinquency_months(status: Column) -> Column:
    return F.when(status == "X", UNKNOWN_DELINQUENCY).otherwise(status.try_cast("int"))


def forgiven_principal(fhfa: Column, other: Column) -> Column:
    return fhfa + other


def final_upb(upb: Column, non_int: Column, forgiven: Column) -> Column:
    return row_sum(upb, -non_int, -forgiven)


def modified(mod_flag: Column) -> Column:
    return equals(mod_flag, "Y")


def rate_reduction_cost(mod_flag: Column, orig_rt: Column, last_rt: Column, upb: Column) -> Column:
    cost = ((orig_rt - last_rt) / 1200) * upb
    return F.when(modified(mod_flag), cost).otherwise(F.lit(0.0))


def forbearance_cost(mod_flag: Column, last_rt: Column, non_int: Column) -> Column:
    hit = modified(mod_flag) & non_int.isNotNull()
    return F.when(hit, (last_rt / 1200) * non_int).otherwise(F.lit(0.0))


def severely_delinquent(delq: Column) -> Column:
    return (delq >= SEVERE_DELINQUENCY_MONTHS) & (delq < UNKNOWN_DELINQUENCY)


def first_event_row(zero_bal_code: Column, delq: Column) -> Column:
    return zero_bal_code.isin(list(FIRST_EVENT_ZERO_BALANCE)) | severely_delinquent(delq)


# --- last panel row --------------------------------------------------------


def last_status(zero_bal_code: Column, delq: Column) -> Column:
    """Closing status from the zero-balance code, else from the delinquency."""
    out = None
    for code, status in STATUS_BY_ZERO_BALANCE.items():
        out = (F if out is None else out).when(zero_bal_code == code, status)
    return (
        out.when(delq == UNKNOWN_DELINQUENCY, "X")
        .when(delq > 9, "9")
        .when(delq == 0, "C")
        .otherwise(delq.cast("string"))
    )


def credit_event(last_stat: Column) -> Column:
    return is_in(last_stat, CREDIT_EVENT_STATUS)


def disposed(last_stat: Column, disp_dt: Column) -> Column:
    return credit_event(last_stat) & disp_dt.isNotNull()


def months_lpi_to_disposition(lpi: Column, disp: Column) -> Column:
    both = lpi.isNotNull() & disp.isNotNull()
    return F.when(both, whole_months(lpi, disp)).otherwise(F.lit(0))


def months_zero_balance_to_disposition(zb: Column, disp: Column) -> Column:
    """0 without a disposition; missing when only the zero-balance date is."""
    return F.when(disp.isNotNull(), whole_months(zb, disp)).otherwise(F.lit(0))


def interest_cost(hit: Column, fin_upb: Column, last_rt: Column, lpi_months: Column) -> Column:
    cost = fin_upb * (((last_rt / 100) - SERVICING_FEE) / 12) * lpi_months
    return F.when(hit, floor_at_zero(cost)).otherwise(F.lit(0.0))


def gated_sum(hit: Column, *parts: Column) -> Column:
    """Null-skipping sum where ``hit``, else 0."""
    return F.when(hit, row_sum(*parts)).otherwise(F.lit(0.0))


def event_upb(delq: Column, upb: Column, month_no: Column, orig_amt: Column) -> Column:
    """UPB at a first event; the original amount if it is missing early on.

    Unknown stays unknown, so a loan without the event has NULL and not 0.
    """
    early = (delq == SEVERE_DELINQUENCY_MONTHS) & upb.isNull() & (month_no <= EARLY_MONTHS)
    return if_else(early, orig_amt, F.coalesce(upb, F.lit(0.0)))


def default_label(zero_bal_code: Column, disp_dt: Column, require_disposition: bool = False) -> Column:
    """1 default, 0 healthy, NULL for a loan whose outcome is not known yet."""
    bad = is_in(zero_bal_code, DEFAULT_ZERO_BALANCE)
    if require_disposition:
        bad = bad & disp_dt.isNotNull()
    return F.when(bad, 1).when(is_in(zero_bal_code, HEALTHY_ZERO_BALANCE), 0)


def foreclosure_label(fcc_dte: Column) -> Column:
    """1 if the last row has a foreclosure date, else 0 (fill, then recode)."""
    return F.when(null_to_blank(fcc_dte.cast("string")) != "", 1).otherwise(0)


# --- display ---------------------------------------------------------------


def round_half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def fixed_text(x: Column, places: int = 3, suffix: str = "") -> Column:
    """Fixed-point text, exact ties to the even digit; a missing or undefined number prints as ``NaN``."""
    scaled = x.cast("double") * float(2 ** (places + 1))  # whole if x may lie half-way; exact
    rounded = F.when(scaled == F.floor(scaled), F.bround(x.cast("double"), places)).otherwise(x.cast("double"))
    shown = F.format_string(f"%.{places}f{suffix.replace('%', '%%')}", rounded)
    return F.when(x.isNull() | F.isnan(x), "NaN" + suffix).otherwise(shown)
