"""Cleaning, panel and event operators."""

from pyspark.sql import functions as F

from checks.registry import acq, closing_codes, combined, loans, oracle, panel, perf, r, register, sql_day, sql_month, text, tidy
from loanloom import schema
from loanloom.functions import dates as D
from loanloom.functions import loan as L
from loanloom.functions.nulls import is_in
from loanloom.operators import panel as P
from loanloom.operators import profile as R
from loanloom.operators.joins import cohort_overlap
from loanloom.plans.loan_table import prepare_acquisitions


@register(
    "renamed_columns",
    oracle("SELECT loan_id AS id, orig_chn AS channel, orig_rt AS rate, state AS property_state FROM acq", "acq"),
)
def renamed_columns(spark, d):
    names = {"loan_id": "id", "orig_chn": "channel", "orig_rt": "rate", "state": "property_state"}
    return acq(spark, d).select(*names).withColumnsRenamed(names)


@register(
    "parsed_dates",
    oracle(
        f"""SELECT loan_id, row_seq, CAST({sql_day('monthly_rpt_prd')} AS VARCHAR) AS period, CAST({sql_day('disp_dt')} AS VARCHAR) AS disp_dt,
        CAST({sql_day('fcc_dte')} AS VARCHAR) AS fcc_dte, CAST({sql_month('zb_dte')} AS VARCHAR) AS zb_month,
        CAST({sql_day('lpi_dte')} AS VARCHAR) AS lpi_day FROM perf""",
        "perf",
    ),
)
def parsed_dates(spark, d):
    return tidy(
        panel(spark, d).select(
            "loan_id",
            "row_seq",
            "period",
            "disp_dt",
            "fcc_dte",
            D.parse_month(F.col("zb_dte")).alias("zb_month"),
            D.parse_day(F.col("lpi_dte")).alias("lpi_day"),
        )
    )


@register(
    "delinquency_months",
    oracle("SELECT loan_id, row_seq, CAST(delq AS DOUBLE) AS delq FROM panel", "panel"),
)
def delinquency_months(spark, d):
    return panel(spark, d).select("loan_id", "row_seq", F.col("delq").cast("double").alias("delq"))


@register(
    "acquisition_fields",
    oracle(
        f"""SELECT loan_id, {r('orig_amt', 'oltv', 'ocltv', 'cscore_b', 'cscore_c', 'cscore_mn', 'orig_val')},
        CASE WHEN cscore_mn IS NULL THEN 'MissingFICO' WHEN cscore_mn < 0 THEN 'NA' WHEN cscore_mn < 620 THEN '[0-620)'
          WHEN cscore_mn < 660 THEN '[620-660)' WHEN cscore_mn < 700 THEN '[660-700)' WHEN cscore_mn < 740 THEN '[700-740)'
          WHEN cscore_mn < 780 THEN '[740-780)' ELSE '[780+)' END AS fico_bkt,
        round(CASE WHEN cscore_b IS NOT NULL THEN least(cscore_b, cscore_c) END, 6) AS cscore_mn_b FROM acq_derived""",
        "acq_derived",
    ),
)
def acquisition_fields(spark, d):
    df = prepare_acquisitions(acq(spark, d))
    return tidy(
        df.withColumns(
            {
                "fico_bkt": L.fico_bucket(F.col("cscore_mn")),
                "cscore_mn_b": L.lowest_score_borrower_first(F.col("cscore_b"), F.col("cscore_c")),
            }
        ),
        "loan_id", "orig_amt", "oltv", "ocltv", "cscore_b", "cscore_c", "cscore_mn", "orig_val", "fico_bkt", "cscore_mn_b",
    )


@register(
    "dropped_columns",
    oracle("SELECT * EXCLUDE (seller_name, product_type, ocltv) FROM acq", "acq"),
)
def dropped_columns(spark, d):
    return acq(spark, d).drop("seller_name", "product_type", "ocltv")


_TIE_OUT_LOAN = "000000000010"


@register(
    "tie_out_loan",
    oracle(
        f"SELECT loan_id, {text('period')}, {r('last_upb', 'last_rt')}, mod_flag FROM panel WHERE loan_id = '{_TIE_OUT_LOAN}'",
        "panel",
    ),
)
def tie_out_loan(spark, d):
    return tidy(R.lookup(panel(spark, d), _TIE_OUT_LOAN), "loan_id", "period", "last_upb", "last_rt", "mod_flag")


@register(
    "delinquent_loans",
    oracle(
        "SELECT count(*) AS rows, CAST(55 AS BIGINT) AS columns FROM combined WHERE delq_status <> 'X' AND delq_status IS NOT NULL",
        "combined",
    ),
)
def delinquent_loans(spark, d):
    return R.shape(R.delinquent(combined(spark, d)))


@register("valid_zip_prefix", oracle("SELECT loan_id, nullif(zip_3, '000') AS zip_3 FROM acq", "acq"))
def valid_zip_prefix(spark, d):
    return acq(spark, d).select("loan_id", L.valid_zip_prefix(F.col("zip_3")).alias("zip_3"))


@register(
    "foreclosure_labels",
    oracle("SELECT loan_id, CASE WHEN coalesce(fcc_dte, '') <> '' THEN 1 ELSE 0 END AS label FROM combined", "combined"),
)
def foreclosure_labels(spark, d):
    return closing_codes(spark, d).select("loan_id", L.foreclosure_label(F.col("fcc_dte")).alias("label"))


@register(
    "panel_carry_forward",
    oracle(
        f"SELECT loan_id, row_seq, {text('period')}, CAST(month_no AS BIGINT) AS month_no, {r('upb', 'non_int', 'prev_upb')} FROM scan",
        "scan",
    ),
)
def panel_carry_forward(spark, d):
    df = P.carry_forward(panel(spark, d))
    return tidy(df, "loan_id", "row_seq", "period", "month_no", "upb", "non_int", "prev_upb")


@register(
    "panel_final_upb",
    oracle(
        f"""SELECT loan_id, row_seq, {r('prin_forg')}, round(coalesce(upb, 0) - coalesce(non_int, 0) - coalesce(prin_forg, 0), 6) + 0.0e0 AS fin_upb FROM scan""",
        "scan",
    ),
)
def panel_final_upb(spark, d):
    df = P.carry_forward(panel(spark, d))
    fin = L.final_upb(F.col("upb"), F.col("non_int"), F.col("prin_forg_upb"))
    return tidy(df.select("loan_id", "row_seq", F.col("prin_forg_upb").alias("prin_forg"), fin.alias("fin_upb")))


@register(
    "panel_original_rate",
    oracle(f"SELECT loan_id, row_seq, {r('orig_rt', 'last_rt')} FROM costs", "costs"),
)
def panel_original_rate(spark, d):
    return tidy(P.add_original_rate(panel(spark, d), acq(spark, d)), "loan_id", "row_seq", "orig_rt", "last_rt")


_RUNNING = "(PARTITION BY loan_id ORDER BY period, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _poisoned(c: str) -> str:
    gaps = f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) OVER {_RUNNING}"
    return f"round(CASE WHEN {gaps} = 0 THEN sum({c}) OVER {_RUNNING} END, 7) + 0.0e0 AS c_{c}"


@register(
    "panel_modification_costs",
    oracle(
        f"SELECT loan_id, row_seq, {r('modir_cost', 'modfb_cost', places=7)}, {_poisoned('modir_cost')}, {_poisoned('modfb_cost')} FROM costs",
        "costs",
    ),
)
def panel_modification_costs(spark, d):
    df = P.modification_costs(panel(spark, d), acq(spark, d))
    return tidy(df, "loan_id", "row_seq", "modir_cost", "modfb_cost", "c_modir_cost", "c_modfb_cost", places=7)


@register(
    "panel_last_row_fill",
    oracle(
        """SELECT loan_id, row_seq, round(CASE WHEN lead(loan_id) OVER w IS NULL AND (last_upb IS NULL OR last_upb = 0)
             AND lag(loan_id) OVER w IS NOT NULL THEN lag(last_upb) OVER w ELSE last_upb END, 6) + 0.0e0 AS last_upb_filled
           FROM panel WINDOW w AS (PARTITION BY loan_id ORDER BY period, row_seq)""",
        "panel",
    ),
)
def panel_last_row_fill(spark, d):
    return tidy(P.fill_last_row(panel(spark, d), "last_upb"), "loan_id", "row_seq", "last_upb_filled")


@register(
    "modification_flags",
    oracle(f"SELECT loan_id, modtrm_chng, modupb_chng, {r('modfg_cost')} FROM flags", "flags"),
)
def modification_flags(spark, d):
    return tidy(P.loan_flags(panel(spark, d)))


@register(
    "first_modification",
    oracle(f"SELECT loan_id, {text('fmod_dte')}, {r('fmod_upb')} FROM fmod", "fmod"),
)
def first_modification(spark, d):
    events = P.first_events(panel(spark, d)).filter(F.col("fmod_dte").isNotNull())
    return tidy(events, "loan_id", "fmod_dte", "fmod_upb")


def _event(name: str):
    sql = f"""SELECT loan_id, {text(f'{name}_dte')}, {r(f'{name}_upb')}, CAST({name}_delq AS DOUBLE) AS {name}_delq,
              CAST({name}_month AS BIGINT) AS {name}_month FROM {name}"""

    def run(spark, d):
        events = P.first_events(panel(spark, d)).filter(F.col(f"{name}_dte").isNotNull())
        return tidy(
            events.withColumn(f"{name}_delq", F.col(f"{name}_delq").cast("double")),
            "loan_id", f"{name}_dte", f"{name}_upb", f"{name}_delq", f"{name}_month",
        )

    return run, oracle(sql, name)


for _name, _query in (("fce", "first_credit_event"), ("f180", "first_180_day_delinquency")):
    _run, _sql = _event(_name)
    register(_query, _sql)(_run)


@register(
    "last_panel_row",
    oracle(
        f"SELECT loan_id, row_seq, {text('period')}, {r('last_upb', 'last_rt')}, delq_status, zero_bal_code FROM panel "
        "QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY period DESC, row_seq DESC) = 1",
        "panel",
    ),
)
def last_panel_row(spark, d):
    df = perf(spark, d).withColumn("period", D.parse_day(F.col("monthly_rpt_prd")))
    return tidy(P.last_rows(df), "loan_id", "row_seq", "period", "last_upb", "last_rt", "delq_status", "zero_bal_code")


@register("combined_table", oracle("SELECT * FROM combined", "combined"))
def combined_table_query(spark, d):
    return combined(spark, d)


_OVERLAP = """SELECT loan_id, * EXCLUDE (loan_id), CASE WHEN in_y IS NULL THEN 'left_only' WHEN in_x IS NULL THEN 'right_only' ELSE 'both' END AS side
  FROM x FULL JOIN y USING (loan_id)"""
_COHORT = [f.name for f in schema.ACQUISITION.fields if f.name != "loan_id"]


def _side(s: str, years: str) -> str:
    return f"SELECT loan_id, {', '.join(f'{c} AS {c}_{s}' for c in _COHORT)}, true AS in_{s} FROM acq WHERE substr(orig_dte, 4, 4) {years}"


@register(
    "cohort_overlap",
    oracle(
        f"SELECT * EXCLUDE (in_x, in_y) FROM ({_OVERLAP})",
        "acq",
        extra={"x": _side("x", "<= '1998'"), "y": _side("y", ">= '1998'")},
    ),
)
def cohort_overlap_query(spark, d):
    year = F.substring("orig_dte", 4, 4)
    loans_ = acq(spark, d).select("loan_id", *_COHORT)
    return cohort_overlap(loans_.filter(year <= "1998"), loans_.filter(year >= "1998"))


# --- loan table ---------------------------------------------------------------


def _loan_fields(name: str, select: str, columns: list[str], places: int = 6, doubles=()):
    @register(name, oracle(f"SELECT loan_id, {select} FROM loans", "loans"))
    def run(spark, d):
        df = loans(spark, d)
        df = df.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else df
        return tidy(df, "loan_id", *columns, places=places)


def _dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) + 0.0e0 AS {n}" for n in names)


_loan_fields(
    "closing_status",
    f"last_stat, {_dbl('lpi_months', 'zb2disp')}, {text('last_dte', 'disp_dt')}, {r('fin_upb', 'last_upb')}",
    ["last_stat", "lpi_months", "zb2disp", "last_dte", "disp_dt", "fin_upb", "last_upb"],
    doubles=("lpi_months", "zb2disp"),
)
_loan_fields(
    "interest_and_expenses",
    r("int_cost", "total_expense", "total_proceeds", places=7),
    ["int_cost", "total_expense", "total_proceeds"],
    places=7,
)
_loan_fields("net_loss", r("net_loss", "net_sev", places=7), ["net_loss", "net_sev"], places=7)
_loan_fields(
    "liquidation_totals",
    r("total_cost", "tot_procs", "tot_liq_ex", places=7),
    ["total_cost", "tot_procs", "tot_liq_ex"],
    places=7,
)
_loan_fields("loan_years", "vin_yr, act_yr, disp_yr", ["vin_yr", "act_yr", "disp_yr"])
_loan_fields(
    "event_balances",
    f"{text('fmod_dte', 'fce_dte', 'f180_dte')}, {r('fmod_upb', 'fce_upb', 'f180_upb')}",
    ["fmod_dte", "fce_dte", "f180_dte", "fmod_upb", "fce_upb", "f180_upb"],
)
_MODTOT = "round(coalesce(modfg_cost, 0) + coalesce(modir_total, 0) + coalesce(modfb_total, 0), 7) + 0.0e0 AS modtot_cost"
_loan_fields(
    "modification_totals",
    f"{r('c_modir_cost', 'c_modfb_cost', 'modir_total', 'modfb_total', 'modfg_cost', places=7)}, {_MODTOT}",
    ["c_modir_cost", "c_modfb_cost", "modir_total", "modfb_total", "modfg_cost", "modtot_cost"],
    places=7,
)
#: The loan table's fields by kind; the others are numbers.
_LOAN_TEXTS = """orig_chn orig_dte frst_dte num_bo fthb_flg purpose prop_typ num_unit occ_stat state zip_3 relocation_flg msa mod_flag
    zero_bal_code lpi_dte repch_flag transfer_flg last_stat vin_yr act_yr disp_yr""".split()
_LOAN_DAYS = "fcc_dte disp_dt fmod_dte fce_dte f180_dte last_dte".split()
_LOAN_COUNTS = "orig_trm modtrm_chng modupb_chng zb2disp".split()
_LOAN_NUMBERS = """orig_rt orig_amt oltv ocltv dti cscore_b mi_pct cscore_c mi_type cscore_mn orig_val last_rt fcc_cost pp_cost ar_cost
    ie_cost tax_cost ns_procs ce_procs rmw_procs o_procs modfg_cost c_modfb_cost fmod_upb fce_upb f180_upb last_upb non_int_upb
    fin_upb int_cost net_loss net_sev total_cost tot_procs tot_liq_ex c_modir_cost modir_total modfb_total""".split()
_loan_fields(
    "loan_table",
    f"""{', '.join(_LOAN_TEXTS)}, {text(*_LOAN_DAYS)}, {_dbl(*_LOAN_COUNTS)}, {r(*_LOAN_NUMBERS, places=6)},
    round(-prin_forg, 6) + 0.0e0 AS prin_forg_upb, {_MODTOT.replace('7', '6')}""",
    [*_LOAN_TEXTS, *_LOAN_DAYS, *_LOAN_COUNTS, *_LOAN_NUMBERS, "prin_forg_upb", "modtot_cost"],
    places=6,
    doubles=tuple(_LOAN_COUNTS),
)


@register(
    "status_groups",
    oracle(
        """SELECT loan_id, coalesce(last_stat IN ('C','1','2','3','4','5','6','7','8','9'), false) AS active,
           coalesce(last_stat IN ('S', 'T'), false) AS alternative, coalesce(last_stat IN ('F','S','T','N'), false) AS credit_event,
           coalesce(mod_flag = 'Y', false) AS modified FROM loans""",
        "loans",
    ),
)
def status_groups(spark, d):
    stat = F.col("last_stat")
    return loans(spark, d).select(
        "loan_id",
        is_in(stat, L.ACTIVE_STATUS).alias("active"),
        is_in(stat, L.ALTERNATIVE_STATUS).alias("alternative"),
        L.credit_event(stat).alias("credit_event"),
        L.modified(F.col("mod_flag")).alias("modified"),
    )
