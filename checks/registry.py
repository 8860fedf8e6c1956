"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views
from loanloom.operators import panel as P
from loanloom.plans.default_model import combined_table, model_rows
from loanloom.plans.loan_table import build_loan_table
from loanloom.operators.joins import zip_centroids

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- shared frames (plans only; nothing is cached but the plan) --------------


@lru_cache(maxsize=8)
def acq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.loan_acq(spark, sf_dir)


@lru_cache(maxsize=8)
def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.loan_perf(spark, sf_dir)


@lru_cache(maxsize=8)
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prepare_panel(perf(spark, sf_dir), "row_seq")


@lru_cache(maxsize=8)
def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_loan_table(
        acq(spark, sf_dir), perf(spark, sf_dir), row_seq="row_seq", keep_working=True
    )


@lru_cache(maxsize=8)
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined_table(acq(spark, sf_dir), perf(spark, sf_dir), "row_seq")


@lru_cache(maxsize=8)
def closing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined table with only the closing columns that outcomes need.

    The closing row is picked as a whole, so the panel has to be narrowed first.
    """
    needed = ("monthly_rpt_prd", "delq_status", "zero_bal_code", "fcc_dte", "disp_dt", "row_seq")
    narrow = perf(spark, sf_dir).select("loan_id", *needed)
    return combined_table(acq(spark, sf_dir), narrow, "row_seq")


@lru_cache(maxsize=8)
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_centroids(views.zips(spark, sf_dir))


@lru_cache(maxsize=8)
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(closing_codes(spark, sf_dir), centroids(spark, sf_dir))


# --- comparable output -------------------------------------------------------

PLACES = 6


def tidy(df: DataFrame, *columns: str, places: int = PLACES) -> DataFrame:
    """Rounded doubles and text dates, so that both engines print the same."""
    out = []
    for f in df.select(*columns).schema.fields if columns else df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, places) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(*names: str, places: int = PLACES) -> str:
    """Rounded columns for the select list of an oracle statement."""
    return ", ".join(f'round({n}, {places}) + 0.0e0 AS {n}' for n in names)


def text(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


_W = "(PARTITION BY loan_id ORDER BY period, row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LAST = "QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY period DESC, row_seq DESC) = 1"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY period, row_seq) = 1"


def sql_day(c: str) -> str:
    return f"CAST(try_strptime({c}, '%m/%d/%Y') AS DATE)"


def sql_month(c: str) -> str:
    return f"CAST(try_strptime('01/' || {c}, '%d/%m/%Y') AS DATE)"


def _months(a: str, b: str) -> str:
    return f"(year({b}) * 12 + month({b}) - year({a}) * 12 - month({a}))"


def _sum0(*names: str) -> str:
    return "(" + " + ".join(f"coalesce({n}, 0.0e0)" for n in names) + ")"


_CE = "coalesce(last_stat IN ('F', 'S', 'T', 'N'), false)"
_GONE = f"({_CE} AND disp_dt IS NOT NULL)"
_COSTS = ("fcc_cost", "pp_cost", "ar_cost", "ie_cost", "tax_cost")
_PROCS = ("ns_procs", "ce_procs", "rmw_procs", "o_procs")

# CTE name -> (text, CTEs it needs)
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "acq": (views.LOAN_ACQ_SQL, ()),
    "perf": (views.LOAN_PERF_SQL, ()),
    "zips": (views.ZIPS_SQL, ()),
    "panel": (
        f"""SELECT * EXCLUDE (disp_dt, fcc_dte), {sql_day('monthly_rpt_prd')} AS period,
            {sql_day('disp_dt')} AS disp_dt, {sql_day('fcc_dte')} AS fcc_dte,
            CASE WHEN delq_status = 'X' THEN 999 ELSE TRY_CAST(delq_status AS INTEGER) END AS delq,
            prin_forg_upb_fhfa + prin_forg_upb_oth AS prin_forg FROM perf""",
        ("perf",),
    ),
    "carried": (
        f"""SELECT *, coalesce(last_value(CASE WHEN last_upb > 0 THEN last_upb END IGNORE NULLS) OVER {_W},
              first_value(last_upb) OVER {_W}) AS upb,
            coalesce(last_value(CASE WHEN non_int_upb > 0 THEN non_int_upb END IGNORE NULLS) OVER {_W},
              first_value(non_int_upb) OVER {_W}) AS non_int,
            row_number() OVER (PARTITION BY loan_id ORDER BY period, row_seq) AS month_no FROM panel""",
        ("panel",),
    ),
    "scan": (
        """SELECT *, lag(upb) OVER (PARTITION BY loan_id ORDER BY period, row_seq) AS prev_upb,
           coalesce(mod_flag = 'Y', false) AS is_mod FROM carried""",
        ("carried",),
    ),
    "costs": (
        """SELECT s.*, a.orig_rt,
             CASE WHEN is_mod THEN ((a.orig_rt - last_rt) / 1200) * upb ELSE 0.0e0 END AS modir_cost,
             CASE WHEN is_mod AND non_int IS NOT NULL THEN (last_rt / 1200) * non_int ELSE 0.0e0 END AS modfb_cost
           FROM scan s LEFT JOIN acq a ON s.loan_id = a.loan_id""",
        ("scan", "acq"),
    ),
    "lastrow": (f"SELECT * FROM scan {_LAST}", ("scan",)),
    "flags": (
        """SELECT loan_id,
             CASE WHEN count(DISTINCT coalesce(maturity_date, '')) > 1 AND bool_or(is_mod) THEN 1 ELSE 0 END AS modtrm_chng,
             max(CASE WHEN is_mod AND upb > prev_upb THEN 1 ELSE 0 END) AS modupb_chng,
             greatest(coalesce(max(prin_forg), 0.0e0), 0.0e0) AS modfg_cost,
             CASE WHEN count(*) = count(modir_cost) THEN sum(modir_cost) END AS c_modir_cost,
             CASE WHEN count(*) = count(modfb_cost) THEN sum(modfb_cost) END AS c_modfb_cost
           FROM costs GROUP BY loan_id""",
        ("costs",),
    ),
    "fmod": (
        f"SELECT loan_id, period AS fmod_dte, upb AS fmod_upb FROM scan WHERE mod_flag = 'Y' {_FIRST}",
        ("scan",),
    ),
    "fce": (
        f"""SELECT loan_id, period AS fce_dte, upb AS fce_upb, delq AS fce_delq, month_no AS fce_month FROM scan
            WHERE zero_bal_code IN ('03', '09') OR (delq >= 6 AND delq < 999) {_FIRST}""",
        ("scan",),
    ),
    "f180": (
        f"""SELECT loan_id, period AS f180_dte, upb AS f180_upb, delq AS f180_delq, month_no AS f180_month FROM scan
            WHERE delq >= 6 AND delq < 999 {_FIRST}""",
        ("scan",),
    ),
    "status": (
        f"""SELECT * EXCLUDE (last_upb, non_int_upb), upb AS last_upb, -non_int AS non_int_upb,
              {_sum0('upb', '-non_int', '-prin_forg')} AS fin_upb,
              CASE zero_bal_code WHEN '01' THEN 'P' WHEN '02' THEN 'T' WHEN '03' THEN 'S' WHEN '06' THEN 'R'
                WHEN '09' THEN 'F' WHEN '15' THEN 'N' WHEN '16' THEN 'L' ELSE
                CASE WHEN delq = 999 THEN 'X' WHEN delq > 9 THEN '9' WHEN delq = 0 THEN 'C'
                  ELSE CAST(delq AS VARCHAR) END END AS last_stat,
              CASE WHEN lpi_dte IS NOT NULL AND disp_dt IS NOT NULL
                THEN {_months(sql_day('lpi_dte'), 'disp_dt')} ELSE 0 END AS lpi_months,
              CASE WHEN disp_dt IS NOT NULL THEN {_months(sql_month('zb_dte'), 'disp_dt')} ELSE 0 END AS zb2disp
            FROM lastrow""",
        ("lastrow",),
    ),
    "expense": (
        f"""SELECT *, CASE WHEN {_GONE} THEN CASE WHEN fin_upb * (((last_rt / 100) - 0.0035e0) / 12) * lpi_months < 0 THEN 0.0e0
                ELSE fin_upb * (((last_rt / 100) - 0.0035e0) / 12) * lpi_months END ELSE 0.0e0 END AS int_cost,
              CASE WHEN {_GONE} THEN {_sum0(*_COSTS)} ELSE 0.0e0 END AS total_expense,
              CASE WHEN {_GONE} THEN -{_sum0(*_PROCS)} ELSE 0.0e0 END AS total_proceeds FROM status""",
        ("status",),
    ),
    "closed": (
        f"""SELECT *, CASE WHEN {_GONE} THEN {_sum0('last_upb', 'int_cost', 'total_expense', 'total_proceeds')} ELSE 0.0e0 END AS net_loss,
              CASE WHEN {_GONE} THEN {_sum0('last_upb', 'int_cost', 'total_expense', 'total_proceeds')} / nullif(last_upb, 0) ELSE 0.0e0 END AS net_sev,
              CASE WHEN {_CE} THEN {_sum0('last_upb', 'int_cost', *_COSTS)} ELSE 0.0e0 END AS total_cost,
              CASE WHEN {_CE} THEN {_sum0(*_PROCS)} ELSE 0.0e0 END AS tot_procs,
              CASE WHEN {_CE} THEN {_sum0(*_COSTS)} ELSE 0.0e0 END AS tot_liq_ex,
              coalesce(disp_dt, period) AS last_dte FROM expense""",
        ("expense",),
    ),
    "acq_derived": (
        """SELECT * EXCLUDE (ocltv), least(cscore_b, cscore_c) AS cscore_mn, orig_amt / nullif(oltv / 100, 0) AS orig_val,
           coalesce(ocltv, oltv) AS ocltv FROM acq""",
        ("acq",),
    ),
    "joined": (
        f"""SELECT coalesce(a.loan_id, c.loan_id) AS loan_id, a.* EXCLUDE (loan_id), c.* EXCLUDE (loan_id),
              fmod_dte, fmod_upb, fce_dte, fce_upb AS fce_raw, fce_delq, fce_month,
              f180_dte, f180_upb AS f180_raw, f180_delq, f180_month,
              modtrm_chng, modupb_chng, modfg_cost, c_modir_cost, c_modfb_cost
            FROM acq_derived a FULL JOIN closed c ON a.loan_id = c.loan_id
            LEFT JOIN flags g ON c.loan_id = g.loan_id LEFT JOIN fmod m ON c.loan_id = m.loan_id
            LEFT JOIN fce e ON c.loan_id = e.loan_id LEFT JOIN f180 d ON c.loan_id = d.loan_id""",
        ("acq_derived", "closed", "flags", "fmod", "fce", "f180"),
    ),
    "loans": (
        f"""SELECT *, CAST(year({sql_month('orig_dte')}) AS VARCHAR) AS vin_yr, CAST(year(last_dte) AS VARCHAR) AS act_yr,
              coalesce(CAST(year(disp_dt) AS VARCHAR), 'NO DISP_DT') AS disp_yr,
              CASE WHEN (f180_delq = 6 AND f180_raw IS NULL AND f180_month <= 6) IS NULL THEN NULL
                WHEN f180_delq = 6 AND f180_raw IS NULL AND f180_month <= 6 THEN orig_amt ELSE coalesce(f180_raw, 0.0e0) END AS f180_upb,
              CASE WHEN (fce_delq = 6 AND fce_raw IS NULL AND fce_month <= 6) IS NULL THEN NULL
                WHEN fce_delq = 6 AND fce_raw IS NULL AND fce_month <= 6 THEN orig_amt ELSE coalesce(fce_raw, 0.0e0) END AS fce_upb,
              CASE WHEN {_GONE} AND is_mod THEN zb2disp * ((orig_rt - last_rt) / 1200) * last_upb ELSE 0.0e0 END + c_modir_cost AS modir_total,
              CASE WHEN {_GONE} AND is_mod AND non_int_upb IS NOT NULL THEN zb2disp * (last_rt / 1200) * -non_int_upb ELSE 0.0e0 END + c_modfb_cost AS modfb_total,
            FROM joined""",
        ("joined",),
    ),
    "combined": (
        f"SELECT a.*, p.* EXCLUDE (loan_id, row_seq, period) FROM acq a JOIN "
        f"(SELECT *, {sql_day('monthly_rpt_prd')} AS period FROM perf {_LAST}) p ON a.loan_id = p.loan_id",
        ("acq", "perf"),
    ),
    "labelled": (
        """SELECT * EXCLUDE (ocltv), coalesce(ocltv, oltv) AS ocltv, orig_amt / nullif(oltv / 100, 0) AS orig_val,
             CASE WHEN cscore_b IS NOT NULL THEN least(cscore_b, cscore_c) END AS cscore_mn,
             CASE WHEN zero_bal_code IN ('02', '03', '09', '15') THEN 1 WHEN zero_bal_code IN ('01', '06', '16') THEN 0 END AS label
           FROM combined""",
        ("combined",),
    ),
    "centroids": (
        "SELECT substr(zipcode, 1, 3) AS zip_3, avg(latitude) AS latitude, avg(longitude) AS longitude FROM zips GROUP BY 1",
        ("zips",),
    ),
    "located": (
        """SELECT l.*, c.latitude, c.longitude FROM labelled l JOIN centroids c ON nullif(l.zip_3, '000') = c.zip_3
           WHERE label IS NOT NULL""",
        ("labelled", "centroids"),
    ),
}


def oracle(final: str, *needs: str, extra: dict[str, str] | None = None, stored: bool = False) -> str:
    """``final`` preceded by the CTEs it needs, in order; with ``stored``, the ``extra`` ones are computed once each."""
    used: list[str] = []

    def use(name: str) -> None:
        for n in _CTES[name][1]:
            use(n)
        if name not in used:
            used.append(name)

    for n in needs:
        use(n)
    ctes = [f"{n} AS ({_CTES[n][0]})" for n in used]
    ctes += [f"{n} AS {'MATERIALIZED ' if stored else ''}({t})" for n, t in (extra or {}).items()]
    return f"WITH {', '.join(ctes)} {final}"
