"""Reports, profiles and exploration."""

from pyspark.sql import functions as F

from checks import views
from checks.registry import acq, centroids, closing_codes, combined, labelled_rows, loans, oracle, r, register, tidy
from loanloom import schema
from loanloom.functions import dates as D
from loanloom.functions import loan as L
from loanloom.operators import profile as R
from loanloom.operators.joins import with_location
from loanloom.plans import reports as V
from loanloom.plans.default_model import CONTINUOUS, LOGGED, PROFILED_CATEGORIES

_ACTIVE = "last_stat IN ('C', '1', '2', '3', '4', '5', '6', '7', '8', '9')"
_GONE = "coalesce(last_stat IN ('F', 'S', 'T', 'N') AND disp_dt IS NOT NULL, false)"
_MOD = "coalesce(mod_flag = 'Y', false)"


def _bigint(name: str, expr: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _num(name: str, expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0e0 AS {name}"


def _where(cond: str, x: str = "1") -> str:
    zero = "0" if x == "1" else "0.0e0"
    return f"coalesce(sum(CASE WHEN {cond} THEN {x} ELSE {zero} END), {zero})"


def _grouped(key: str, *measures: str) -> str:
    return oracle(
        f"""SELECT CASE WHEN grouping({key}) = 1 THEN 'Total' ELSE {key} END AS {key}, {', '.join(measures)}
        FROM loans GROUP BY GROUPING SETS (({key}), ())""",
        "loans",
    )


def _wmean(x: str) -> str:
    return f"sum({x} * orig_amt) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN orig_amt END), 0)"


_COUNT = _bigint("loan_count", "count(*)")
_ORIG = _num("total_orig_upb", "coalesce(sum(orig_amt), 0.0e0)")
_DEFAULT = _num("default_upb", _where(_GONE, "last_upb"))
_LOSS_RATE = _num("net_loss_rate", f"{_where(_GONE, 'net_loss')} / nullif(sum(orig_amt), 0)")

_ACQ_MEASURES = (
    _COUNT,
    _ORIG,
    "round_even(avg(orig_amt), 0) + 0.0e0 AS avg_orig_upb",
    f"round_even({_wmean('cscore_b')}, 0) + 0.0e0 AS borrower_score",
    f"round_even({_wmean('cscore_c')}, 0) + 0.0e0 AS co_borrower_score",
    _num("ltv", _wmean("oltv")),
    _num("cltv", _wmean("ocltv")),
    _num("dti", _wmean("dti")),
    _num("note_rate", _wmean("orig_rt")),
)


@register("acquisition_statistics", _grouped("vin_yr", *_ACQ_MEASURES))
def acquisition_statistics(spark, d):
    return tidy(V.acquisition_statistics(loans(spark, d)))


@register(
    "acquisition_statistics_display",
    _grouped(
        "vin_yr",
        _COUNT,
        *[f"coalesce(printf('%.3f', {_wmean(x)}), 'NaN') AS {n}" for n, x in
          (("ltv", "oltv"), ("cltv", "ocltv"), ("dti", "dti"), ("note_rate", "orig_rt"))],
    ),
)
def acquisition_statistics_display(spark, d):
    shown = V.display_report(V.acquisition_statistics(loans(spark, d)))
    return shown.select("vin_yr", "loan_count", "ltv", "cltv", "dti", "note_rate")


@register(
    "performance_counts",
    _grouped(
        "vin_yr",
        _COUNT,
        _ORIG,
        _bigint("active_count", _where(_ACTIVE)),
        _num("active_upb", _where(_ACTIVE, "last_upb")),
        _bigint("prepaid_count", _where("last_stat = 'P'")),
        _bigint("repurchased_count", _where("last_stat = 'R'")),
        _bigint("alternative_count", _where("last_stat IN ('S', 'T')")),
        _bigint("reo_count", _where("last_stat = 'F'")),
        _bigint("modified_count", _where(_MOD)),
        _DEFAULT,
        _LOSS_RATE,
    ),
)
def performance_counts(spark, d):
    return tidy(V.performance_counts(loans(spark, d)))


@register(
    "performance_balances",
    _grouped(
        "vin_yr",
        _COUNT,
        _ORIG,
        _num("active_upb", _where(_ACTIVE, "last_upb")),
        _num("prepaid_upb", _where("last_stat = 'P'", "last_upb")),
        _num("reo_upb", _where("last_stat = 'F'", "last_upb")),
        _num("alternative_upb", _where("last_stat IN ('S', 'T')", "last_upb")),
        _num("repurchased_upb", _where("last_stat = 'R'", "last_upb")),
        _num("modified_upb", _where(_MOD, "last_upb")),
        _DEFAULT,
        _LOSS_RATE,
    ),
)
def performance_balances(spark, d):
    return tidy(V.performance_balances(loans(spark, d)))


_LOST = _where(_GONE, "last_upb")
_LOSS_MEASURES = (
    _bigint("loan_count", _where(_GONE)),
    _num("liquidation_upb", _LOST),
    _num("default_upb_pct", f"{_LOST} / nullif(sum(orig_amt), 0) * 100"),
    *[_num(n, f"{_where(_GONE, f)} / nullif({_LOST}, 0) * 100") for n, f in V.LOSS_SHARES.items()],
    _num("total_net_loss", _where(_GONE, "net_loss"), 4),
)


def _loss(spark, d, key):
    report = V.historical_net_loss(loans(spark, d), key)
    total = F.round("total_net_loss", 4) + F.lit(0.0)
    return tidy(report).withColumn("total_net_loss", total)


@register("historical_net_loss_by_vintage", _grouped("vin_yr", *_LOSS_MEASURES))
def historical_net_loss_by_vintage(spark, d):
    return _loss(spark, d, "vin_yr")


@register("historical_net_loss_by_disposition", _grouped("disp_yr", *_LOSS_MEASURES))
def historical_net_loss_by_disposition(spark, d):
    return _loss(spark, d, "disp_yr")


@register(
    "transposed_loss_report",
    oracle(
        "SELECT measure, "
        + ", ".join(f"""round(max(CASE WHEN vin_yr = '{k}' THEN value END), 4) + 0.0e0 AS "{k}" """ for k in ["Total", *range(1995, 2002)])
        + """, round(max(CASE WHEN vin_yr IS NULL THEN value END), 4) + 0.0e0 AS "None" FROM (UNPIVOT (SELECT * REPLACE (CAST(loan_count AS DOUBLE) AS loan_count) FROM report)
                 ON COLUMNS(* EXCLUDE vin_yr) INTO NAME measure VALUE value) GROUP BY measure""",
        "loans",
        extra={
            "report": f"""SELECT CASE WHEN grouping(vin_yr) = 1 THEN 'Total' ELSE vin_yr END AS vin_yr, {', '.join(_LOSS_MEASURES)}
            FROM loans GROUP BY GROUPING SETS ((vin_yr), ())"""
        },
    ),
)
def transposed_loss_report(spark, d):
    report = V.historical_net_loss(loans(spark, d), "vin_yr")
    return tidy(V.transpose(report, "vin_yr"), places=4)


#: All vintages of the driver's tables; the reports find them by themselves.
_YEARS = [str(y) for y in range(1995, 2002)]
_BUCKET = """CASE WHEN cscore_mn IS NULL THEN 'MissingFICO' WHEN cscore_mn < 0 THEN 'NA' WHEN cscore_mn < 620 THEN '[0-620)'
  WHEN cscore_mn < 660 THEN '[620-660)' WHEN cscore_mn < 700 THEN '[660-700)' WHEN cscore_mn < 740 THEN '[700-740)'
  WHEN cscore_mn < 780 THEN '[740-780)' ELSE '[780+)' END"""


def _crosstab(row: str, expr: str) -> str:
    cells = ", ".join(_bigint(f'"{y}"', _where(f"vin_yr = '{y}'")) for y in _YEARS)
    return oracle(
        f"""SELECT CASE WHEN grouping(g) = 1 THEN 'Sum' ELSE g END AS {row}, {cells}, count(*) AS "Sum"
        FROM (SELECT {expr} AS g, vin_yr FROM loans) WHERE g IS NOT NULL AND vin_yr IS NOT NULL
        GROUP BY GROUPING SETS ((g), ())""",
        "loans",
    )


@register("purpose_by_vintage", _crosstab("purpose", "purpose"))
def purpose_by_vintage(spark, d):
    return V.purpose_by_vintage(loans(spark, d))


@register("occupancy_by_vintage", _crosstab("occ_stat", "occ_stat"))
def occupancy_by_vintage(spark, d):
    return V.occupancy_by_vintage(loans(spark, d))


@register("fico_by_vintage", _crosstab("fico_bkt", _BUCKET))
def fico_by_vintage(spark, d):
    return V.fico_by_vintage(loans(spark, d))


@register(
    "status_counts",
    oracle(
        """SELECT CASE WHEN grouping(last_stat) = 1 THEN 'Sum' ELSE last_stat END AS last_stat, count(*) AS n
        FROM loans WHERE last_stat IS NOT NULL GROUP BY GROUPING SETS ((last_stat), ())""",
        "loans",
    ),
)
def status_counts(spark, d):
    return V.status_counts(loans(spark, d))


def _stat(name: str, fn: str) -> str:
    cols = ", ".join(_num(c, fn.format(c=c)) for c in ("cscore_mn", "oltv", "orig_amt"))
    return f"SELECT '{name}' AS stat, {cols} FROM loans"


@register(
    "origination_summary",
    oracle(
        " UNION ALL ".join(
            [
                _stat("min", "min({c})"),
                _stat("q1", "quantile_cont({c}, 0.25)"),
                _stat("median", "quantile_cont({c}, 0.5)"),
                _stat("mean", "avg({c})"),
                _stat("q3", "quantile_cont({c}, 0.75)"),
                _stat("max", "max({c})"),
                _stat("nulls", "CAST(count(*) - count({c}) AS DOUBLE)"),
            ]
        ),
        "loans",
    ),
)
def origination_summary(spark, d):
    return tidy(V.origination_summary(loans(spark, d)))


@register(
    "rounded_amounts",
    oracle("SELECT loan_id, round_even(orig_amt / 16, 0) + 0.0e0 AS whole, round_even(orig_rt, 1) + 0.0e0 AS tenth FROM acq", "acq"),
)
def rounded_amounts(spark, d):
    return acq(spark, d).select(
        "loan_id",
        (L.round_half_even(F.col("orig_amt") / 16) + 0.0).alias("whole"),
        (L.round_half_even(F.col("orig_rt"), 1) + 0.0).alias("tenth"),
    )


# --- profiles -----------------------------------------------------------------


@register("zip_value_counts", oracle("SELECT zip_3 AS value, count(*) AS n FROM combined GROUP BY 1", "combined"))
def zip_value_counts(spark, d):
    return R.value_counts(closing_codes(spark, d), "zip_3")


@register(
    "zero_balance_value_counts",
    oracle("SELECT zero_bal_code AS value, count(*) AS n FROM combined GROUP BY 1", "combined"),
)
def zero_balance_value_counts(spark, d):
    return R.value_counts(closing_codes(spark, d), "zero_bal_code")


@register(
    "delinquency_by_zero_balance",
    oracle(
        "SELECT coalesce(delq_status, 'nan') AS delq_status, coalesce(zero_bal_code, 'nan') AS zero_bal_code, count(*) AS n FROM combined GROUP BY 1, 2",
        "combined",
    ),
)
def delinquency_by_zero_balance(spark, d):
    return R.group_counts(closing_codes(spark, d), "delq_status", "zero_bal_code")


@register(
    "missing_counts",
    oracle(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM combined" for c in schema.COMBINED.fieldNames()
        ),
        "combined",
    ),
)
def missing_counts(spark, d):
    return R.missing_counts(combined(spark, d))


@register(
    "frame_info",
    oracle(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{n}' AS \"column\", '{t}' AS type, count({n}) AS non_null FROM acq"
            for i, (n, t) in enumerate((f.name, f.dataType.simpleString()) for f in schema.ACQUISITION.fields)
        ),
        "acq",
    ),
)
def frame_info(spark, d):
    return R.frame_info(acq(spark, d))


@register(
    "default_labels",
    oracle(
        """SELECT loan_id, CAST(label AS DOUBLE) AS label,
             CAST(CASE WHEN zero_bal_code IN ('02', '03', '09', '15') AND disp_dt IS NOT NULL THEN 1
               WHEN zero_bal_code IN ('01', '06', '16') THEN 0 END AS DOUBLE) AS strict_label FROM labelled""",
        "labelled",
    ),
)
def default_labels(spark, d):
    zb, disp = F.col("zero_bal_code"), F.col("disp_dt")
    return closing_codes(spark, d).select(
        "loan_id",
        L.default_label(zb, disp).cast("double").alias("label"),
        L.default_label(zb, disp, require_disposition=True).cast("double").alias("strict_label"),
    )


def _labelled(spark, d):
    df = closing_codes(spark, d)
    return df.withColumn("label", L.default_label(F.col("zero_bal_code"), F.col("disp_dt")))


@register(
    "labelled_loans",
    oracle("SELECT loan_id, label FROM labelled WHERE label IS NOT NULL", "labelled"),
)
def labelled_loans(spark, d):
    return R.labelled(_labelled(spark, d)).select("loan_id", "label")


@register(
    "class_balance",
    oracle("SELECT CAST(label AS DOUBLE) AS label, count(*) AS n FROM labelled GROUP BY 1", "labelled"),
)
def class_balance(spark, d):
    return R.class_balance(_labelled(spark, d)).withColumn("label", F.col("label").cast("double"))


@register(
    "default_rate_by_state",
    oracle(
        "SELECT state, round(100.0e0 * avg(label), 6) + 0.0e0 AS rate FROM labelled WHERE label IS NOT NULL GROUP BY 1 HAVING sum(label) > 0",
        "labelled",
    ),
)
def default_rate_by_state(spark, d):
    return tidy(R.default_rate(_labelled(spark, d), ["state"]))


_LOCATION = """SELECT latitude, longitude, sum(label) AS defaults, count(*) AS n FROM located GROUP BY 1, 2"""


@register(
    "default_rate_by_location",
    oracle(
        f"SELECT {r('latitude', 'longitude')}, round(100.0e0 * defaults / n, 6) + 0.0e0 AS rate FROM g WHERE defaults > 0",
        "located",
        extra={"g": _LOCATION},
    ),
)
def default_rate_by_location(spark, d):
    return tidy(R.default_rate(labelled_rows(spark, d), ["latitude", "longitude"]))


@register(
    "default_rate_by_latitude",
    oracle(
        f"""SELECT {r('latitude', 'longitude')}, round(100.0e0 * defaults / total, 6) + 0.0e0 AS rate
        FROM (SELECT *, sum(n) OVER (PARTITION BY latitude) AS total FROM g) WHERE defaults > 0""",
        "located",
        extra={"g": _LOCATION},
    ),
)
def default_rate_by_latitude(spark, d):
    return tidy(R.default_rate(labelled_rows(spark, d), ["latitude", "longitude"], ["latitude"]))


@register(
    "top_default_locations",
    oracle(
        f"""SELECT {r('latitude', 'longitude')}, round(rate, 6) + 0.0e0 AS rate FROM
        (SELECT latitude, longitude, 100.0e0 * defaults / n AS rate FROM g WHERE defaults > 0
         ORDER BY rate DESC, latitude, longitude LIMIT 20)""",
        "located",
        extra={"g": _LOCATION},
    ),
)
def top_default_locations(spark, d):
    rates = R.default_rate(labelled_rows(spark, d), ["latitude", "longitude"])
    return tidy(R.top_rows(rates, [F.desc("rate"), F.col("latitude"), F.col("longitude")], 20))


@register(
    "zip_centroids",
    oracle(f"SELECT zip_3, {r('latitude', 'longitude')} FROM centroids", "centroids"),
)
def zip_centroids(spark, d):
    return tidy(centroids(spark, d))


@register(
    "located_loans",
    oracle(
        f"SELECT a.loan_id, a.zip_3, {r('latitude', 'longitude')} FROM acq a JOIN centroids c ON nullif(a.zip_3, '000') = c.zip_3",
        "acq",
        "centroids",
    ),
)
def located_loans(spark, d):
    return tidy(with_location(acq(spark, d), centroids(spark, d)), "loan_id", "zip_3", "latitude", "longitude")


@register(
    "label_category_counts",
    oracle(
        " UNION ALL ".join(
            f"SELECT label, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM labelled WHERE label IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 3"
            for c in PROFILED_CATEGORIES
        ),
        "labelled",
    ),
)
def label_category_counts(spark, d):
    return R.label_category_counts(R.labelled(_labelled(spark, d)), PROFILED_CATEGORIES)


_BOXED = ["ocltv", "dti", "cscore_b", "orig_rt"]


@register(
    "box_statistics",
    oracle(
        """SELECT label, "column", round(min(x), 6) + 0.0e0 AS low, round(max(q1), 6) + 0.0e0 AS q1, round(max(median), 6) + 0.0e0 AS median,
        round(max(q3), 6) + 0.0e0 AS q3, round(max(x), 6) + 0.0e0 AS high FROM long JOIN marks USING (label, "column")
        WHERE x BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY 1, 2""",
        "combined",
        extra={
            "l": "SELECT *, CASE WHEN coalesce(fcc_dte, '') <> '' THEN 1 ELSE 0 END AS label FROM combined",
            "long": " UNION ALL ".join(
                f"SELECT label, '{c}' AS \"column\", {c} AS x FROM l WHERE {c} IS NOT NULL" for c in _BOXED
            ),
            "marks": """SELECT label, "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1, 2""",
        },
    ),
)
def box_statistics(spark, d):
    df = closing_codes(spark, d).withColumn("label", L.foreclosure_label(F.col("fcc_dte")))
    return tidy(R.box_stats(df, _BOXED))


_BW = {0: 0.2, 1: 2.0}


def _density_sql(columns: list[str]) -> str:
    """The definition: at every grid point the mean of the kernels of all values that are not far away."""
    long = " UNION ALL ".join(
        f"SELECT label, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM featured WHERE {c} IS NOT NULL" for c in columns
    )
    return oracle(
        """SELECT p.label, p."column", p.at, round(p.at * (p.bw / 2), 6) + 0.0e0 AS x,
        round(sum(v.n * exp(-0.5e0 * pow((p.at * (p.bw / 2) - v.x) / p.bw, 2))) / (p.bw * sqrt(2 * pi()) * max(total)), 6) + 0.0e0 AS density
        FROM points p JOIN spread v ON p.label = v.label AND p."column" = v."column" AND v.x BETWEEN p.at * (p.bw / 2) - 7 * p.bw AND p.at * (p.bw / 2) + 7 * p.bw
        GROUP BY p.label, p."column", p.at, p.bw""",
        "located",
        extra={
            "featured": "SELECT *, ln(orig_val) AS log_orig_val, ln(orig_amt) AS log_orig_amt, ln(oltv) AS log_oltv, "
            "-ln(orig_trm) AS log_orig_trm, ln(ocltv) AS log_ocltv, ln(dti) AS log_dti FROM located",
            "long": long,
            "spread": """SELECT label, "column", x, n, CASE label WHEN 0 THEN 0.2e0 ELSE 2.0e0 END AS bw, sum(n) OVER (PARTITION BY label, "column") AS total
                FROM (SELECT label, "column", x, count(*) AS n FROM long GROUP BY 1, 2, 3)""",
            "points": """SELECT DISTINCT label, "column", bw,
                unnest(range(CAST(ceil((x - 6 * bw) / (bw / 2)) AS BIGINT), CAST(floor((x + 6 * bw) / (bw / 2)) AS BIGINT) + 1)) AS at FROM spread""",
        },
        stored=True,
    )


@register("density_curves", _density_sql(CONTINUOUS))
def density_curves(spark, d):
    return tidy(R.density(labelled_rows(spark, d), CONTINUOUS, _BW))


_LOGS = ["orig_rt", *[f"log_{c}" for c in LOGGED], "cscore_mn"]


@register("log_density_curves", _density_sql(_LOGS))
def log_density_curves(spark, d):
    return tidy(R.density(labelled_rows(spark, d), _LOGS, _BW))


@register(
    "log_features",
    oracle(
        "SELECT loan_id, "
        + ", ".join(f"round({'-' if s < 0 else ''}ln({c}), 6) + 0.0e0 AS log_{c}" for c, s in LOGGED.items())
        + " FROM located",
        "located",
    ),
)
def log_features(spark, d):
    return tidy(labelled_rows(spark, d), "loan_id", *[f"log_{c}" for c in LOGGED])


@register(
    "origination_month_and_year",
    oracle(
        "SELECT loan_id, CAST(split_part(orig_dte, '/', 1) AS INTEGER) AS orig_month, CAST(split_part(orig_dte, '/', 2) AS INTEGER) AS orig_year FROM acq",
        "acq",
    ),
)
def origination_month_and_year(spark, d):
    month, year = D.month_and_year(F.col("orig_dte"))
    return acq(spark, d).select("loan_id", month.alias("orig_month"), year.alias("orig_year"))


@register("zip_prefixes", oracle("SELECT zipcode, substr(zipcode, 1, 3) AS zip_3 FROM zips", "zips"))
def zip_prefixes(spark, d):
    return views.zips(spark, d).select("zipcode", L.zip_prefix(F.col("zipcode")).alias("zip_3"))


@register(
    "appended_quarters",
    oracle(
        """SELECT loan_id, orig_dte, orig_amt, NULL::VARCHAR AS purpose FROM acq WHERE substr(orig_dte, 4, 4) <= '1998'
        UNION ALL SELECT loan_id, orig_dte, NULL::DOUBLE, purpose FROM acq WHERE substr(orig_dte, 4, 4) > '1998'""",
        "acq",
    ),
)
def appended_quarters(spark, d):
    df, year = acq(spark, d), F.substring("orig_dte", 4, 4)
    early = df.filter(year <= "1998").select("loan_id", "orig_dte", "orig_amt")
    late = df.filter(year > "1998").select("loan_id", "orig_dte", "purpose")
    return early.unionByName(late, allowMissingColumns=True)
