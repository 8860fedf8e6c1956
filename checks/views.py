"""Loan-shaped views over the driver tables.

The same expressions build the Spark frames and, as text, the CTEs that open
every oracle statement.  Both views are plain row-by-row projections (plus the
two small dimension joins of the acquisitions), so a query over them measures
the loan operators and not the preparation of the data.  No row is left out.

One loan in 97 carries another id in the panel than at origination, which gives
acquisitions without performance and performance without acquisition.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom import schema

_YM = "lpad(cast({m} % 12 + 1 as string), 2, '0') || '/{d}' || cast(cast(floor(({m}) / 12) as int) as string)"


def _month(index: str) -> str:
    return _YM.format(m=f"({index})", d="")


def _first_of_month(index: str) -> str:
    return _YM.format(m=f"({index})", d="01/")


# --- acquisitions: one row per order ---------------------------------------

_ACQ = {
    "loan_id": "lpad(cast(k as string), 12, '0')",
    "orig_chn": "CASE k % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'B' ELSE 'C' END",
    "seller_name": "c_mktsegment",
    "orig_rt": "4.0e0 + (k % 33) * 0.125e0",
    "orig_amt": "cast(50000 + (k * 7919) % 400000 as double)",
    "orig_trm": "CASE k % 4 WHEN 0 THEN 180 WHEN 1 THEN 240 ELSE 360 END",
    "orig_dte": "lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || cast(year(o_orderdate) as string)",
    "frst_dte": _month("year(o_orderdate) * 12 + month(o_orderdate) + 1"),
    "oltv": "cast(40 + k % 58 as double)",
    "ocltv": "CASE WHEN k % 7 = 0 THEN NULL ELSE cast(40 + k % 58 + k % 5 as double) END",
    "num_bo": "CASE WHEN k % 101 = 0 THEN NULL WHEN k % 5 < 3 THEN '1' ELSE '2' END",
    "dti": "CASE WHEN k % 11 = 0 THEN NULL ELSE cast(10 + o_custkey % 54 as double) END",
    "cscore_b": "CASE WHEN k % 13 = 0 THEN NULL ELSE cast(560 + (k * 37) % 290 as double) END",
    "fthb_flg": "CASE WHEN k % 9 = 0 THEN 'Y' ELSE 'N' END",
    "purpose": "CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'C' ELSE 'R' END",
    "prop_typ": "CASE k % 5 WHEN 0 THEN 'CO' WHEN 1 THEN 'PU' ELSE 'SF' END",
    "num_unit": "cast(1 + k % 4 as string)",
    "occ_stat": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'S' ELSE 'P' END",
    "state": "n_name",
    "zip_3": "lpad(cast(o_custkey % 200 as string), 3, '0')",
    "mi_pct": "CASE WHEN 40 + k % 58 > 80 THEN cast(25 as double) END",
    "product_type": "'FRM'",
    "cscore_c": "CASE WHEN k % 2 = 0 THEN NULL ELSE cast(540 + (k * 53) % 300 as double) END",
    "mi_type": "CASE WHEN 40 + k % 58 > 80 THEN 1.0e0 END",
    "relocation_flg": "CASE WHEN k % 50 = 0 THEN 'Y' ELSE 'N' END",
}

# --- performance: one row per line item ------------------------------------

_PERF_BASE = {
    "k": "l_orderkey",
    "p": "l_partkey",
    "s": "l_suppkey",
    "q": "l_quantity",
    "price": "l_extendedprice",
    "rate": "4.0e0 + (l_orderkey % 33) * 0.125e0",
    "amt": "cast(50000 + (l_orderkey * 7919) % 400000 as double)",
    "mi": "year(l_shipdate) * 12 + month(l_shipdate) - 1",
    "dd": "l_shipdate",
    "ln": "l_linenumber",
    "z": "l_orderkey % 16",
    "ends": "(l_partkey % 3 = 0)",
    "modf": "(l_orderkey % 10 IN (3, 7) AND l_linenumber >= 3)",
}
_GONE = "ends AND z < 5"

_PERF = {
    "loan_id": "lpad(cast(k + CASE WHEN k % 97 = 0 THEN 500000000000 ELSE 0 END as string), 12, '0')",
    "monthly_rpt_prd": "lpad(cast(month(dd) as string), 2, '0') || '/' || lpad(cast(day(dd) as string), 2, '0') || '/' || cast(year(dd) as string)",
    "servicer_name": "'SERVICER ' || cast(s % 10 as string)",
    "last_rt": "rate - CASE WHEN modf THEN 1.0e0 ELSE 0.0e0 END",
    "last_upb": "CASE WHEN p % 17 = 0 THEN NULL WHEN ends AND z < 7 THEN 0.0e0 ELSE amt - 100.0e0 * ln + CASE WHEN modf AND k % 3 = 0 THEN 5000.0e0 ELSE 0.0e0 END END",
    "loan_age": "cast(ln as double)",
    "months_to_legal_mat": "cast(360 - ln as double)",
    "adj_month_to_mat": "cast(360 - ln as double)",
    "maturity_date": "CASE WHEN p % 29 = 0 THEN NULL WHEN modf AND k % 2 = 1 THEN '06/2040' ELSE '01/2035' END",
    "msa": "lpad(cast(k % 500 as string), 5, '0')",
    "delq_status": "CASE WHEN p % 23 = 0 THEN 'X' WHEN ends AND z < 5 THEN NULL ELSE cast(cast(floor(q / 4) as int) as string) END",
    "mod_flag": "CASE WHEN modf THEN 'Y' WHEN k % 31 = 0 THEN NULL ELSE 'N' END",
    "zero_bal_code": "CASE WHEN NOT ends THEN NULL WHEN z = 0 THEN '02' WHEN z = 1 THEN '03' WHEN z IN (2, 3) THEN '09' WHEN z = 4 THEN '15' WHEN z = 5 THEN '06' WHEN z IN (6, 7, 8, 9) THEN '01' WHEN z = 10 THEN '16' END",
    "zb_dte": "CASE WHEN ends AND z < 11 AND p % 19 <> 0 THEN " + _month("mi + 1") + " END",
    "lpi_dte": f"CASE WHEN {_GONE} AND s % 7 <> 0 THEN " + _first_of_month("mi - 1") + " END",
    "fcc_dte": "CASE WHEN ends AND z IN (2, 3) THEN " + _first_of_month("mi + 1") + " END",
    "disp_dt": f"CASE WHEN {_GONE} AND k % 5 <> 0 THEN " + _first_of_month("mi + 4") + " END",
    "fcc_cost": f"CASE WHEN {_GONE} THEN floor(price / 20) + 0.0e0 END",
    "pp_cost": f"CASE WHEN {_GONE} AND s % 3 = 0 THEN floor(price / 50) + 0.0e0 END",
    "ar_cost": f"CASE WHEN {_GONE} THEN q * 10.0e0 END",
    "ie_cost": f"CASE WHEN {_GONE} THEN q + 0.0e0 END",
    "tax_cost": f"CASE WHEN {_GONE} THEN q * 25.0e0 END",
    "ns_procs": f"CASE WHEN {_GONE} THEN amt * 0.5e0 END",
    "ce_procs": f"CASE WHEN {_GONE} AND s % 2 = 0 THEN amt * 0.125e0 END",
    "rmw_procs": f"CASE WHEN {_GONE} AND s % 5 = 0 THEN 1000.0e0 END",
    "o_procs": f"CASE WHEN {_GONE} THEN 250.0e0 END",
    "non_int_upb": "CASE WHEN modf AND k % 3 <> 1 THEN 2000.0e0 + 100.0e0 * ln END",
    "prin_forg_upb_fhfa": "CASE WHEN modf AND k % 3 = 0 THEN 1500.0e0 END",
    "repch_flag": "'N'",
    "prin_forg_upb_oth": "CASE WHEN modf THEN 500.0e0 END",
    "transfer_flg": "'N'",
    "row_seq": "p * 8 + ln",
}

# --- ZIP dimension: one row per customer -----------------------------------

_ZIPS = {
    "zipcode": "lpad(cast(c_custkey % 200 as string), 3, '0') || lpad(cast(c_custkey % 89 as string), 2, '0')",
    "latitude": "cast(25 + c_custkey % 25 as double)",
    "longitude": "cast(-70 - c_custkey % 50 as double)",
}


def _types() -> dict[str, str]:
    named = {f.name: f.dataType.simpleString() for f in schema.ACQUISITION.fields}
    named.update({f.name: f.dataType.simpleString() for f in schema.PERFORMANCE.fields})
    return {**named, "row_seq": "bigint", "zipcode": "string", "latitude": "double", "longitude": "double"}


_TYPES = _types()


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"cast({e} as {_TYPES[n]}) AS {n}" if n in _TYPES else f"{e} AS {n}" for n, e in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a small file among all cores.

    One small file is read by a task or two; a table with at least as many
    splits as cores (any large one) is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def loan_acq(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders")).withColumn("k", F.col("o_orderkey"))
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.selectExpr(*_exprs(_ACQ))


def loan_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spread(table(spark, sf_dir, "lineitem"))
    return lineitem.selectExpr(*_exprs(_PERF_BASE)).selectExpr(*_exprs(_PERF))


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_exprs(_ZIPS))


def _select(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_exprs(columns))} FROM {source}"


LOAN_ACQ_SQL = _select(
    _ACQ,
    "(SELECT *, o_orderkey AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey) src",
)
LOAN_PERF_SQL = _select(_PERF, f"({_select(_PERF_BASE, 'lineitem')}) src")
ZIPS_SQL = _select(_ZIPS, "customer")
