"""Fixed schemas of the three loan files.

Columns are positional: the files carry no header, and types are never
inferred.  Codes that look like numbers (units, ZIP prefix, MSA, zero-balance
code) stay strings so that leading zeros survive.
"""

from pyspark.sql import types as T

# Column order and types of the input files.
ACQUISITION_COLUMNS = (
    ("loan_id", "string"),
    ("orig_chn", "string"),
    ("seller_name", "string"),
    ("orig_rt", "double"),
    ("orig_amt", "double"),
    ("orig_trm", "int"),
    ("orig_dte", "string"),
    ("frst_dte", "string"),
    ("oltv", "double"),
    ("ocltv", "double"),
    ("num_bo", "string"),
    ("dti", "double"),
    ("cscore_b", "double"),
    ("fthb_flg", "string"),
    ("purpose", "string"),
    ("prop_typ", "string"),
    ("num_unit", "string"),
    ("occ_stat", "string"),
    ("state", "string"),
    ("zip_3", "string"),
    ("mi_pct", "double"),
    ("product_type", "string"),
    ("cscore_c", "double"),
    ("mi_type", "double"),
    ("relocation_flg", "string"),
)

PERFORMANCE_COLUMNS = (
    ("loan_id", "string"),
    ("monthly_rpt_prd", "string"),
    ("servicer_name", "string"),
    ("last_rt", "double"),
    ("last_upb", "double"),
    ("loan_age", "double"),
    ("months_to_legal_mat", "double"),
    ("adj_month_to_mat", "double"),
    ("maturity_date", "string"),
    ("msa", "string"),
    ("delq_status", "string"),
    ("mod_flag", "string"),
    ("zero_bal_code", "string"),
    ("zb_dte", "string"),
    ("lpi_dte", "string"),
    ("fcc_dte", "string"),
    ("disp_dt", "string"),
    ("fcc_cost", "double"),
    ("pp_cost", "double"),
    ("ar_cost", "double"),
    ("ie_cost", "double"),
    ("tax_cost", "double"),
    ("ns_procs", "double"),
    ("ce_procs", "double"),
    ("rmw_procs", "double"),
    ("o_procs", "double"),
    ("non_int_upb", "double"),
    ("prin_forg_upb_fhfa", "double"),
    ("repch_flag", "string"),
    ("prin_forg_upb_oth", "double"),
    ("transfer_flg", "string"),
)

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _struct(columns) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], n != "loan_id") for n, t in columns])


ACQUISITION = _struct(ACQUISITION_COLUMNS)
PERFORMANCE = _struct(PERFORMANCE_COLUMNS)
COMBINED = _struct(ACQUISITION_COLUMNS + PERFORMANCE_COLUMNS[1:])
ZIP_DIMENSION = T.StructType(
    [
        T.StructField("zipcode", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)
