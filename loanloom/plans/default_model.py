"""Default prediction: from the combined table to a scored later cohort."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions import loan as L
from loanloom.functions.dates import parse_day
from loanloom.operators import features as X
from loanloom.operators import joins, panel
from loanloom.operators.profile import log_features
from loanloom.operators.ranked import quantiles

# The columns of the model frame.
CATEGORIES = [
    "orig_chn",
    "seller_name",
    "num_bo",
    "fthb_flg",
    "purpose",
    "num_unit",
    "prop_typ",
    "state",
    "relocation_flg",
    "occ_stat",
]
PROFILED_CATEGORIES = [c for c in CATEGORIES if c != "state"]
CONTINUOUS = ["orig_rt", "orig_amt", "orig_trm", "oltv", "ocltv", "dti", "orig_val", "cscore_mn"]
LOGGED = {"orig_val": 1, "orig_amt": 1, "oltv": 1, "orig_trm": -1, "ocltv": 1, "dti": 1}
NUMBERS = ["orig_rt", "cscore_mn", "latitude", "longitude", *[f"log_{c}" for c in LOGGED]]
GAPPY = ["num_bo"]


def combined_table(acq: DataFrame, perf: DataFrame, row_seq: str | None = None) -> DataFrame:
    """Acquisitions joined with every loan's closing panel row (55 columns).

    Give a ``perf`` with only the columns needed (and ``monthly_rpt_prd``) for a
    narrower table: the closing row is picked as a whole.
    """
    seq = F.col(row_seq).cast("bigint") if row_seq else F.xxhash64(*perf.columns)
    placed = perf.withColumns({"period": parse_day(F.col("monthly_rpt_prd")), "row_seq": seq})
    last = panel.last_rows(placed).drop("period", "row_seq")
    return joins.acquisitions_with_last_row(acq, last)


def model_rows(
    combined: DataFrame, centroids: DataFrame, require_disposition: bool = False
) -> DataFrame:
    """Labelled loans with derived, located and logged features."""
    c = F.col
    derived = combined.withColumns(
        {
            "orig_val": L.home_value(c("orig_amt"), c("oltv")),
            "ocltv": L.combined_ltv(c("ocltv"), c("oltv")),
            "cscore_mn": L.lowest_score_borrower_first(c("cscore_b"), c("cscore_c")),
            "label": L.default_label(c("zero_bal_code"), c("disp_dt"), require_disposition),
        }
    ).filter(c("label").isNotNull())
    located = joins.with_location(derived, centroids)
    kept = ["loan_id", "label", *CATEGORIES, *CONTINUOUS, "latitude", "longitude"]
    return log_features(located.select(*kept), LOGGED)


@dataclass(frozen=True)
class Preparation:
    """What has to be learnt from the training rows to prepare them and later ones."""

    levels: dict[str, list[str]]
    medians: dict[str, float]
    gaps: tuple[str, ...]

    @property
    def indicators(self) -> list[str]:
        return [X.indicator_name(c, v) for c in CATEGORIES for v in self.levels[c][1:]]

    @property
    def feature_names(self) -> list[str]:
        """Features of learners that need complete rows."""
        return [*NUMBERS, *[c + "_missing" for c in (*self.gaps, *GAPPY)], *self.indicators]

    @property
    def open_names(self) -> list[str]:
        """Features of learners that take missing numbers as they are."""
        return [*NUMBERS, *self.indicators]

    def frame(self, rows: DataFrame) -> DataFrame:
        """Numbers as they are and 0/1 columns."""
        coded = X.one_hot(rows, CATEGORIES, self.levels)
        return coded.select("loan_id", F.col("label").cast("int").alias("label"), *self.open_names)

    def apply(self, rows: DataFrame) -> DataFrame:
        """Complete numeric columns, ready to be assembled; any number that is missing gets the median."""
        flagged = rows.withColumns({c + "_missing": F.col(c).isNull().cast("int") for c in GAPPY})
        filled = X.median_fill(flagged, NUMBERS, self.medians)
        coded = X.one_hot(filled, CATEGORIES, self.levels)
        return coded.select("loan_id", F.col("label").cast("int").alias("label"), *self.feature_names)

    def assemble(self, rows: DataFrame) -> DataFrame:
        prepared = X.assemble(self.apply(rows), self.feature_names)
        return prepared.select("loan_id", "label", "features")


def learn_preparation(rows: DataFrame) -> Preparation:
    """Category levels, medians of the numbers and which of them have gaps, of ``rows`` alone: give the training part."""
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in NUMBERS])
    long = numbers.unpivot([], NUMBERS, "column", "x")
    medians = quantiles(long, "x", {"median": 0.5}, ("column",)).collect()
    known = {r["column"]: r["median"] for r in medians}
    missing = numbers.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in NUMBERS]).first()
    gaps = tuple(c for c in NUMBERS if missing[c])
    return Preparation(X.levels(rows, CATEGORIES), {c: known.get(c, 0.0) for c in NUMBERS}, gaps)
