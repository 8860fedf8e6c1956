"""Date parsing and whole-month arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two date layouts of the loan files.
DAY_FORMAT = "MM/dd/yyyy"
MONTH_FORMAT = "MM/yyyy"
NO_DISPOSITION = "NO DISP_DT"


def parse_day(col: Column) -> Column:
    """``MM/dd/yyyy`` text to a date; blank or malformed text gives NULL."""
    return F.try_to_date(col, DAY_FORMAT)


def parse_month(col: Column) -> Column:
    """``MM/yyyy`` text to the first day of that month."""
    return F.try_to_date(col, MONTH_FORMAT)


def whole_months(start: Column, end: Column) -> Column:
    """Calendar months from ``start`` to ``end``, ignoring the day of month."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def year_text(date: Column) -> Column:
    return F.date_format(date, "yyyy")


def month_and_year(text: Column) -> tuple[Column, Column]:
    """Split ``MM/yyyy`` text into two integers."""
    parts = F.split(text, "/")
    return (
        F.trim(F.try_element_at(parts, F.lit(1))).try_cast("int"),
        F.trim(F.try_element_at(parts, F.lit(2))).try_cast("int"),
    )
