"""Missing-value rules of the loan measures, as column expressions.

SQL and the statistical tools loan tapes are usually worked with disagree on
missing values; every such rule lives here so that the measures can be read
without second-guessing each NULL.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(cond: Column, then: Column, other: Column) -> Column:
    """``then`` / ``other``, but NULL (not ``other``) where ``cond`` is unknown."""
    return F.when(cond, then).when(~cond, other)


def is_in(col: Column, values) -> Column:
    """Set membership that is false, never unknown, for a missing value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def equals(col: Column, value) -> Column:
    """Equality that is false, never unknown, for a missing value."""
    return F.coalesce(col == F.lit(value), F.lit(False))


def row_sum(*cols: Column) -> Column:
    """Sum across columns, skipping missing values; 0 when all are missing."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator instead of raising."""
    return F.try_divide(num, den)


def floor_at_zero(x: Column) -> Column:
    """``max(x, 0)`` that keeps a missing value missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def null_to_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
