"""Loan-level joins."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions import loan as L
from loanloom.operators.panel import KEYS, keys_above


# Above this many rows a key is joined apart from the others.  It also bounds what
# is broadcast: at most (rows / HOT_KEY_ROWS) keys.
HOT_KEY_ROWS = 1_000_000


def _ids(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys).distinct()


def _hot(keys, limit: int, *sides: DataFrame) -> DataFrame:
    """Keys with more than ``limit`` rows on a side, counted when the plan runs."""
    found = [keys_above(side, keys, limit).select(*keys) for side in sides]
    return F.broadcast(reduce(DataFrame.unionByName, found).distinct())


def outer_join(
    left: DataFrame, right: DataFrame, keys=KEYS, hot_key_rows: int | None = HOT_KEY_ROWS
) -> DataFrame:
    """Full outer join that can still be split when one key is hot.

    Spark's adaptive skew handling splits inner and anti joins but not full
    outer ones.  So hot keys are joined apart, in three disjoint parts; where
    there are none, adaptive execution leaves those out.  ``None`` is for sides
    that are known to have no hot key.
    """
    keys = list(keys)
    if hot_key_rows is None:
        return left.join(right, keys, "full")
    hot = _hot(keys, hot_key_rows, left, right)
    usual = left.join(hot, keys, "left_anti").join(right.join(hot, keys, "left_anti"), keys, "full")
    one, other = (side.join(hot, keys, "left_semi") for side in (left, right))
    return (
        usual.unionByName(one.join(other, keys))
        .unionByName(one.join(_ids(other, keys), keys, "left_anti"), allowMissingColumns=True)
        .unionByName(other.join(_ids(one, keys), keys, "left_anti"), allowMissingColumns=True)
    )


def outer_join_unique(
    left: DataFrame, right: DataFrame, keys=KEYS, hot_key_rows: int | None = HOT_KEY_ROWS
) -> DataFrame:
    """:func:`outer_join` for a ``right`` side with one row per key."""
    keys = list(keys)
    if hot_key_rows is None:
        return left.join(right, keys, "full")
    hot = _hot(keys, hot_key_rows, left)
    usual = left.join(hot, keys, "left_anti").join(right.join(hot, keys, "left_anti"), keys, "full")
    # the right side has a row for each hot key at most
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return usual.unionByName(left.join(hot, keys, "left_semi").join(few, keys, "left"))


def acquisitions_with_last_row(acq: DataFrame, last: DataFrame, keys=KEYS) -> DataFrame:
    """Inner join of acquisitions and closing panel rows (the 55-column table)."""
    return acq.join(last, list(keys))


def cohort_overlap(x: DataFrame, y: DataFrame, key: str = "loan_id") -> DataFrame:
    """Full outer join of two cohorts, ``_x`` / ``_y`` suffixes and a ``side``."""

    def tagged(df: DataFrame, s: str) -> DataFrame:
        names = [F.col(c).alias(c if c == key else f"{c}_{s}") for c in df.columns]
        return df.select(*names, F.lit(True).alias(f"in_{s}"))

    both = outer_join(tagged(x, "x"), tagged(y, "y"), (key,))
    side = (
        F.when(F.col("in_x") & F.col("in_y"), "both")
        .when(F.col("in_x"), "left_only")
        .otherwise("right_only")
    )
    return both.withColumn("side", side).drop("in_x", "in_y")


def zip_centroids(zips: DataFrame) -> DataFrame:
    """Mean latitude and longitude of every 3-digit ZIP prefix."""
    return zips.groupBy(L.zip_prefix(F.col("zipcode")).alias("zip_3")).agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )


def with_location(loans: DataFrame, centroids: DataFrame, zip_3: Column | None = None) -> DataFrame:
    """Inner join on the ZIP prefix; loans without a known prefix drop out.

    The centroid table is an aggregate by prefix; whether it is broadcast is
    left to the size the planner measures.
    """
    key = L.valid_zip_prefix(F.col("zip_3")) if zip_3 is None else zip_3
    return loans.withColumn("zip_3", key).join(centroids, "zip_3")
