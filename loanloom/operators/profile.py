"""Profiling and exploration of a loan-level frame."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.loan import log_feature
from loanloom.operators.ranked import quantile_columns, running_totals

#: Grid points in a bandwidth, and bandwidths that a value reaches: what lies beyond adds less than 1e-8.
DENSITY_STEPS, DENSITY_REACH = 2, 6.0
WHISKER = 1.5


def lookup(df: DataFrame, loan_id: str) -> DataFrame:
    return df.filter(F.col("loan_id") == loan_id)


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def delinquent(df: DataFrame, status: str = "delq_status") -> DataFrame:
    """Rows with a known delinquency status."""
    return df.filter(F.col(status) != "X")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, missing included, most frequent first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value"))


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts per combination; a missing value is a group shown as ``nan``."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns]
    return df.groupBy(*shown).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls")


def frame_info(df: DataFrame) -> DataFrame:
    """Column position, name, type and number of present values."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def default_rate(
    df: DataFrame, keys: list[str], norm_keys: list[str] | None = None, label: str = "label"
) -> DataFrame:
    """Percentage of defaults per group, highest first; groups without any drop out.

    ``norm_keys`` (a subset of ``keys``) names the group whose size is the
    denominator when that is coarser than the group itself.
    """
    known = df.filter(F.col(label).isNotNull())
    groups = known.groupBy(*keys).agg(
        F.sum(label).alias("defaults"), F.count(F.lit(1)).alias("loans")
    )
    whole = F.col("loans")
    if norm_keys and list(norm_keys) != list(keys):
        whole = F.sum("loans").over(Window.partitionBy(*norm_keys))
    rate = groups.select(*keys, "defaults", (100 * F.col("defaults") / whole).alias("rate"))
    return (
        rate.filter(F.col("defaults") > 0).drop("defaults").orderBy(F.desc("rate"), *keys)
    )


def label_category_counts(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Counts per label, column and category; missing categories are left out."""
    texts = df.select(label, *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([label], columns, "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy(label, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _long(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    numbers = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot(keys, columns, "column", "x").filter(F.col("x").isNotNull())


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, quartiles, mean, max and number of missing values per column.

    Missing values are a group of their own in the running totals, so that all
    statistics come from one pass over ``df``.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = numbers.unpivot([], columns, "column", "x").select(
        "column", F.col("x").isNull().alias("missing"), F.coalesce("x", F.lit(0.0)).alias("x")
    )
    totals = running_totals(long, "x", {"n": F.lit(1)}, ("column", "missing"))
    present, n = ~F.col("missing"), F.col("n")
    shown = F.when(present, F.col("x"))
    q1, median, q3 = quantile_columns("x", QUARTILES, present)
    return totals.groupBy("column").agg(
        F.min(shown).alias("min"),
        q1,
        median,
        F.try_divide(F.sum(shown * n), F.sum(F.when(present, n))).alias("mean"),
        q3,
        F.max(shown).alias("max"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).cast("double").alias("nulls"),
    )


def box_stats(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Quartiles and whisker ends per label and column.

    A whisker ends at the outermost value within 1.5 interquartile ranges.
    """
    long = _long(labelled(df, label), columns, [label])
    totals = running_totals(long, "x", {"n": F.lit(1)}, (label, "column"))
    marks = totals.groupBy(label, "column").agg(*quantile_columns("x", QUARTILES))
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    # The marks have one row per label and column, whatever the number of loans.
    inside = totals.join(F.broadcast(marks), [label, "column"]).filter(
        F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    )
    return inside.groupBy(label, "column").agg(
        F.min("x").alias("low"),
        *[F.max(m).alias(m) for m in QUARTILES],
        F.max("x").alias("high"),
    )


def density(
    df: DataFrame,
    columns: list[str],
    bandwidth: dict[int, float],
    label: str = "label",
    steps: int = DENSITY_STEPS,
) -> DataFrame:
    """Gaussian density per label and column: ``(label, column, at, x, density)``.

    Grid points are the multiples of ``1 / steps`` of the bandwidth within
    ``DENSITY_REACH`` bandwidths of a value, so the grid follows the bandwidth
    and leaves out empty stretches, where the density is 0.  The kernel is
    evaluated at the values themselves: distinct values with their counts, each
    sent to the points it reaches.  The points times their spacing add up to 1.
    Labels without a bandwidth and missing values are left out.
    """
    bw = F.create_map(*[F.lit(v) for pair in bandwidth.items() for v in pair])
    width = F.try_element_at(bw, F.col(label).cast("int")).cast("double")
    values = _long(labelled(df, label), columns, [label]).groupBy(label, "column", "x").agg(F.count(F.lit(1)).alias("n"))
    near = values.withColumn("bw", width).filter((F.col("bw") > 0) & ~F.isnan("x"))
    step, reach = F.col("bw") / steps, DENSITY_REACH * F.col("bw")
    points = F.sequence(F.ceil((F.col("x") - reach) / step), F.floor((F.col("x") + reach) / step))
    distance = (F.col("at") * step - F.col("x")) / F.col("bw")
    kernel = F.exp(-0.5 * distance * distance) / (F.col("bw") * math.sqrt(2 * math.pi))
    summed = (
        near.withColumn("at", F.explode(points))
        .groupBy(label, "column", "at", "bw")
        .agg(F.sum(F.col("n") * kernel).alias("mass"))
    )
    totals = values.groupBy(label, "column").agg(F.sum("n").alias("total"))
    # One total per label and column, whatever the number of loans.
    return summed.join(F.broadcast(totals), [label, "column"]).select(
        label, "column", "at", (F.col("at") * step).alias("x"), (F.col("mass") / F.col("total")).alias("density")
    )


def log_features(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Add ``log_<column>``, times the sign given for it."""
    return df.withColumns({f"log_{c}": log_feature(F.col(c), s) for c, s in columns.items()})


def top_rows(df: DataFrame, by: list[Column], n: int = 20) -> DataFrame:
    return df.orderBy(*by).limit(n)
