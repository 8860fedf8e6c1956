"""Exact running totals and quantiles over a value order, without a global sort.

A window ordered by a value over the whole table would run in one task.  Here
the values are first reduced to distinct ones, then cut into ranges by
splitters drawn from the values themselves.  Range sums are few, so their
running totals are cheap; each distinct value adds up the totals of the ranges
before its own and of the values before it inside the range.  The splitters are
the values of least hash, one in each of ``SLOTS`` slots: a sample that depends
on the data alone, so a recomputed task cuts where the first one did.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splitters of a group at most, a square, and those that a search steps over at a time.
SLOTS, STRIDE = 1024, 32


def range_of(value: Column, splitters: Column) -> Column:
    """How many of the sorted ``splitters`` are below ``value``, found in two steps."""
    below = lambda part: F.size(F.filter(part, lambda s: s < value))
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(splitters) - 1) / STRIDE).cast("int")), lambda k: F.get(splitters, k * STRIDE))
    passed = F.greatest(below(strides) - 1, F.lit(0)) * STRIDE
    return passed + below(F.slice(splitters, passed + 1, F.lit(STRIDE)))


def _undefined(df: DataFrame, value: str) -> Column:
    """NaN; texts and dates are never undefined."""
    floating = df.schema[value].dataType.simpleString() in ("double", "float")
    return F.isnan(F.col(value)) if floating else F.lit(False)


def running_totals(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    keys: tuple[str, ...] = (),
    descending: bool = False,
) -> DataFrame:
    """One row per distinct ``value`` (within ``keys``) with totals before it.

    For every measure m the result has ``m`` (its sum at that value),
    ``m_before`` (its sum over all earlier values) and ``m_total``.  Rows with a
    missing or undefined (NaN) value, or a missing key, are not counted.

    ``keys`` are for a few groups (labels, columns, rounds): splitters are
    broadcast, ``SLOTS`` for each group.  Nothing runs when this is called;
    ``df`` is shuffled once and its distinct values are read three times.
    """
    names, group = list(measures), [*keys, "_whole"]

    def ordered(col: str) -> Column:
        return F.col(col).desc() if descending else F.col(col).asc()

    def before(part: list[str], by: str, suffix: str) -> dict[str, Column]:
        w = Window.partitionBy(*part).orderBy(ordered(by))
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return {n + suffix: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names}

    distinct = (
        df.filter(F.col(value).isNotNull() & ~_undefined(df, value))
        .groupBy(*keys, value)
        .agg(*[F.sum(m).alias(n) for n, m in measures.items()])
        .withColumn("_whole", F.lit(0))
    )
    hashed = F.xxhash64(F.col(value))
    drawn = distinct.groupBy(*group, F.pmod(hashed, F.lit(SLOTS)).alias("_slot")).agg(
        F.min_by(F.col(value), hashed).alias("_splitter"), *[F.sum(n).alias(n) for n in names]
    )
    groups = drawn.groupBy(*group).agg(
        F.array_sort(F.collect_list("_splitter")).alias("_splitters"), *[F.sum(n).alias(n + "_total") for n in names]
    )
    placed = distinct.join(F.broadcast(groups), group).withColumn("_range", range_of(F.col(value), F.col("_splitters")))
    ranges = placed.groupBy(*group, "_range").agg(*[F.sum(n).alias(n) for n in names])
    ranges = ranges.withColumns(before(group, "_range", "_r")).drop(*names)
    rows = placed.drop("_splitters").withColumns(before([*group, "_range"], value, "_v"))
    return rows.join(ranges, [*group, "_range"]).select(
        *keys,
        value,
        *names,
        *[(F.col(n + "_r") + F.col(n + "_v")).alias(n + "_before") for n in names],
        *[n + "_total" for n in names],
    )


def quantile_columns(value: str, probs: dict[str, float], present: Column | None = None) -> list[Column]:
    """Aggregates that read exact quantiles off :func:`running_totals` rows.

    The rows need a measure ``n`` that counts.  ``present`` limits the quantiles
    to some of the rows; those must be whole ``keys`` groups of the totals.
    """
    v, first, past = F.col(value), F.col("n_before"), F.col("n_before") + F.col("n")
    present = F.lit(True) if present is None else present
    out = []
    for name, p in probs.items():
        rank = (F.col("n_total") - 1) * F.lit(float(p))

        def value_at(place: Column) -> Column:
            return F.max(F.when(present & (first <= place) & (place < past), v))

        low, high = value_at(F.floor(rank)), value_at(F.ceil(rank))
        part = F.max(F.when(present, rank - F.floor(rank)))
        out.append((low + part * (high - low)).alias(name))
    return out


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``keys``."""
    totals = running_totals(df, value, {"n": F.lit(1)}, keys)
    return totals.groupBy(*keys).agg(*quantile_columns(value, probs))
