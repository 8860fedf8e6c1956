"""Feature preparation: indicators, splits, imputation, assembly."""

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators.profile import missing_counts
from loanloom.operators.ranked import running_totals
from loanloom.session import materialized

MAX_LEVELS = 10_000
#: Rows of a partition that a learner keeps, about.
PARTITION_ROWS = 200_000
_HEX_DIGITS = 12


# --- indicators ------------------------------------------------------------


def levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values of categorical columns, from one pass.

    Only these level lists reach the driver; a column with more than
    ``MAX_LEVELS`` of them is not a category and is refused.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    rows = long.distinct().orderBy("column", "value").limit(MAX_LEVELS * len(columns) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    wide = [c for c, v in out.items() if len(v) > MAX_LEVELS]
    if wide or len(rows) > MAX_LEVELS * len(columns):
        raise ValueError(f"too many levels for indicator columns: {wide or columns}")
    return out


def indicator_name(column: str, level: str) -> str:
    return f"{column}_{re.sub(r'[^0-9A-Za-z]+', '_', level)}"


def one_hot(
    df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None, drop_first: bool = True
) -> DataFrame:
    """0/1 columns per level without the first; a missing value has only zeros.

    Pass the levels of the fitting cohort as ``known`` for a later one, whose
    unseen levels then have only zeros too.
    """
    known = known if known is not None else levels(df, columns)
    dummies = [
        F.when(F.col(c).cast("string") == v, 1).otherwise(0).alias(indicator_name(c, v))
        for c in columns
        for v in known[c][1 if drop_first else 0 :]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *dummies)


@dataclass(frozen=True)
class SparseIndicators:
    """A fitted encoder into one sparse 0/1 vector, for columns of any number of levels.

    The first level of each column, missing values and levels that the fitting
    rows lack have only zeros; a column with one level has no place.  ``names``
    tells what each place of the vector stands for.
    """

    columns: tuple[str, ...]
    levels: dict[str, list[str]]  # from the last down to the first
    indexer: object
    coder: object

    @property
    def names(self) -> list[str]:
        return [indicator_name(c, v) for c in self.columns for v in self.levels[c][:-1]]

    def transform(self, df: DataFrame, output: str = "indicators") -> DataFrame:
        """``df`` with the vector."""
        texts = {f"_{k}_text": F.col(c).cast("string") for k, c in enumerate(self.columns)}
        indexed = self.indexer.transform(df.withColumns(texts))
        # unseen and missing values share the place of the first level, which is left out
        last = {f"_{k}_place": F.least(F.col(f"_{k}_place"), F.lit(float(len(self.levels[c]) - 1))) for k, c in enumerate(self.columns)}
        vectors = self.coder.transform(indexed.withColumns(last))
        return (
            VectorAssembler(inputCols=[f"_{k}_vector" for k in range(len(self.columns))], outputCol=output)
            .transform(vectors)
            .select(*df.columns, output)
        )


def sparse_indicators(df: DataFrame, columns: list[str]) -> SparseIndicators:
    """Fits :class:`SparseIndicators`; the levels, one text for each, become part of the model on the driver."""
    seen = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in columns]).first()
    columns = [c for c in columns if seen[c] > 1]
    if not columns:
        raise ValueError("no column has two levels")
    many = range(len(columns))
    texts = df.select(*[F.col(c).cast("string").alias(f"_{k}_text") for k, c in enumerate(columns)])
    # from the last level down, so that the place that is left out is the first level's
    indexer = StringIndexer(
        inputCols=[f"_{k}_text" for k in many], outputCols=[f"_{k}_place" for k in many],
        handleInvalid="keep", stringOrderType="alphabetDesc",
    ).fit(texts)
    found = {c: list(labels) for c, labels in zip(columns, indexer.labelsArray)}
    top = [F.lit(float(len(found[c]) - 1)).alias(f"_{k}_place") for k, c in enumerate(columns)]
    coder = OneHotEncoder(
        inputCols=[f"_{k}_place" for k in many], outputCols=[f"_{k}_vector" for k in many], dropLast=True
    ).fit(df.sparkSession.range(1).select(*top))
    return SparseIndicators(tuple(columns), found, indexer, coder)


def complete_text_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Text columns without missing values, and all columns with some."""
    nulls = {r["column"]: r["nulls"] for r in missing_counts(df).collect()}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return [c for c in texts if not nulls[c]], [c for c in df.columns if nulls[c]]


def one_hot_complete(df: DataFrame) -> DataFrame:
    """Indicators for text columns without missing values; the others stay."""
    complete, gappy = complete_text_columns(df)
    coded = one_hot(df, complete)
    return coded.select(*[c for c in coded.columns if c not in gappy], *gappy)


# --- splits ----------------------------------------------------------------


def hash_fraction(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) from a row's id, whatever its partition."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double") / float(16**_HEX_DIGITS)


def random_split(
    df: DataFrame, test_share: float, seed: int = 0, key: str = "loan_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash of the row's id."""
    test = hash_fraction(F.col(key), seed) < test_share
    return df.filter(~test), df.filter(test)


def stratified_test_flag(
    df: DataFrame, test_share: float, label: str = "label", seed: int = 0, key: str = "loan_id"
) -> DataFrame:
    """Add ``is_test``: the same share of every class, by lowest hash of the id."""
    hashed = df.withColumn("draw", hash_fraction(F.col(key), seed))
    ranked = running_totals(hashed, "draw", {"n": F.lit(1)}, (label,))
    wanted = F.round(F.col("n_total") * test_share)
    limits = ranked.groupBy(label).agg(
        F.max(F.when(F.col("n_before") < wanted, F.col("draw"))).alias("draw_limit")
    )
    # One limit per class.
    flagged = hashed.join(F.broadcast(limits), label, "left")  # rows without a label stay, untested
    return flagged.withColumn(
        "is_test", F.coalesce(F.col("draw") <= F.col("draw_limit"), F.lit(False))
    ).drop("draw", "draw_limit")


def stratified_folds(
    df: DataFrame, folds: int = 5, label: str = "label", seed: int = 0, key: str = "loan_id"
) -> DataFrame:
    """Add ``fold``: each class dealt out in the order of a hash of the id, so counts differ by one at most.

    Ranks come from running totals, not from a window over a class.  Rows that
    share id and label share a fold; rows without a label have none.
    """
    hashed = df.withColumn("draw", hash_fraction(F.col(key), seed))
    ranked = running_totals(hashed, "draw", {"n": F.lit(1)}, (label,))
    dealt = ranked.select(label, "draw", (F.col("n_before") % folds).cast("int").alias("fold"))
    return hashed.join(dealt, [label, "draw"], "left").select(*df.columns, "fold")


def stratified_split(
    df: DataFrame, test_share: float, label: str = "label", seed: int = 0, key: str = "loan_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with equal class shares."""
    flagged = stratified_test_flag(df, test_share, label, seed, key)
    train = flagged.filter(~F.col("is_test")).drop("is_test")
    return train, flagged.filter("is_test").drop("is_test")


# --- assembly and imputation -----------------------------------------------


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """A feature vector; rows must be complete in ``columns``."""
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="error").transform(df)


def median_fill(df: DataFrame, columns: list[str], medians: dict[str, float]) -> DataFrame:
    """Fill numeric gaps with given medians and flag them in ``<column>_missing``."""
    out = df.withColumns({c + "_missing": F.col(c).isNull().cast("int") for c in columns})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns})


def in_small_parts(df: DataFrame) -> DataFrame:
    """``df`` written once, in partitions that grow in number and not in size; a small table stays as it is.

    A forest keeps the partitions of its rows and reads each whole, in one task.
    """
    parts = -(-df.count() // PARTITION_ROWS)
    if parts < 2:
        return df
    return materialized(df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)))


def impute(
    df: DataFrame,
    columns: list[str],
    predictors: list[str],
    seed: int = 0,
    trees: int = 10,
    depth: int = 3,
) -> DataFrame:
    """Fill each column's gaps with a forest fitted on its present values.

    Predictors are the columns without gaps, the same for every target; numbers
    are regressed, text is classified.  Keep the label out of ``predictors``.
    """
    original = df.columns
    out = VectorAssembler(inputCols=predictors, outputCol="impute_features").transform(df)
    for c in columns:
        known = out.filter(F.col(c).isNotNull())
        options = dict(featuresCol="impute_features", numTrees=trees, maxDepth=depth, seed=seed)
        if isinstance(df.schema[c].dataType, T.StringType):
            indexer = StringIndexer(inputCol=c, outputCol="impute_label", stringOrderType="alphabetAsc")
            indexer = indexer.fit(known)
            forest = RandomForestClassifier(
                labelCol="impute_label", predictionCol="impute_index", **options
            ).setProbabilityCol("").setRawPredictionCol("")
            model = forest.fit(indexer.transform(known))
            back = IndexToString(
                inputCol="impute_index", outputCol="impute_value", labels=indexer.labels
            )
            scored = back.transform(model.transform(out)).drop("impute_index")
        else:
            forest = RandomForestRegressor(labelCol=c, predictionCol="impute_value", **options)
            scored = forest.fit(known).transform(out)
        out = scored.withColumn(c, F.coalesce(F.col(c), F.col("impute_value"))).drop("impute_value")
    return out.select(*original)
