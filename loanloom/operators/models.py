"""Random forests, scoring, cross-validation and feature importance.

Forests of shallow trees are Spark ML's; deep ones, boosted trees and the net
are in modules of their own.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators import forest as deep
from loanloom.operators import network
from loanloom.operators.curves import average_precision, threshold_counts
from loanloom.operators.features import stratified_folds
from loanloom.session import materialized

#: Spark's trees need a depth limit; this is the largest.
DEEPEST = 30
#: The greatest depth that is left to Spark's learner.
SHALLOW = 10


def forest(
    train: DataFrame, trees: int = 200, depth: int = DEEPEST, min_leaf: int = 1, seed: int = 0
):
    """Random forest on a frame with ``features`` and ``label``."""
    if depth > SHALLOW:
        return deep.fit(train, trees, depth, min_leaf, seed)
    learner = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed
    )
    return learner.fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """Add ``score`` (probability of the positive class) and hard ``prediction``."""
    out = model.transform(df)
    if isinstance(model, deep.Forest):
        return out
    if "probability" in out.columns:
        return (
            out.withColumn("score", vector_to_array("probability")[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("rawPrediction", "probability")
        )
    return out.withColumn("score", F.col("prediction")).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int")
    )


def cross_validate(
    df: DataFrame,
    features: list[str],
    settings: network.Settings = network.Settings(),
    folds: int = 5,
    seed: int = 1234,
    key: str = "loan_id",
) -> DataFrame:
    """Average precision of a net on the training and test part of every stratified fold.

    All folds' nets learn in the same passes over ``df``, and one pass scores them.
    """
    dealt = materialized(stratified_folds(df.filter(F.col("label").isNotNull()), folds, seed=seed, key=key))
    nets = network.fit(dealt, features, settings, key, "fold", folds)
    scored = materialized(network.scores(nets, dealt, "fold", "label")).select("fold", "label", F.posexplode("scores").alias("model", "score"))
    part = F.when(F.col("fold") == F.col("model"), "test").otherwise("train").alias("part")
    counts = threshold_counts(scored.select("model", part, "label", "score"), keys=("model", "part"))
    return average_precision(counts, ("model", "part")).withColumnRenamed("model", "fold")


def importance(spark, model, names: list[str], n: int = 20) -> DataFrame:
    """The ``n`` most important features by gain, with their names."""
    weights = model.featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(names, weights)]
    scores = spark.createDataFrame(rows, "feature string, score double")
    return scores.orderBy(F.desc("score"), "feature").limit(n)
