"""Feature preparation, evaluation and models."""

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.boosting_sql import boosted, draw
from checks.registry import acq, closing_codes, labelled_rows, oracle, r, register, tidy
from loanloom import schema
from loanloom.functions import loan as L
from loanloom.operators import boosting as BOOST
from loanloom.operators import curves as C
from loanloom.operators import evaluate as E
from loanloom.operators import features as X
from loanloom.operators import models as M
from loanloom.operators import neighbors as N
from loanloom.operators import network as NET
from loanloom.plans.default_model import learn_preparation
from loanloom.session import materialized

# --- evaluation of a fixed score ---------------------------------------------

_SCORED = """SELECT loan_id, label, score, CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM
  (SELECT loan_id, label, round((900 - coalesce(cscore_mn, 700)) / 400, 4) AS score FROM labelled WHERE label IS NOT NULL)"""
_CONFUSION = """SELECT sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp FROM scored"""


def scored(spark, d):
    df = closing_codes(spark, d).select(
        "loan_id",
        L.default_label(F.col("zero_bal_code"), F.col("disp_dt")).alias("label"),
        L.lowest_score_borrower_first(F.col("cscore_b"), F.col("cscore_c")).alias("cscore_mn"),
    )
    score = F.round((900 - F.coalesce("cscore_mn", F.lit(700.0))) / 400, 4)
    known = df.filter(F.col("label").isNotNull()).select("loan_id", "label", score.alias("score"))
    return known.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def _evaluated(final: str, score: str = "score", **more: str) -> str:
    counts = f"""SELECT threshold, pos, neg, positives, negatives,
      sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM
      (SELECT CAST({score} AS DOUBLE) AS threshold, sum(label) AS pos, sum(1 - label) AS neg,
         (SELECT sum(label) FROM scored) AS positives, (SELECT sum(1 - label) FROM scored) AS negatives FROM scored GROUP BY 1)"""
    return oracle(final, "labelled", extra={"scored": _SCORED, "conf": _CONFUSION, "counts": counts, **more})


def _counts(spark, d, score="score"):
    df = scored(spark, d)
    return C.threshold_counts(df.withColumn(score, F.col(score).cast("double")), "label", score)


@register(
    "confusion_counts",
    _evaluated("SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM conf"),
)
def confusion_counts(spark, d):
    return E.confusion_counts(scored(spark, d))


@register(
    "confusion_shares",
    _evaluated(
        """SELECT 0 AS predicted, 0 AS "true", round(tn / (tn + fp), 6) AS share FROM conf
        UNION ALL SELECT 1, 0, round(fp / (tn + fp), 6) FROM conf
        UNION ALL SELECT 0, 1, round(fn / (fn + tp), 6) FROM conf
        UNION ALL SELECT 1, 1, round(tp / (fn + tp), 6) FROM conf"""
    ),
)
def confusion_shares(spark, d):
    return tidy(E.confusion_shares(E.confusion_counts(scored(spark, d))))


@register(
    "classification_report",
    _evaluated(
        f"""SELECT class, {r('precision', 'recall', 'f1')}, CAST(support AS BIGINT) AS support FROM
        (SELECT * FROM classes UNION ALL SELECT 'avg / total', sum(precision * support) / sum(support),
           sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM classes)""",
        classes="""SELECT class, precision, recall, 2 * precision * recall / (precision + recall) AS f1, support FROM
          (SELECT '0' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, tn + fp AS support FROM conf
           UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM conf)""",
    ),
)
def classification_report(spark, d):
    return tidy(E.classification_report(E.confusion_counts(scored(spark, d))))


@register("accuracy", _evaluated("SELECT round((tn + tp) / (tn + fp + fn + tp), 6) + 0.0e0 AS accuracy FROM conf"))
def accuracy(spark, d):
    return tidy(E.accuracy(E.confusion_counts(scored(spark, d))))


@register(
    "roc_curve",
    _evaluated("SELECT threshold, round(fp / negatives, 6) + 0.0e0 AS fpr, round(tp / positives, 6) + 0.0e0 AS tpr FROM counts"),
)
def roc_curve(spark, d):
    return tidy(C.roc_points(_counts(spark, d)))


_AREA = "SELECT round(sum(neg * (2 * tp - pos) / 2) / (max(positives) * max(negatives)), 6) + 0.0e0 AS roc_auc FROM counts"


@register("roc_auc", _evaluated(_AREA))
def roc_auc(spark, d):
    return tidy(C.roc_area(_counts(spark, d)))


@register("roc_auc_of_prediction", _evaluated(_AREA, "prediction"))
def roc_auc_of_prediction(spark, d):
    return tidy(C.roc_area(_counts(spark, d, "prediction")))


@register(
    "precision_recall_curve",
    _evaluated(
        """SELECT threshold, round(tp / (tp + fp), 6) + 0.0e0 AS precision, round(tp / positives, 6) + 0.0e0 AS recall
        FROM counts WHERE tp - pos < positives"""
    ),
)
def precision_recall_curve(spark, d):
    return tidy(C.precision_recall_points(_counts(spark, d)))


@register(
    "precision_recall_auc",
    _evaluated(
        """SELECT round(sum((recall - recall0) * (precision + precision0) / 2), 6) + 0.0e0 AS pr_auc FROM
        (SELECT tp / positives AS recall, tp / (tp + fp) AS precision,
           coalesce(lag(tp / positives) OVER (ORDER BY threshold DESC), 0) AS recall0,
           coalesce(lag(tp / (tp + fp)) OVER (ORDER BY threshold DESC), 1) AS precision0 FROM counts)"""
    ),
)
def precision_recall_auc(spark, d):
    return tidy(C.precision_recall_area(_counts(spark, d)))


_AP = "SELECT round(sum(pos * tp / (tp + fp)) / max(positives), 6) + 0.0e0 AS average_precision FROM counts"


@register("average_precision", _evaluated(_AP))
def average_precision(spark, d):
    return tidy(C.average_precision(_counts(spark, d)))


@register("average_precision_of_prediction", _evaluated(_AP, "prediction"))
def average_precision_of_prediction(spark, d):
    return tidy(C.average_precision(_counts(spark, d, "prediction")))


# --- feature preparation -----------------------------------------------------

_CODED = {
    "orig_chn": ["C", "R"],
    "num_bo": ["2"],
    "fthb_flg": ["Y"],
    "purpose": ["P", "R"],
    "num_unit": ["2", "3", "4"],
    "prop_typ": ["PU", "SF"],
    "relocation_flg": ["Y"],
    "occ_stat": ["P", "S"],
}


def _dummies(columns, source: str) -> str:
    cells = [
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {X.indicator_name(c, v)}" for c in columns for v in _CODED[c]
    ]
    return f"{', '.join(cells)} FROM {source}"


@register("indicator_columns", oracle(f"SELECT loan_id, {_dummies(_CODED, 'acq')}", "acq"))
def indicator_columns(spark, d):
    return X.one_hot(acq(spark, d).select("loan_id", *_CODED), list(_CODED))


@register(
    "indicator_totals",
    oracle(
        " UNION ALL ".join(
            f"""SELECT '{c}_' || regexp_replace(v, '[^0-9A-Za-z]+', '_', 'g') AS feature, n FROM
            (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY {c}) AS place FROM located WHERE {c} IS NOT NULL GROUP BY 1) WHERE place > 1"""
            for c in ("state", "seller_name", *_CODED)
        ),
        "located",
    ),
)
def indicator_totals(spark, d):
    columns = ["state", "seller_name", *_CODED]
    coded = X.one_hot(labelled_rows(spark, d).select(*columns), columns)
    sums = coded.agg(*[F.sum(c).alias(c) for c in coded.columns])
    return sums.unpivot([], coded.columns, "feature", "n")


_SPARSE = ["zip_3", "state", "seller_name", *_CODED]


@register(
    "sparse_indicators",
    oracle(
        "SELECT loan_id, string_agg(name, ',' ORDER BY name) AS ones, CAST(max(places) AS BIGINT) AS places FROM (SELECT a.loan_id, f.name, "
        "(SELECT count(*) FROM feature) AS places FROM acq a LEFT JOIN cell c ON a.loan_id = c.loan_id LEFT JOIN feature f ON c.col = f.col AND c.v = f.v) GROUP BY 1",
        "acq",
        extra={
            "cell": " UNION ALL ".join(f"SELECT loan_id, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM acq WHERE {c} IS NOT NULL" for c in _SPARSE),
            "feature": """SELECT col, v, col || '_' || regexp_replace(v, '[^0-9A-Za-z]+', '_', 'g') AS name FROM
                (SELECT DISTINCT col, v FROM cell) QUALIFY row_number() OVER (PARTITION BY col ORDER BY v) > 1""",
        },
        stored=True,
    ),
)
def sparse_indicators(spark, d):
    df = acq(spark, d).select("loan_id", *_SPARSE)
    model = X.sparse_indicators(df, _SPARSE)
    names = F.array(*[F.lit(n) for n in model.names])
    ones = F.filter(F.transform(vector_to_array("indicators"), lambda x, k: F.when(x == 1, F.get(names, k))), lambda x: x.isNotNull())
    joined = F.array_join(F.array_sort(ones), ",")
    return model.transform(df).select(
        "loan_id", F.when(F.size(ones) > 0, joined).alias("ones"), F.lit(len(model.names)).cast("long").alias("places")
    )


#: Texts of the acquisitions that are no categories: ids and dates, which become numbers.
_NO_CATEGORIES = ["loan_id", "orig_dte", "frst_dte"]
_MAYBE = [f.name for f in schema.ACQUISITION.fields if isinstance(f.dataType, T.StringType) and f.name not in _NO_CATEGORIES]


@register(
    "indicators_of_complete_columns",
    oracle(
        """SELECT col || '_' || regexp_replace(v, '[^0-9A-Za-z]+', '_', 'g') AS feature, n FROM level WHERE col IN (SELECT col FROM full_column)
        QUALIFY row_number() OVER (PARTITION BY col ORDER BY v) > 1
        UNION ALL SELECT 'gaps of ' || col, (SELECT count(*) FROM acq) - sum(n) FROM level WHERE col NOT IN (SELECT col FROM full_column) GROUP BY 1""",
        "acq",
        extra={
            "level": " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM acq WHERE {c} IS NOT NULL GROUP BY 2" for c in _MAYBE),
            "full_column": "SELECT col FROM level GROUP BY 1 HAVING sum(n) = (SELECT count(*) FROM acq)",
        },
    ),
)
def indicators_of_complete_columns(spark, d):
    """Every text column without gaps as indicators, summed; of the others, how many rows lack them."""
    texts = acq(spark, d).select(*_MAYBE)
    coded = X.one_hot_complete(texts)
    sums = coded.agg(*[(F.count_if(F.col(c).isNull()) if c in _MAYBE else F.sum(c)).alias(f"gaps of {c}" if c in _MAYBE else c) for c in coded.columns])
    return sums.unpivot([], sums.columns, "feature", "n")


@register(
    "random_split",
    oracle(f"SELECT loan_id, CASE WHEN {draw(0)} < 0.2e0 THEN 'test' ELSE 'train' END AS part FROM acq", "acq"),
)
def random_split(spark, d):
    train, test = X.random_split(acq(spark, d).select("loan_id"), 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register(
    "stratified_split",
    oracle(
        f"""SELECT loan_id, label, row_number() OVER (PARTITION BY label ORDER BY draw) <= round(count(*) OVER (PARTITION BY label) * 0.25e0) AS is_test
        FROM (SELECT loan_id, label, {draw(0)} AS draw FROM labelled WHERE label IS NOT NULL)""",
        "labelled",
    ),
)
def stratified_split(spark, d):
    df = scored(spark, d).select("loan_id", "label")
    return X.stratified_test_flag(df, 0.25).select("loan_id", "label", "is_test")


# --- models ------------------------------------------------------------------


@lru_cache(maxsize=4)
def _parts(spark, d):
    """(preparation learnt from the training part, training rows, test rows) of the labelled loans."""
    # the panel is read once, as the split reads its rows several times
    flagged = materialized(X.stratified_test_flag(materialized(labelled_rows(spark, d)), 0.25))
    train, test = flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter("is_test").drop("is_test")
    return learn_preparation(train), train, test


@lru_cache(maxsize=4)
def _complete_train(spark, d):
    """Training rows without gaps."""
    prep, train, _ = _parts(spark, d)
    return materialized(prep.apply(train))


@lru_cache(maxsize=4)
def _complete(spark, d):
    """Training and test rows without gaps."""
    prep, _, test = _parts(spark, d)
    return _complete_train(spark, d), materialized(prep.apply(test))


def _report(scored):
    return E.confusion_counts(scored)


@register(
    "stratified_folds",
    oracle(
        f"""SELECT loan_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY draw) - 1) % 5 AS INTEGER) AS fold
        FROM (SELECT loan_id, label, {draw(1234)} AS draw FROM labelled WHERE label IS NOT NULL)""",
        "labelled",
    ),
)
def stratified_folds(spark, d):
    return X.stratified_folds(scored(spark, d).select("loan_id", "label"), 5, seed=1234)


_COMPLETE = f"""SELECT p.loan_id, p.label, f.k, CASE WHEN f.of IS NULL THEN coalesce(l.x, m.median) ELSE l.x END AS x
  FROM parted p JOIN long l ON p.loan_id = l.loan_id JOIN feature f ON l.k = f.k
  LEFT JOIN (SELECT k, quantile_cont(x, 0.5) AS median FROM long WHERE part = 'train' GROUP BY 1) m ON f.k = m.k"""


@register(
    "assembled_features",
    boosted(
        f"""SELECT loan_id, label, round(sum(x), 4) + 0.0e0 AS total, round(sum(x * (k + 1)), 4) + 0.0e0 AS weighted, CAST(count(*) AS BIGINT) AS n
        FROM ({_COMPLETE}) GROUP BY 1, 2""",
        BOOST.CLASSIFIER,
        1,
        depth=1,
    ),
)
def assembled_features(spark, d):
    """Sums over each assembled vector (without the flags of missing values), which tell whether every feature is in its place."""
    prep, train, test = _parts(spark, d)
    names = prep.open_names
    vectors = X.assemble(prep.apply(train).unionByName(prep.apply(test)), names)
    rows = vectors.select("loan_id", "label", vector_to_array("features").alias("v"))
    add = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda a, x: a + x)
    out = rows.select(
        "loan_id", "label", add(lambda x: x).alias("total"), add(lambda x, k: x * (k + 1)).alias("weighted"), F.size("v").cast("long").alias("n")
    )
    return tidy(out, places=4)


#: Columns of the acquisitions with gaps, and those without that are numbers.
_GAPS = ["ocltv", "dti", "cscore_b", "num_bo", "mi_pct", "cscore_c", "mi_type"]
_PREDICTORS = ["orig_rt", "orig_amt", "orig_trm", "oltv"]
_CODES = ["orig_chn", "fthb_flg", "purpose", "prop_typ", "num_unit", "occ_stat", "state", "relocation_flg", "seller_name"]


@register("imputed_columns")
def imputed_columns(spark, d):
    """Every column with gaps, filled from every column without, texts as indicators."""
    coded = X.one_hot(X.in_small_parts(acq(spark, d).select("loan_id", *_PREDICTORS, *_CODES, *_GAPS)), _CODES)
    predictors = [c for c in coded.columns if c not in ("loan_id", *_GAPS)]
    return X.impute(coded, _GAPS, predictors).select("loan_id", *_PREDICTORS, *_GAPS)


@register("smote_oversampling")
def smote_oversampling(spark, d):
    return N.smote(_complete(spark, d)[0], _parts(spark, d)[0].feature_names)


@register("edited_nearest_neighbors")
def edited_nearest_neighbors(spark, d):
    return N.edited_nearest_neighbors(_complete(spark, d)[0], _parts(spark, d)[0].feature_names)


def _resampled(spark, d):
    return N.smote_enn(_complete(spark, d)[0], _parts(spark, d)[0].feature_names)


@register("smote_enn_resampling")
def smote_enn_resampling(spark, d):
    return _resampled(spark, d)


@register("nearest_neighbor_classifier")
def nearest_neighbor_classifier(spark, d):
    train, test = _complete(spark, d)
    return N.knn_scores(train, test, _parts(spark, d)[0].feature_names).select("loan_id", "label", "score", "prediction")


def _forest(spark, d, **options):
    """A forest of the resampled training part, on the test part as it is."""
    names = _parts(spark, d)[0].feature_names
    train = materialized(_resampled(spark, d).select("label", *names))
    model = M.forest(X.assemble(train, names).select("label", "features"), **options)
    return _report(M.score(model, X.assemble(_complete(spark, d)[1], names)))


@register("random_forest")
def random_forest(spark, d):
    return _forest(spark, d)


@register("random_forest_depth_5")
def random_forest_depth_5(spark, d):
    return _forest(spark, d, depth=5, min_leaf=5)


@register("random_forest_depth_6")
def random_forest_depth_6(spark, d):
    return _forest(spark, d, depth=6)


#: Rounds that the statements spell out: more than any fit on the driver's tables takes.
_SPELT = 12
_CONFUSED = """SELECT CAST(sum(CASE WHEN label = 0 AND score <= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label = 0 AND score > 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND score <= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND score > 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM kept WHERE part = 'test'"""


@lru_cache(maxsize=8)
def _boosted(spark, d, settings):
    prep, train, test = _parts(spark, d)
    return BOOST.fit(prep.frame(train), prep.frame(test), prep.open_names, settings)


@register(
    "boosted_split_gains",
    boosted(
        """SELECT f.name AS feature, CAST(cell AS BIGINT) AS cell, missing_left, round(gain, 6) + 0.0e0 AS gain
        FROM w0_0 w JOIN feature f ON w.k = f.k""",
        BOOST.CLASSIFIER,
        1,
        depth=1,
    ),
)
def boosted_split_gains(spark, d):
    """Every split of the first tree's root, with missing values on either side."""
    prep, train, _ = _parts(spark, d)
    names, s = prep.open_names, BOOST.CLASSIFIER
    starts = BOOST.learn_cells(prep.frame(train), names)
    rows = BOOST.placed(prep.frame(train), starts, "loan_id", "label", F.lit(0.0).alias("margin"))
    sample = rows.filter(X.hash_fraction(F.col("loan_id"), s.seed) < s.rows)
    columns = BOOST.sampled_columns(names, s.columns, s.seed)
    gains = BOOST.split_gains(BOOST.level_sums(sample, s, len(names), [], BOOST.Tree(), [1], columns), s)
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("feature").cast("int"))
    return tidy(gains.select(named.alias("feature"), "cell", "missing_left", "gain"))


@register(
    "boosted_rounds",
    boosted(
        "SELECT round, round(pr_auc, 6) + 0.0e0 AS pr_auc, round <= (SELECT best FROM stop) AS kept FROM area WHERE round <= (SELECT last FROM stop)",
        BOOST.CLASSIFIER,
        _SPELT,
    ),
)
def boosted_rounds(spark, d):
    """The area after every round, and which rounds the fit keeps."""
    return tidy(_boosted(spark, d, BOOST.CLASSIFIER).rounds(spark))


@register("boosted_classifier", boosted(_CONFUSED, BOOST.CLASSIFIER, _SPELT))
def boosted_classifier(spark, d):
    return _report(_boosted(spark, d, BOOST.CLASSIFIER).transform(_parts(spark, d)[0].frame(_parts(spark, d)[2])))


@register("patient_boosted_classifier")
def patient_boosted_classifier(spark, d):
    """The classifier of at most 100 rounds that waits 30 for a better area."""
    prep, _, test = _parts(spark, d)
    return _report(_boosted(spark, d, BOOST.PATIENT_CLASSIFIER).transform(prep.frame(test)))


@register("boosted_regression")
def boosted_regression(spark, d):
    prep, _, test = _parts(spark, d)
    return _report(_boosted(spark, d, BOOST.REGRESSION).transform(prep.frame(test)))


@register(
    "boosted_nodes",
    boosted(
        """SELECT tree, node, f.name AS feature, missing_left, round(gain, 5) + 0.0e0 AS gain, round(cover, 5) + 0.0e0 AS cover,
        round(t.start, 6) + 0.0e0 AS last_cell_from FROM split s JOIN feature f ON s.k = f.k
        JOIN starts t ON s.k = t.k AND s.cell = t.cell WHERE tree <= (SELECT best FROM stop)""",
        BOOST.CLASSIFIER,
        _SPELT,
    ),
)
def boosted_nodes(spark, d):
    """The kept trees as a table."""
    nodes = tidy(_boosted(spark, d, BOOST.CLASSIFIER).nodes(spark))
    return nodes.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("gain", "cover")})


@register(
    "feature_importance",
    boosted(
        """SELECT f.name AS feature, count(*) AS splits FROM split s JOIN feature f ON s.k = f.k WHERE tree <= (SELECT best FROM stop)
        GROUP BY 1 ORDER BY splits DESC, feature LIMIT 20""",
        BOOST.CLASSIFIER,
        _SPELT,
    ),
)
def feature_importance(spark, d):
    """How often the kept trees split on a feature, the 20 most frequent."""
    return _boosted(spark, d, BOOST.CLASSIFIER).split_counts(spark)


@register("neural_net")
def neural_net(spark, d):
    train, test = _complete(spark, d)
    return _report(NET.fit(train, _parts(spark, d)[0].feature_names)[0].transform(test))


@register("cross_validation")
def cross_validation(spark, d):
    return M.cross_validate(_complete_train(spark, d), _parts(spark, d)[0].feature_names)


_EARLY = "1997"


@register(
    "scored_later_cohort",
    boosted(
        "SELECT loan_id, label, round(score, 6) + 0.0e0 AS score, CASE WHEN score > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM kept WHERE part = 'late'",
        BOOST.CLASSIFIER,
        _SPELT,
        known=f"orig_year <= '{_EARLY}'",
    ),
)
def scored_later_cohort(spark, d):
    """Fit on vintages up to 1997, score the later ones with the same preparation."""
    vintage = acq(spark, d).select("loan_id", F.substring("orig_dte", 4, 4).alias("year"))
    rows = materialized(labelled_rows(spark, d).join(vintage, "loan_id"))
    early = rows.filter(F.col("year") <= _EARLY).drop("year")
    late = rows.filter(F.col("year") > _EARLY).drop("year")
    flagged = materialized(X.stratified_test_flag(early, 0.25))
    train, test = flagged.filter(~F.col("is_test")), flagged.filter("is_test")
    prep = learn_preparation(train)
    model = BOOST.fit(prep.frame(train), prep.frame(test), prep.open_names)
    return tidy(model.transform(prep.frame(late)).select("loan_id", "label", "score", "prediction"))
