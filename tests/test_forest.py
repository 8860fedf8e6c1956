"""Deep forests: plain trees, and the same forest however rows and nodes are dealt."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from loanloom.operators import forest as FO
from loanloom.operators import models as M


def _rows(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 9, n), rng.standard_normal((n, 3)).round(2)])
    label = ((x[:, 1] + 3 * x[:, 2] + rng.standard_normal(n)) > 4).astype(int)
    return [(int(y), Vectors.dense(v)) for y, v in zip(label, x)]


def _scores(spark, model, rows):
    out = M.score(model, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["loan_id", "label", "features"]))
    assert out.columns == ["loan_id", "label", "score", "prediction"]
    return np.array([r.score for r in out.orderBy("loan_id").collect()])


def test_the_same_however_it_is_dealt(spark, monkeypatch):
    """Nodes split in passes over all rows are those that a task splits."""
    rows = _rows()
    rows += rows[:100]
    frame = spark.createDataFrame(rows, ["label", "features"])
    one = M.forest(frame, trees=7, depth=20)
    assert isinstance(one, FO.Forest)
    monkeypatch.setattr(FO, "LOCAL", 60)
    other = M.forest(frame.repartition(5), trees=7, depth=20)
    assert [len(t.feature) for t in one.trees] == [len(t.feature) for t in other.trees]
    assert max(t.left.max() for t in other.trees) > 10
    assert _scores(spark, one, rows) == pytest.approx(_scores(spark, other, rows))
    assert one.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray())
    assert one.featureImportances.toArray().sum() == pytest.approx(1)
    # what all trees have seen, they tell
    label = np.array([y for y, _ in rows])
    assert ((_scores(spark, one, rows) > 0.5) == label).mean() > 0.9
    fresh = _rows(400, 2)
    assert ((_scores(spark, one, fresh) > 0.5) == np.array([y for y, _ in fresh])).mean() > 0.8


def test_a_whole_tree():
    """With all features at every node and no draws, leaves are as pure as cells allow, and respect the least size and depth."""
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(1, 6, (300, 4)).astype(np.uint8), axis=0)
    label = rng.integers(0, 2, len(cells))
    drawn = rng.integers(1, 4, len(cells))
    nodes, importance, n, ones = FO.grown(cells, label, drawn, 1, 0, FO.Settings(1, 30, 1, 0, 4))
    assert ((nodes.score[nodes.reached(cells)] > 0.5) == label).all() and (n, ones) == (drawn.sum(), (drawn * label).sum())
    assert importance.sum() == pytest.approx(n * 2 * (ones / n) * (1 - ones / n))  # all of the root's impurity
    few, _, _, _ = FO.grown(cells, label, drawn, 1, 0, FO.Settings(1, 30, 25, 0, 4))
    assert np.bincount(few.reached(cells), drawn)[few.feature < 0].min() >= 25
    flat, _, _, _ = FO.grown(cells, label, drawn, 1, 0, FO.Settings(1, 2, 1, 0, 4))
    assert len(flat.feature) <= 7


def test_draws_and_features():
    hashed = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 20_000)
    for m in (1, 3, 200):
        own = FO.draws(hashed, np.full(len(hashed), m), 0, 5)
        assert own.mean() == pytest.approx(m, rel=0.03) and own.var() == pytest.approx(m, rel=0.06)
    tried = FO.features_of(np.arange(1, 4000), 10, 4, 0, 5)
    assert all(len(set(x)) == 4 for x in tried.tolist()) and np.bincount(tried.ravel()).min() > 1400


def test_no_rows_and_one_label(spark):
    frame = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0]))] * 5, ["label", "features"])
    assert _scores(spark, M.forest(frame, trees=3), [(0, Vectors.dense([0.0, 0.0]))]) == pytest.approx([1.0], abs=0.34)
