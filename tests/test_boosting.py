"""Boosted trees, the tanh net and stratified folds on tables with a known signal."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import boosting as B
from loanloom.operators import network as N
from loanloom.operators.curves import average_precision, precision_recall_area, threshold_counts
from loanloom.operators.features import stratified_folds
from loanloom.operators.models import cross_validate


def _table(spark, n=1500, seed=0):
    """Label by a threshold of ``x`` and by gaps of ``gap``; ``noise`` says nothing."""
    rng = np.random.default_rng(seed)
    x, noise, gap = rng.normal(size=n), rng.normal(size=n), rng.random(n) < 0.3
    label = ((x > 0.7) | gap) ^ (rng.random(n) < 0.05)
    rows = [(f"{i}", int(y), float(a), float(b), None if g else 1.0) for i, (y, a, b, g) in enumerate(zip(label, x, noise, gap))]
    return spark.createDataFrame(rows, "loan_id string, label int, x double, noise double, gap double").repartition(5)


FEATURES = ["x", "noise", "gap"]


@pytest.fixture(scope="module")
def parts(spark):
    df = _table(spark).cache()
    return df.filter(F.col("loan_id").cast("int") % 4 > 0), df.filter(F.col("loan_id").cast("int") % 4 == 0)


@pytest.fixture(scope="module")
def fitted(parts):
    return B.fit(*parts, FEATURES, replace(B.CLASSIFIER, rounds=12, depth=3, rows=1.0, columns=1.0, positive_weight=1.0))


def test_signal_is_found(spark, parts, fitted):
    scored = fitted.transform(parts[1])
    assert scored.columns == [*parts[1].columns, "score", "prediction"]
    base = parts[1].agg(F.avg("label")).first()[0]
    assert average_precision(threshold_counts(scored)).first()[0] > base + 0.3
    right = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    assert right > 0.9
    counts = {r.feature: r.splits for r in fitted.split_counts(spark).collect()}
    assert {"x", "gap"} <= set(counts) and sum(counts.values()) == fitted.nodes(spark).count()


def test_gap_alone_is_a_signal(spark, parts):
    """Nothing but a missing value tells the classes apart."""
    rows = spark.createDataFrame([(str(i), int(i % 3 == 0), None if i % 3 == 0 else float(i)) for i in range(300)], "loan_id string, label int, v double")
    one = B.fit(rows, rows, ["v"], replace(B.CLASSIFIER, rounds=2, depth=1, rows=1.0, columns=1.0, least_weight=1.0))
    root = one.trees[0].splits[1]
    assert (root[1], root[2]) == (len(one.starts["v"]), False)  # all known values left, missing right
    assert precision_recall_area(threshold_counts(one.transform(rows))).first()[0] == 1.0


def test_sums_of_both_ways_and_of_plain_python(spark, parts, monkeypatch):
    """Products by node, keys, and sums that are handed on at once all agree with plain sums; rows lie in several batches."""
    train, s = parts[0], replace(B.CLASSIFIER, rows=1.0, columns=1.0)
    starts = B.learn_cells(train, FEATURES, 16)
    cells_of = [len(starts[f]) for f in FEATURES]
    assert cells_of == [16, 16, 1]
    rows = B.placed(train, starts, "loan_id", "label", F.lit(0.0).alias("margin")).cache()
    tree = B.Tree({1: (0, 8, True, 0.0, 0.0)}, {2: 0.1, 3: -0.1})
    want = {}
    for r in rows.collect():
        node = 2 if r.cells[0] <= 8 else 3
        w = 4.5 if r.label else 1.0
        for f, c in enumerate(r.cells):
            g, h = want.get((node, f, c), (0, 0))
            want[node, f, c] = (g + round((0.5 - r.label) * w * B.UNIT), h + round(0.25 * w * B.UNIT))
    def found(**more):
        return {(r.node, r.feature, r.cell): (r.g, r.h) for r in B.level_sums(rows, s, 3, [], tree, [2, 3], [0, 1, 2], **more).collect()}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert found() == found(cells_of=cells_of) == want
        monkeypatch.setattr(B, "FEW", 1)
        assert found(cells_of=cells_of) == want
        monkeypatch.setattr(B, "HELD", 1)
        assert found(cells_of=cells_of) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_tree_draws_its_rows_once(spark, parts, monkeypatch):
    """The levels read rows whose margins are complete: no pass over them applies earlier trees again."""
    passes, sums = [], B.level_sums
    monkeypatch.setattr(B, "level_sums", lambda rows, s, width, trees, *more: passes.append(len(trees)) or sums(rows, s, width, trees, *more))
    settings = replace(B.CLASSIFIER, rounds=7, depth=2, patience=7)
    assert len(B.fit(*parts, FEATURES, settings).trees) == 7 and passes and set(passes) == {0}


def test_gains_against_every_split(spark, parts):
    train, _ = parts
    s = replace(B.CLASSIFIER, rows=1.0, columns=1.0)
    starts = B.learn_cells(train, FEATURES, 16)
    rows = B.placed(train, starts, "loan_id", "label", F.lit(0.0).alias("margin"))
    gains = B.split_gains(B.level_sums(rows, s, 3, [], B.Tree(), [1], [0, 1, 2]), s).collect()
    data = train.collect()
    weight = np.array([4.5 if r.label else 1.0 for r in data])
    g, h = np.rint((0.5 - np.array([r.label for r in data])) * weight * B.UNIT), np.rint(0.25 * weight * B.UNIT)
    seen = 0
    for r in gains:
        name = FEATURES[r.feature]
        edges = starts[name] + [np.inf]
        v = np.array([np.nan if q[name] is None else q[name] for q in data])
        left = np.where(np.isnan(v), r.missing_left, v < edges[r.cell])
        assert (r.gl, r.hl) == (g[left].sum(), h[left].sum())
        strength = lambda m: (g[m].sum() / B.UNIT) ** 2 / (h[m].sum() / B.UNIT + s.penalty)  # noqa: B023, E731
        assert r.gain == pytest.approx(strength(left) + strength(~left) - strength(np.ones(len(g), bool)))
        seen += 1
    assert seen > 30


def test_layout_changes_nothing(parts, fitted):
    again = B.fit(parts[0].repartition(2), parts[1].coalesce(1), FEATURES, fitted.settings)
    assert again.areas == fitted.areas and [t.splits for t in again.trees] == [t.splits for t in fitted.trees]


def test_patience():
    assert B.kept_rounds([0.1, 0.3, 0.2, 0.2], 5) is None
    assert B.kept_rounds([0.1, 0.3, 0.2, 0.3, 0.2, 0.2, 0.1], 5) == 2
    assert B.kept_rounds([0.3] * 6, 5) == 1


def test_prefix_areas_are_those_of_each_prefix(parts, fitted):
    for k in (1, 4, len(fitted.areas)):
        scored = fitted.transform(parts[1], trees=k)
        assert precision_recall_area(threshold_counts(scored)).first()[0] == pytest.approx(fitted.areas[k - 1])


def test_deep_squared_trees_and_odd_rows(spark, parts):
    s = replace(B.REGRESSION, rounds=2, depth=12)
    model = B.fit(*parts, FEATURES, s)
    assert max(max(t.splits, default=0) for t in model.trees) > 64
    later = spark.createDataFrame([("a", None, None, None), ("b", 1e9, -1e9, 5.0)], "loan_id string, x double, noise double, gap double")
    assert model.transform(later).filter("score IS NULL").count() == 0
    empty = B.fit(parts[0].limit(0), parts[1].limit(0), FEATURES, replace(s, rounds=1))
    assert empty.trees[0].splits == {} and empty.transform(later).count() == 2


def test_net_beats_a_constant(parts):
    train, test = parts
    net = N.fit(train, FEATURES)[0]
    scored = net.transform(test)
    base = test.agg(F.avg("label")).first()[0]
    assert average_precision(threshold_counts(scored)).first()[0] > base + 0.2
    assert scored.select("prediction").distinct().count() == 2


def test_net_gradient():
    rng = np.random.default_rng(1)
    sizes = N.shapes(3, (4, 4))
    flat, x, y = N.initial(sizes, 3), rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    _, g = N.gradient(flat, sizes, x, y, 0.1)
    for k in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (N.gradient(flat + d, sizes, x, y, 0.1)[0] for d in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_net_of_several_shards(parts, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 300)
    train, test = parts
    nets = [N.fit(x, FEATURES, N.Settings(epochs=60))[0] for x in (train, train.repartition(3))]
    assert np.allclose(nets[0].flat, nets[1].flat)
    base = test.agg(F.avg("label")).first()[0]
    assert average_precision(threshold_counts(nets[0].transform(test))).first()[0] > base + 0.1


def test_each_shard_is_a_partition(parts, monkeypatch):
    kept = []
    monkeypatch.setattr(N, "SHARD", 60)
    monkeypatch.setattr(N, "materialized", lambda df: kept.append(df) or df)
    N.fit(parts[0], FEATURES, N.Settings(hidden=(2,), epochs=1))
    shards = -(-parts[0].count() // 60)
    dealt = kept[0].select("shard", F.spark_partition_id().alias("part")).distinct().collect()
    assert shards > 10 and len(dealt) == len({r.shard for r in dealt}) == len({r.part for r in dealt}) == shards


def test_nets_learn_together_as_alone():
    rng = np.random.default_rng(4)
    sizes, s = N.shapes(3, (4, 4)), N.Settings(batch=20, penalty=0.1)
    x, y = rng.normal(size=(107, 3)), rng.integers(0, 2, 107).astype(float)
    rows = [np.arange(107), np.arange(5, 88), np.arange(0, 107, 9)]  # one net has no whole batch
    states = np.stack([np.stack([N.initial(sizes, k), *np.zeros((2, len(N.initial(sizes, k))))]) for k in range(3)])
    together, losses = N._epochs(states, [0, 7, 0], sizes, x, y, rows, s, 3, (1, 2))
    for own, before, at, found, loss in zip(states, (0, 7, 0), rows, together, losses):
        flat, m, v = own.copy()
        draws, step = np.random.default_rng((1, 2)), before
        for _ in range(3):
            order, total = at[draws.permutation(len(at))], 0.0
            for low in range(0, len(at), s.batch):
                b = order[low : low + s.batch]
                part, g = N.gradient(flat, sizes, x[b], y[b], s.penalty)
                total, step = total + part * len(b), step + 1
                m, v = N.FIRST * m + (1 - N.FIRST) * g, N.SECOND * v + (1 - N.SECOND) * g * g
                flat = flat - s.rate * np.sqrt(1 - N.SECOND**step) / (1 - N.FIRST**step) * m / (np.sqrt(v) + N.GUARD)
        assert np.allclose(found, [flat, m, v], rtol=1e-10, atol=1e-13) and loss == pytest.approx(total)


def test_folds(spark, parts):
    df = parts[0].unionByName(parts[0].limit(1).withColumn("label", F.lit(None).cast("int")))
    dealt = stratified_folds(df, 5, seed=3)
    counts = dealt.filter("label IS NOT NULL").groupBy("label", "fold").count().collect()
    for y in (0, 1):
        own = [r["count"] for r in counts if r.label == y]
        assert len(own) == 5 and max(own) - min(own) <= 1
    assert dealt.filter("fold IS NULL").count() == 1 and dealt.count() == df.count()
    scores = cross_validate(parts[0], FEATURES, N.Settings(hidden=(6,), epochs=60), folds=3).collect()
    assert {(r.fold, r.part) for r in scores} == {(i, p) for i in range(3) for p in ("train", "test")}
    base = parts[0].agg(F.avg("label")).first()[0]
    assert all(r.average_precision > base for r in scores)


def test_all_nets_score_in_one_pass(parts):
    found = cross_validate(parts[0], FEATURES, N.Settings(hidden=(2,), epochs=1), folds=3)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()  # scores are there, none is computed again
    assert found.count() == 6


def test_splits_on_the_driver_are_those_of_windows(spark, parts, monkeypatch):
    """Trees whose levels are sought on the driver, half of their nodes summed, and trees by windows over all sums."""
    settings = replace(B.CLASSIFIER, rounds=4, patience=4, depth=5)
    asked, sums = [], B.level_sums
    with monkeypatch.context() as m:
        m.setattr(B, "level_sums", lambda rows, s, width, trees, tree, nodes, *more: asked.append(len(nodes)) or sums(rows, s, width, trees, tree, nodes, *more))
        one = B.fit(*parts, FEATURES, settings)
    nodes = sum(1 + len(t.splits) for t in one.trees)
    assert sum(asked) < nodes + 4 * 2  # one of two children, and the roots
    monkeypatch.setattr(B, "FEW", 0)
    other = B.fit(*parts, FEATURES, settings)
    assert [(t.splits, t.leaves) for t in one.trees] == [(t.splits, t.leaves) for t in other.trees] and one.areas == other.areas
    monkeypatch.setattr(B, "FEW", 2)
    mixed = B.fit(*parts, FEATURES, settings)
    assert [(t.splits, t.leaves) for t in mixed.trees] == [(t.splits, t.leaves) for t in one.trees]
