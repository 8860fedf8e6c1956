"""Exact neighbours against brute force, with copies and several boxes."""

import numpy as np
import pytest

from loanloom.operators import neighbors as N


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1.0, 10.0, 0.1]
    x[100:180] = x[100]  # a group of copies
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    return x, y


@pytest.fixture
def frame(spark, cloud):
    x, y = cloud
    rows = [(f"{i:04d}", int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "loan_id string, label int, a double, b double, c double")


@pytest.fixture(autouse=True)
def small_boxes(monkeypatch):
    monkeypatch.setattr(N, "BOX_POINTS", 20)
    monkeypatch.setattr(N, "QUERY_SLICE", 15)


COLS = ["a", "b", "c"]


def test_nearest_is_exact(frame, cloud):
    x, _ = cloud
    points = N.distinct_vectors(frame, COLS)
    found = N.nearest(points, points, 5).collect()
    unique = np.unique(x, axis=0)
    assert len(found) == 5 * len(unique)
    by_query = {}
    for r in found:
        by_query.setdefault(tuple(r["q"]), []).append(r["distance"])
    for q, got in by_query.items():
        want = np.sort(np.sqrt(((unique - np.array(q)) ** 2).sum(axis=1)))[:5]
        assert np.allclose(sorted(got), want)


def test_fewer_points_than_asked_for(spark):
    df = spark.createDataFrame([(0.0,), (3.0,)], "a double")
    points = N.distinct_vectors(df, ["a"])
    assert N.nearest(points, points, 5).count() == 4


def test_knn_scores(frame, cloud):
    x, y = cloud
    train, test = frame.filter("loan_id >= '0200'"), frame.filter("loan_id < '0100'")
    got = {r["loan_id"]: r["score"] for r in N.knn_scores(train, test, COLS, 5).collect()}
    assert len(got) == 100
    for i in range(100):
        d = np.sqrt(((x[200:] - x[i]) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:5]
        w = 1 / d[near]
        assert got[f"{i:04d}"] == pytest.approx((w * y[200:][near]).sum() / w.sum())


def test_edited_neighbors(frame, cloud):
    x, y = cloud
    kept = {r["loan_id"] for r in N.edited_nearest_neighbors(frame, COLS, 3).collect()}
    for i in range(300):
        if 100 <= i < 180:
            continue  # among copies the three nearest are not unique
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:3]
        if any(100 <= j < 180 for j in near):
            continue
        assert (f"{i:04d}" in kept) == bool((y[near] == y[i]).all())


def test_smote_balances_and_interpolates(frame, cloud):
    _, y = cloud
    rare = frame.filter("label = 1 and loan_id < '0040' or label = 0")
    out = N.smote(rare, COLS, 5).toPandas()
    sizes = out.groupby("label").size()
    assert sizes[0] == sizes[1]
    made, base = out[out.synthetic], out[(~out.synthetic) & (out.label == 1)]
    assert made.loan_id.is_unique
    for c in COLS:
        assert made[c].between(base[c].min(), base[c].max()).all()


def test_equal_distances_go_to_the_smaller_vector(spark):
    """On a grid most distances are shared; the k-th place must not depend on the order of rows."""
    grid = [(float(a), float(b)) for a in range(12) for b in range(12)]
    df = spark.createDataFrame(sorted(grid, key=lambda v: (v[1] * 7 % 5, -v[0])), "a double, b double")
    points = N.distinct_vectors(df, ["a", "b"])
    found: dict = {}
    for r in N.nearest(points, points, 3).collect():
        found.setdefault(tuple(r["q"]), []).append((r["rank"], tuple(r["neighbor"])))
    for q in grid:
        want = sorted(grid, key=lambda v: (np.hypot(v[0] - q[0], v[1] - q[1]), v))[:3]
        assert [v for _, v in sorted(found[q])] == want


def test_few_pairs_are_measured_inside_a_box(monkeypatch):
    """A leaf of queries leaves out the points that are far from it, and the result stays exact."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(6000, 4)) * [50.0, 20.0, 1.0, 1.0]
    points[:, 3] = points[:, 3] > 0
    queries = points[rng.permutation(6000)[:1500]]
    measured = []
    distances = N._distances
    monkeypatch.setattr(N, "_distances", lambda *a: measured.append(len(a[1])) or distances(*a))
    q, p, d = N._best(points, queries, 4, np.full(1500, np.inf))
    assert sum(measured) < 0.01 * 6000 * 1500
    order = np.lexsort((p, d, q))
    for i in range(0, 1500, 50):
        want = np.sqrt(((points - queries[i]) ** 2).sum(axis=1))
        near = np.lexsort((np.arange(6000), want))[:4]
        assert p[order][q[order] == i].tolist() == near.tolist()


def test_missing_and_huge_numbers_in_a_box():
    points = np.array([[0.0, 1.0], [np.nan, 1.0], [1e200, 0.0], [0.5, 1.0]])
    q, p, d = N._best(points, points[:1], 2, np.full(1, np.inf))
    assert q.tolist() == [0, 0] and p.tolist() == [0, 3] and d.tolist() == [0.0, 0.5]


def test_copies_are_drawn_from_all_minority_neighbours(spark, monkeypatch):
    """Only the rows that get copies are asked for, against every minority row."""
    asked = []
    search = N.nearest_numbers
    monkeypatch.setattr(N, "nearest_numbers", lambda p, q, k: asked.append((p.count(), q.count())) or search(p, q, k))
    rows = [(f"{i:03d}", int(i < 40), float(i), float(i % 7)) for i in range(90)]
    out = N.smote(spark.createDataFrame(rows, "loan_id string, label int, a double, b double"), ["a", "b"], 3)
    assert out.filter("synthetic").count() == 10
    assert asked == [(40, 10)]
