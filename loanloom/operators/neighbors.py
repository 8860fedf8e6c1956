"""Exact nearest neighbours, and the resampling and voting built on them.

Points are cut into boxes of similar size by median splits of a bounded sample.
A query first looks in its own box, which bounds the distance of its k-th
neighbour; it is then sent only to those other boxes that come closer than that
bound.  Every candidate that could matter is seen, so the result is exact; no
pair of rows is ever emitted, only the best k per query and box.

Inside a box, queries and points are cut into small leaves in the same way.  A
leaf of queries meets leaves of points from the nearest outwards, until none is
closer than its k-th neighbours: a matrix product finds candidates, whose
distances are then taken from the coordinates themselves.

Identical vectors are merged (with their counts) before anything else, so a
large group of copies is one point.  Points and queries are numbered; only
numbers and distances travel with the results.  Points are numbered in the order
of their vectors, which decides between equal distances.  A box visited by very
many queries is handed to several tasks, each with a slice of the queries.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.features import hash_fraction
from loanloom.operators.ranked import running_totals
from loanloom.session import materialized

BOX_POINTS = 8_000  # aim for this many distinct points per box ...
MAX_BOXES = 1 << 14  # ... with at most this many boxes
SAMPLE_PER_BOX = 32  # sampled points per box: bounds what the driver sees
QUERY_SLICE = 20_000  # queries per task and box
LEAF = 256  # queries or points of a leaf inside a box
RUN = 4_096  # points that a leaf of queries meets at a time
CELLS = 4_000_000  # numbers of a block worked on at a time


@dataclass(frozen=True)
class Boxes:
    """A median-split tree as arrays: inner nodes first, then the leaf boxes.

    ``split_dim`` is -1 for a leaf; ``low`` / ``high`` bound each node's box.
    """

    split_dim: np.ndarray
    split_at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def home(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of ``x``."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            dim = self.split_dim[at]
            go = dim >= 0
            if not go.any():
                return at
            r, a, d = rows[go], at[go], dim[go]
            at[go] = np.where(x[r, d] < self.split_at[a], self.left[a], self.right[a])

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the leaves whose box comes within the row's ``radius``, a pair each."""
        dims = np.unique(self.split_dim[self.split_dim >= 0])  # no box ends in the others
        x, low, high = x[:, dims], self.low[:, dims], self.high[:, dims]
        rows, nodes = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        found_rows, found = [], []
        while len(rows):
            gap = np.maximum(np.maximum(low[nodes] - x[rows], x[rows] - high[nodes]), 0.0)
            near = ~(np.sqrt((gap * gap).sum(axis=1)) > radius[rows])
            rows, nodes = rows[near], nodes[near]
            leaf = self.split_dim[nodes] < 0
            found_rows.append(rows[leaf])
            found.append(nodes[leaf])
            rows, nodes = rows[~leaf], nodes[~leaf]
            rows, nodes = np.concatenate([rows, rows]), np.concatenate([self.left[nodes], self.right[nodes]])
        return np.concatenate([*found_rows, rows]), np.concatenate([*found, nodes])


def split_boxes(sample: np.ndarray, boxes: int) -> Boxes:
    """Median splits along the widest dimension until ``boxes`` leaves exist."""
    dims = sample.shape[1]
    nodes = [(np.full(dims, -np.inf), np.full(dims, np.inf))]
    split: list[tuple[int, float, int, int]] = [(-1, 0.0, -1, -1)]
    level = [(0, sample)]
    leaves = 1
    while level and leaves < boxes:
        following = []
        for node, pts in level:
            if len(pts) < 2 or leaves >= boxes:
                continue
            dim = int(np.argmax(pts.max(axis=0) - pts.min(axis=0)))
            cut = float(np.median(pts[:, dim]))
            below = pts[:, dim] < cut
            if not below.any():  # the median is the minimum: cut just above it
                above = pts[:, dim][pts[:, dim] > cut]
                if not len(above):
                    continue
                cut = float(above.min())
                below = pts[:, dim] < cut
            low, high = nodes[node]
            left_high, right_low = high.copy(), low.copy()
            left_high[dim] = right_low[dim] = cut
            nodes += [(low, left_high), (right_low, high)]
            split[node] = (dim, cut, len(nodes) - 2, len(nodes) - 1)
            split += [(-1, 0.0, -1, -1)] * 2
            following += [(len(nodes) - 2, pts[below]), (len(nodes) - 1, pts[~below])]
            leaves += 1
        level = following
    dim, at, left, right = (np.array(x) for x in zip(*split))
    low, high = (np.array(x) for x in zip(*nodes))
    return Boxes(dim.astype(np.int64), at, left, right, low, high)


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of the rows of ``x`` by leaf, from halving along the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        part = x[at]
        width = part.max(axis=0) - part.min(axis=0)
        if len(at) <= most or not width.max() > 0:
            out += np.array_split(at, -(-len(at) // most))
            continue
        order = np.argsort(part[:, np.argmax(width)], kind="stable")
        todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    return out


def _distances(points: np.ndarray, p: np.ndarray, queries: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance between point ``p[i]`` and query ``q[i]`` for every i."""
    step = max(1, CELLS // max(1, points.shape[1]))
    parts = [np.empty(0)]
    for i in range(0, len(p), step):
        diff = queries[q[i : i + step]] - points[p[i : i + step]]
        parts.append(np.sqrt((diff * diff).sum(axis=1)))
    return np.concatenate(parts)


def _first(q: np.ndarray, p: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each query ``q`` the k nearest ``p``, ties to the smaller, and their places from 0."""
    order = np.lexsort((p, d, q))
    q, p, d = q[order], p[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    few = place < k
    return q[few], p[few], d[few], place[few]


def _best(points: np.ndarray, queries: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """Queries, points and distances of every query's k nearest points within its ``reach``.

    Ties go to the point that comes first.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    large = max(np.abs(points).max(), np.abs(queries).max())
    if not large < 1e100:  # missing, infinite or very large: no products
        step = max(1, CELLS // max(1, points.size))
        for i in range(0, len(queries), step):
            diff = queries[i : i + step, None, :] - points[None, :, :]
            with np.errstate(over="ignore", invalid="ignore"):
                d = np.sqrt((diff * diff).sum(axis=2))
            p = np.argsort(d, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(i, i + len(p)), p.shape[1])
            found.append((q, p.ravel(), np.take_along_axis(d, p, axis=1).ravel()))
        q, p, d = (np.concatenate(x) for x in zip(*found))
        near = ~(d > reach[q])
        return q[near], p[near], d[near]

    center = points.mean(axis=0)
    moved = points - center
    square = (moved * moved).sum(axis=1)
    leaves = _leaves(points, LEAF)
    low = np.stack([points[at].min(axis=0) for at in leaves])
    high = np.stack([points[at].max(axis=0) for at in leaves])
    for own in _leaves(queries, LEAF):
        x = queries[own]
        gap = np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0.0)
        near = np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-12)
        order = np.argsort(near, kind="stable")
        ends = np.cumsum([len(leaves[k]) for k in order])
        shift = x - center
        length = (shift * shift).sum(axis=1)
        slack = 1e-10 * (length + square.max())  # far more than the product's rounding
        limit = reach[own].copy()
        q, p, d = found[0]
        at, most = 0, max(2 * LEAF, 4 * k)
        while at < len(order):
            active = np.flatnonzero(limit >= near[order[at]])
            if not len(active):
                break
            done = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            until = max(at + 1, min(until, int(np.searchsorted(near[order], limit.max(), side="right"))))
            held = np.concatenate([leaves[k] for k in order[at:until]])
            about = length[active, None] + square[held] - 2 * (shift[active] @ moved[held].T)
            cut = limit[active] ** 2
            if len(held) > k:
                cut = np.minimum(cut, np.partition(about, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(about <= (cut + slack[active])[:, None])
            new = _distances(points, held[c], x, active[r])
            q, p, d, place = _first(np.append(q, active[r]), np.append(p, held[c]), np.append(d, new), k)
            last = place == k - 1
            limit[q[last]] = np.minimum(limit[q[last]], d[last])
            at, most = until, RUN
        inside = d <= reach[own][q]
        found.append((own[q[inside]], p[inside], d[inside]))
    q, p, d = (np.concatenate(x) for x in zip(*found))
    return q, p, d


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def distinct_vectors(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Distinct vectors ``v`` with their number of rows ``n`` and positives ``n_pos``."""
    positives = F.sum(F.col(label).cast("bigint")) if label else F.lit(0).cast("bigint")
    return df.groupBy(vector(columns).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), positives.alias("n_pos")
    )


_FOUND = "q bigint, p bigint, distance double, n bigint, n_pos bigint"


def numbered(vectors: DataFrame, name: str, ordered: bool = False) -> DataFrame:
    """``vectors`` written once with a number ``name`` for each row, ``ordered`` as the vectors ``v`` are."""
    rows = vectors.orderBy("v") if ordered else vectors
    return materialized(rows.withColumn(name, F.monotonically_increasing_id()))


def nearest(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct points of every distinct query vector.

    ``points`` come from :func:`distinct_vectors`; ``queries`` has a column
    ``v`` of distinct vectors.  Result: one row per query ``q`` and neighbour,
    as vectors.
    """
    points = numbered(points, "p", ordered=True)
    queries = numbered(queries.select("v"), "q")
    found = nearest_numbers(points, queries, k)
    named = found.join(points.select("p", F.col("v").alias("neighbor")), "p").drop("p")
    return named.withColumnRenamed("q", "number").join(
        queries.select(F.col("q").alias("number"), F.col("v").alias("q")), "number"
    ).select("q", "distance", "neighbor", "n", "n_pos", "rank")


def nearest_numbers(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Numbers of the k nearest ``points`` of every query: ``q``, ``p``, ``distance``, ``n``, ``n_pos``, ``rank``.

    ``points``: ``p`` (ordered as ``v``), ``v``, ``n``, ``n_pos``; ``queries``:
    ``q``, ``v``.  Both are read several times: give them as :func:`numbered`
    leaves them.
    """
    total = points.count()
    boxes = int(min(MAX_BOXES, max(1, -(-total // BOX_POINTS))))
    share = min(1.0, SAMPLE_PER_BOX * boxes / max(total, 1))
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    sample = points.filter(draw < share).select("v").limit(2 * SAMPLE_PER_BOX * boxes).toPandas()
    if not len(sample):
        sample = points.select("v").limit(1).toPandas()
    if not len(sample):
        return points.sparkSession.createDataFrame([], _FOUND + ", rank int")
    tree = split_boxes(_matrix(sample["v"]), boxes)

    @F.pandas_udf("bigint")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(tree.home(_matrix(v)) if len(v) else np.empty(0, np.int64))

    @F.pandas_udf("array<bigint>")
    def others(v: pd.Series, radius: pd.Series, at_home: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(v), 1_000):
            part = slice(i, i + 1_000)
            row, leaf = tree.within(_matrix(v[part]), radius[part].fillna(np.inf).to_numpy())
            away = leaf != at_home[part].to_numpy()[row]
            row, leaf = row[away], leaf[away]
            order = np.argsort(row, kind="stable")
            out += np.split(leaf[order], np.searchsorted(row[order], np.arange(1, len(v[part]))))
        return pd.Series(out, dtype=object)

    placed = points.select("p", "v", "n", "n_pos").withColumn("box", home("v"))
    asked = queries.select("q", F.col("v").alias("x")).withColumn("box", home("x"))
    unbounded = F.lit(float("inf")).alias("radius")
    first = materialized(_search(placed, asked.select("q", "x", "box", unbounded), k))
    # Distance of the k-th neighbour in the own box; unknown if it has fewer.
    bound = first.groupBy("q").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("radius")
    )
    visits = (
        asked.join(bound, "q", "left")
        .withColumn("box", F.explode(others("x", "radius", "box")))
        .select("q", "x", "box", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    )
    found = first.unionByName(_search(placed, visits, k))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "p"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(points: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Best k of every visit inside its box, none beyond the visit's ``radius``."""
    # One row per box: at most MAX_BOXES.
    slices = visits.groupBy("box").agg(
        F.ceil(F.count(F.lit(1)) / QUERY_SLICE).cast("int").alias("slices")
    )
    cut = F.pmod(F.xxhash64("q"), F.col("slices")).cast("int")
    asked = visits.join(F.broadcast(slices), "box").withColumn("slice", cut).drop("slices")
    held = points.join(F.broadcast(slices), "box").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    ).drop("slices")

    def look(q: pa.Table, p: pa.Table) -> pa.Table:
        number, at, distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        p = p.sort_by("p")
        if q.num_rows and p.num_rows:
            number, at, distance = _best(
                _rows(p.column("v")), _rows(q.column("x")), k, q.column("radius").to_numpy()
            )
        own = p.select(["p", "n", "n_pos"]).take(pa.array(at))
        return pa.table(
            {
                "q": q.column("q").take(pa.array(number)),
                "p": own.column("p"),
                "distance": pa.array(distance),
                "n": own.column("n"),
                "n_pos": own.column("n_pos"),
            }
        )

    grouped = asked.groupBy("box", "slice").cogroup(held.groupBy("box", "slice"))
    return grouped.applyInArrow(look, _FOUND)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix; a missing number is NaN."""
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def take_neighbors(found: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Per query the k nearest rows as counts on each of its neighbour points.

    Adds ``taken`` and ``taken_pos``: how many of the k rows (and how many of
    those positive) lie at that point.  Of a point that is only partly needed
    the positives are taken in proportion.
    """
    own = F.when(F.col("distance") == 0, 1).otherwise(0) if skip_self else F.lit(0)
    usable = found.withColumn("usable", F.col("n") - own)
    w = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("usable").over(w), F.lit(0))
    taken = F.greatest(F.least(F.col("usable"), k - F.col("before")), F.lit(0))
    return (
        usable.withColumn("before", before)
        .withColumn("taken", taken)
        .filter(F.col("taken") > 0)
        .drop("before", "rank")
    )


def knn_scores(
    train: DataFrame, test: DataFrame, columns: list[str], k: int = 5, label: str = "label"
) -> DataFrame:
    """Distance-weighted share of positive neighbours for every test row.

    Neighbours at distance 0, if any, decide alone.  ``prediction`` is 1 from a
    score of more than one half.
    """
    points = numbered(distinct_vectors(train, columns, label), "p", ordered=True)
    queries = numbered(test.select(vector(columns).alias("v")).distinct(), "q")
    near = take_neighbors(nearest_numbers(points, queries, k), k, skip_self=False)
    positive = F.col("taken") * F.col("n_pos") / F.col("n")
    exact = F.col("distance") == 0
    weight = F.try_divide(F.lit(1.0), F.col("distance"))

    def share(hit: Column, w: Column) -> Column:
        return F.try_divide(
            F.sum(F.when(hit, positive * w)), F.sum(F.when(hit, F.col("taken") * w))
        )

    scores = near.groupBy("q").agg(
        F.coalesce(share(exact, F.lit(1.0)), share(~exact, weight)).alias("score")
    ).join(queries, "q").drop("q")
    scored = test.withColumn("v", vector(columns)).join(scores, "v").drop("v")
    return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def edited_nearest_neighbors(
    df: DataFrame, columns: list[str], k: int = 3, label: str = "label", rule: str = "all"
) -> DataFrame:
    """Drop rows whose k nearest other rows disagree with their class.

    ``rule="all"`` keeps a row only if every neighbour agrees, ``"mode"`` if
    most do.
    """
    points = numbered(distinct_vectors(df, columns, label), "p", ordered=True)
    # A row's own point may supply none of its k neighbours, hence one more.
    found = nearest_numbers(points, points.select(F.col("p").alias("q"), "v"), k + 1)
    own = F.col("distance") == 0
    rows = df.withColumn("v", vector(columns))
    marks = {}
    for y in (0, 1):
        # Rows of class y at each point, the row itself not counted.
        same = F.col("n_pos") if y else F.col("n") - F.col("n_pos")
        marks[y] = found.withColumns(
            {"n": F.col("n") - own.cast("int"), "same": same - own.cast("int")}
        ).filter(F.col("n") > 0)
    agreed = None
    for y, near in marks.items():
        w = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(w), F.lit(0))
        taken = F.greatest(F.least(F.col("n"), k - F.col("before")), F.lit(0))
        near = near.withColumn("before", before).withColumn("taken", taken)
        votes = near.groupBy("q").agg(
            F.sum(F.col("taken") * F.col("same") / F.col("n")).alias("agree"),
            F.sum("taken").alias("asked"),
        ).withColumn("vote_label", F.lit(y))
        agreed = votes if agreed is None else agreed.unionByName(votes)
    keep = F.col("agree") >= F.col("asked") if rule == "all" else 2 * F.col("agree") > F.col("asked")
    kept = agreed.filter(keep).select(F.col("q").alias("p"), F.col("vote_label").alias(label))
    kept = kept.join(points.select("p", "v"), "p").drop("p")
    return rows.join(kept, ["v", label], "left_semi").select(*df.columns)


def smote(
    df: DataFrame,
    columns: list[str],
    k: int = 5,
    label: str = "label",
    key: str = "loan_id",
    seed: int = 0,
) -> DataFrame:
    """Add synthetic minority rows until both classes have the same size.

    Every synthetic row lies at a random place between a minority row and one of
    its k nearest minority neighbours.  Columns other than ``columns``, the
    label and the key are left out; ``synthetic`` marks the added rows.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(sizes, key=lambda y: sizes[y])
    have, want = sizes[minority], max(sizes.values()) - min(sizes.values())
    base = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in columns])
    rare = base.filter(F.col(label) == minority)
    drawn = rare.withColumn("draw", hash_fraction(F.col(key), seed))
    whole, extra = divmod(want, have)
    limit = (
        running_totals(drawn, "draw", {"n_at": F.lit(1)})
        .filter(F.col("n_at_before") < extra)
        .agg(F.max("draw"))
        .first()[0]
    )
    more = F.lit(0) if limit is None else (F.col("draw") <= F.lit(limit)).cast("int")
    copies = (
        drawn.withColumn("number", F.lit(whole) + more)
        .filter(F.col("number") > 0)
        .withColumn("number", F.explode(F.sequence(F.lit(1), F.col("number"))))
        .withColumn("v", vector(columns))
    )
    # Neighbours are looked for among all minority rows, of those that are drawn.
    points = numbered(distinct_vectors(rare, columns), "p", ordered=True)
    queries = points.select(F.col("p").alias("q"), "v").join(copies.select("v").distinct(), "v", "left_semi")
    queries = materialized(queries)
    near = take_neighbors(nearest_numbers(points, queries, k + 1), k, skip_self=True)
    near = near.join(points.select("p", F.col("v").alias("neighbor")), "p")
    # At most k + 1 neighbour points per vector.
    choices = near.groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbor", "taken"))).alias("choices")
    ).withColumn("choices", F.flatten(F.transform("choices", _repeat))).join(queries, "q").drop("q")
    tag = F.concat(F.col(key).cast("string"), F.lit("/"), F.col("number").cast("string"))
    pick = F.floor(hash_fraction(tag, seed + 1) * F.size("choices")).cast("int")
    mixed = (
        copies.join(choices, "v")
        .withColumn("other", F.get("choices", pick))
        .withColumn("gap", hash_fraction(tag, seed + 2))
    )
    synthetic = mixed.select(
        tag.alias(key),
        F.col(label),
        *[
            (F.col(c) + F.col("gap") * (F.col("other")[i] - F.col(c))).alias(c)
            for i, c in enumerate(columns)
        ],
        F.lit(True).alias("synthetic"),
    )
    return base.withColumn("synthetic", F.lit(False)).unionByName(synthetic)


def _repeat(choice: Column) -> Column:
    return F.array_repeat(choice["neighbor"], choice["taken"].cast("int"))


def smote_enn(
    train: DataFrame,
    columns: list[str],
    k: int = 5,
    clean_k: int = 3,
    label: str = "label",
    key: str = "loan_id",
    seed: int = 0,
) -> DataFrame:
    """Oversample, then clean.  Apply to a training set only, after splitting."""
    grown = materialized(smote(train, columns, k, label, key, seed))
    return edited_nearest_neighbors(grown, columns, clean_k, label)
