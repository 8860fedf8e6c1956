"""Random forests of deep trees.

Spark's learner sends the sums of every node of every tree through a shuffle,
which deep trees have too many of.  Here features are cut once into cells at
quantiles, equal rows become one that is counted, and draws of rows (Poisson)
and of a node's features are hashes, of the row and tree or of the tree and
node.  Nodes of more than ``LOCAL`` draws are split in passes over all rows, a
level of all trees at a time; once a node has fewer, its rows go to one task,
which grows all below it.  Where that happens changes no tree.  A tree ends as
Spark's do: no gain, the depth, and leaves beside each other that tell the same
become one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators.boosting import _cells_of, _matrix, _numbers, learn_cells, placed
from loanloom.session import materialized

#: Cells of a feature beside the missing one (as Spark's bins), and draws of a node up to which one task grows it.
CELLS, LOCAL = 32, 1 << 18
WIDE = CELLS + 1
#: Least gain of a split, and tasks that add up the sums of others.
LEAST, ADDERS = 1e-12, 8
#: Rows scored at a time.
SCORED = 4096


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(seed: int, tree: int) -> np.uint64:
    return _scrambled(np.array([(seed << 32) + tree + 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]


def draws(hashed: np.ndarray, many: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row that stands for ``many`` equal ones: Poisson, ``many`` on average."""
    share = (_scrambled(hashed.astype(np.uint64) ^ _seeded(seed, tree)) >> np.uint64(11)) / float(1 << 53)
    out = np.zeros(len(many), np.int64)
    for m in np.unique(many).tolist():
        k = np.arange(int(m + 12 * np.sqrt(m)) + 30)
        logs = k * np.log(m) - m - np.concatenate([[0], np.cumsum(np.log(k[1:]))])
        at = many == m
        out[at] = np.searchsorted(np.cumsum(np.exp(logs)), share[at], side="right")
    return out


def features_of(nodes: np.ndarray, features: int, some: int, seed: int, tree: int) -> np.ndarray:
    """The features that each node may split on, in order: ``some`` of those with the least hashes."""
    keys = nodes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(features, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.sort(np.argsort(_scrambled(_scrambled(keys) ^ _seeded(~seed & 0xFFFFFFFF, tree)), axis=1, kind="stable")[:, :some], axis=1)


def best_cuts(whole: np.ndarray, ones: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of sums by cell the cut of most Gini gain: its gain and the last cell to the left; no cut: gain 0."""
    total, total_ones = whole.sum(axis=1, keepdims=True), ones.sum(axis=1, keepdims=True)
    left, left_ones = whole.cumsum(axis=1)[:, :-1], ones.cumsum(axis=1)[:, :-1]
    right, right_ones = total - left, total_ones - left_ones
    impure = lambda n, p: p * (n - p) / np.maximum(n, 1)
    gain = 2 * (impure(total, total_ones) - impure(left, left_ones) - impure(right, right_ones)) / np.maximum(total, 1)
    gain = np.where((left >= max(1, least)) & (right >= max(1, least)), gain, 0.0)
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


@dataclass
class Settings:
    """Trees, their greatest depth, a leaf's draws at least, features in all and tried at a node."""

    trees: int
    depth: int
    least: int
    seed: int
    features: int

    @property
    def some(self) -> int:
        return self.features if self.trees == 1 else int(np.ceil(np.sqrt(self.features)))


@dataclass
class Nodes:
    """A tree: the root first, the left child's number and the right one's after it; leaves have feature -1."""

    feature: np.ndarray
    cell: np.ndarray
    left: np.ndarray
    score: np.ndarray  # share of ones

    def reached(self, cells: np.ndarray) -> np.ndarray:
        node = np.zeros(len(cells), np.int64)
        rows = np.flatnonzero(self.feature[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = at = self.left[at] + (cells[rows, self.feature[at]] > self.cell[at])
            rows = rows[self.feature[at] >= 0]
        return node


def grown(cells: np.ndarray, label: np.ndarray, drawn: np.ndarray, root: int, tree: int, s: Settings) -> tuple[Nodes, np.ndarray, int, int]:
    """The tree below ``root`` on these rows, pruned, with the importance of every feature, its draws and its ones."""
    parts: list[tuple[np.ndarray, ...]] = []
    ids, node, rows, begin, level = np.array([root]), np.zeros(len(cells), np.int64), np.arange(len(cells)), 0, root.bit_length() - 1
    one = drawn * label
    while len(ids):
        whole, ones = (np.bincount(node, x[rows], len(ids)).astype(np.int64) for x in (drawn, one))
        feature, cell, gains = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.zeros(len(ids))
        open_ = np.flatnonzero((ones > 0) & (ones < whole) & (whole >= 2 * s.least)) if level < s.depth else np.zeros(0, np.int64)
        place = np.full(len(ids), -1)
        place[open_] = np.arange(len(open_))
        inside = place[node] >= 0
        node, rows = place[node[inside]], rows[inside]
        if len(open_):
            tried = features_of(ids[open_], s.features, s.some, s.seed, tree)
            w, p = drawn[rows], one[rows]
            for j in range(s.some):
                key = node * WIDE + cells[rows, tried[node, j]]
                sums = (np.bincount(key, x, len(open_) * WIDE).reshape(-1, WIDE) for x in (w, p))
                gain, cut = best_cuts(*sums, s.least)
                better = np.flatnonzero((gain > gains[open_]) & (gain > LEAST))
                at = open_[better]
                gains[at], cell[at], feature[at] = gain[better], cut[better], tried[better, j]
        split = feature >= 0
        left = np.where(split, begin + len(ids) + 2 * (np.cumsum(split) - 1), -1)
        parts.append((feature, cell, left, whole, ones, gains))
        stays = split[open_[node]]
        node, rows = open_[node[stays]], rows[stays]
        goes = cells[rows, feature[node]] > cell[node]
        node = left[node] - begin - len(ids) + goes
        begin += len(ids)
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).ravel()
        level += 1
    feature, cell, left, whole, ones, gains = (np.concatenate(x) for x in zip(*parts))
    told = 2 * ones > whole
    ends = np.cumsum([0, *(len(x[0]) for x in parts)])
    for low, high in zip(ends[-2::-1], ends[:0:-1]):  # from the leaves up
        at = low + np.flatnonzero(feature[low:high] >= 0)
        one_, two = left[at], left[at] + 1
        feature[at[(feature[one_] < 0) & (feature[two] < 0) & (told[one_] == told[two])]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for low, high in zip(ends[:-1], ends[1:]):
        at = low + np.flatnonzero((feature[low:high] >= 0) & kept[low:high])
        kept[left[at]] = kept[left[at] + 1] = True
    number = np.cumsum(kept) - 1
    inner = kept & (feature >= 0)
    importance = np.bincount(feature[inner], gains[inner] * whole[inner], s.features)
    left = np.where(feature >= 0, number[left], -1)
    score = ones / np.maximum(whole, 1)
    return Nodes(feature[kept], cell[kept], left[kept], score[kept]), importance, int(whole[0]), int(ones[0])


@dataclass
class Top:
    """What passes over all rows have found of a tree, by the number of a node, whose children are 2n and 2n + 1."""

    splits: dict[int, tuple[int, int, float]]  # feature, last cell to the left, gain
    sums: dict[int, tuple[int, int]]  # draws and ones, where known
    open: set[int]

    def reached(self, cells: np.ndarray) -> np.ndarray:
        node, todo = np.ones(len(cells), np.int64), [1]
        while todo:
            n = todo.pop()
            if n in self.splits:
                feature, cell, _ = self.splits[n]
                at = np.flatnonzero(node == n)
                node[at] = 2 * n + (cells[at, feature] > cell)
                todo += [2 * n, 2 * n + 1]
        return node


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Cells, label, hash and number of equal rows."""
    return _matrix(batch.column(1), width), *(batch.column(k).to_numpy() for k in (0, 2, 3))


def level_sums(rows: DataFrame, tops, big: list[tuple[int, int]], s: Settings) -> np.ndarray:
    """For each node of ``big`` (tree, node) and feature it tries, draws and ones by cell, over all rows."""
    place = {x: k for k, x in enumerate(big)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(big), s.some, WIDE), np.int64)
        for batch in batches:
            cells, label, hashed, many = _read(batch, s.features)
            for tree in sorted({t for t, _ in big}):
                drawn, node = draws(hashed, many, s.seed, tree), tops.value[tree].reached(cells)
                for n in np.unique(node).tolist():
                    if (tree, n) in place:
                        at = np.flatnonzero((node == n) & (drawn > 0))
                        for j, f in enumerate(features_of(np.array([n]), s.features, s.some, s.seed, tree)[0].tolist()):
                            for kind, x in enumerate((drawn[at], (drawn * label)[at])):
                                sums[kind, place[tree, n], j] += np.bincount(cells[at, f], x, WIDE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total = total + np.frombuffer(blob, np.int64)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = rows.mapInArrow(run, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary").collect()  # of the big nodes alone
    return np.sum([np.frombuffer(r.sums, np.int64) for r in found], axis=0).reshape(2, len(big), s.some, WIDE)


def _tops(rows: DataFrame, s: Settings) -> list[Top]:
    """The splits of all nodes with more than ``LOCAL`` draws, level by level."""
    total = rows.agg(F.sum("many")).first()[0] or 0
    tops = [Top({}, {1: (total, 0)}, {1}) for _ in range(s.trees)]
    while big := [(t, n) for t, top in enumerate(tops) for n in sorted(top.open) if top.sums[n][0] > LOCAL and n.bit_length() <= s.depth]:
        shared = rows.sparkSession.sparkContext.broadcast(tops)
        whole, ones = level_sums(rows, shared, big, s)
        shared.unpersist()
        for k, (t, n) in enumerate(big):
            top = tops[t]
            top.sums[n] = own = int(whole[k, 0].sum()), int(ones[k, 0].sum())
            top.open.discard(n)
            if 0 < own[1] < own[0]:
                gain, cut = best_cuts(whole[k], ones[k], s.least)
                j = int(gain.argmax())
                if gain[j] > LEAST:
                    feature = int(features_of(np.array([n]), s.features, s.some, s.seed, t)[0][j])
                    top.splits[n] = feature, int(cut[j]), float(gain[j])
                    low = slice(0, int(cut[j]) + 1)
                    left = int(whole[k, j, low].sum()), int(ones[k, j, low].sum())
                    top.sums |= {2 * n: left, 2 * n + 1: (own[0] - left[0], own[1] - left[1])}
                    top.open |= {2 * n, 2 * n + 1}
    return tops


def _below(rows: DataFrame, tops: list[Top], s: Settings) -> DataFrame:
    """``(tree, node, feature, cell, left, score, importance, draws, ones)``: what is grown below every open node, each in one task."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, label, hashed, many = _read(batch, s.features)
            for tree, top in enumerate(shared.value):
                drawn, node = draws(hashed, many, s.seed, tree), top.reached(cells)
                for n in np.unique(node).tolist():
                    at = np.flatnonzero((node == n) & (drawn > 0)) if n in top.open else ()
                    if len(at):
                        parts = cells[at], label[at].astype(np.uint8), drawn[at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree], pa.int32()), pa.array([n]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
                            ["tree", "node", "cells", "label", "drawn"],
                        )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                cells, label, drawn = (b"".join(x) for x in zip(*held))
                cells = np.frombuffer(cells, np.uint8).reshape(-1, s.features)
                nodes, importance, n, p = grown(cells, np.frombuffer(label, np.uint8).astype(np.int64), np.frombuffer(drawn, np.int64), now[1], now[0], s)
                packed = nodes.feature.astype(np.int16), nodes.cell.astype(np.uint8), nodes.left.astype(np.int32), nodes.score.astype(np.float32), importance
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]]), *(pa.array([x.tobytes()], pa.binary()) for x in packed), pa.array([n]), pa.array([p])],
                    ["tree", "node", "feature", "cell", "left", "score", "importance", "draws", "ones"],
                )
                held.clear()

        for batch in batches:  # sorted by tree and node
            for tree, node, *parts in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (tree, node) != now:
                    yield from done()
                    now = tree, node
                held.append(parts)
        yield from done()

    dealt = rows.mapInArrow(deal, "tree int, node long, cells binary, label binary, drawn binary")
    # as many partitions as open nodes, up to 1,000: adaptive execution may not merge them, as what follows costs far more than reading
    tasks = min(1000, max(1, sum(len(t.open) for t in tops)))
    dealt = dealt.repartition(tasks, "tree", "node").sortWithinPartitions("tree", "node")
    schema = "tree int, node long, feature binary, cell binary, left binary, score binary, importance binary, draws long, ones long"
    return dealt.mapInArrow(grow, schema)


def _whole(top: Top, below: dict[int, tuple[Nodes, np.ndarray, int, int]], features: int) -> tuple[Nodes, np.ndarray]:
    """One tree of its top and of what is grown below it, with the importance of its features."""
    importance = np.sum([x[1] for x in below.values()], axis=0) if below else np.zeros(features)
    sums = top.sums | {n: x[2:] for n, x in below.items()}
    splits = dict(top.splits)
    inner = {n for n, x in below.items() if len(x[0].feature) > 1}
    for n in sorted(splits, reverse=True):
        children = 2 * n, 2 * n + 1
        told = {2 * sums[c][1] > sums[c][0] for c in children}
        if len(told) == 1 and not any(c in splits or c in inner for c in children):
            del splits[n]
        else:
            importance[splits[n][0]] += splits[n][2] * sums[n][0]
    parts: list[list] = [[], [], [], []]
    place, todo, more = {1: 0}, [1], []
    for n in todo:  # the top in the order of levels
        row = (-1, 0, -1, sums[n][1] / max(1, sums[n][0]))
        if n in splits:
            place |= {2 * n: len(todo), 2 * n + 1: len(todo) + 1}
            row = (splits[n][0], splits[n][1], len(todo), 0.0)
            todo += [2 * n, 2 * n + 1]
        elif n in below and n not in top.splits:
            more.append(n)
        for part, x in zip(parts, row):
            part.append(x)
    arrays = [[np.array(x, t)] for x, t in zip(parts, (np.int16, np.uint8, np.int32, np.float32))]
    base = len(todo)
    for n in more:
        own = below[n][0]
        left = np.where(own.left >= 0, own.left + base - 1, -1).astype(np.int32)
        for held, x in zip(arrays, (own.feature, own.cell, left, own.score)):
            held[0][place[n]] = x[0]
            held.append(x[1:])
        base += len(own.feature) - 1
    return Nodes(*(np.concatenate(x) for x in arrays)), importance


@dataclass
class Forest:
    """A fitted forest."""

    starts: dict[str, list[float]]
    trees: list[Nodes]
    featureImportances: DenseVector

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``, the trees' mean share of ones, and hard ``prediction``."""
        names, edges = list(self.starts), list(self.starts.values())
        trees = df.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, SCORED):
                    rows = batch.slice(low, SCORED)
                    cells = _cells_of(_numbers(rows, names), edges)
                    total = np.zeros(len(cells))
                    for tree in trees.value:
                        total += tree.score[tree.reached(cells)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(total / max(1, len(trees.value)))], ["row", "score"])

        row = [c for c in df.columns if c != "features"]  # the vector is a type that Arrow does not carry
        kind = df.select(F.struct(*row).alias("row")).schema["row"].dataType.simpleString()
        out = _spread(df, len(names), F.struct(*row).alias("row")).mapInArrow(run, f"row {kind}, score double")
        return out.select("row.*", "score").withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def _spread(df: DataFrame, width: int, *others) -> DataFrame:
    """The numbers of ``features`` as columns f0, f1, ..."""
    values = df.select(*others, vector_to_array("features").alias("values"))
    kept = [c for c in values.columns if c != "values"]
    return values.select(*kept, *[F.col("values")[k].alias(f"f{k}") for k in range(width)])


def fit(train: DataFrame, trees: int, depth: int, least: int, seed: int) -> Forest:
    """A forest on ``features`` and ``label`` (0 or 1); the same however the rows are dealt to tasks."""
    first = train.select("features").first()
    width = len(first.features) if first else 0
    numbers = _spread(train, width, F.col("label").cast("long").alias("label"))
    starts = learn_cells(numbers, [f"f{k}" for k in range(width)], CELLS)
    counted = placed(numbers, starts, "label").groupBy("label", "cells").agg(F.count("*").alias("many"))
    # small as they are, every task has all trees to draw for
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialized(counted.select("label", "cells", F.xxhash64("label", "cells").alias("hashed"), "many").repartition(tasks))
    s = Settings(trees, depth, least, seed, width)
    tops = _tops(rows, s)
    below: list[dict] = [{} for _ in range(trees)]
    for r in materialized(_below(rows, tops, s)).coalesce(ADDERS).toLocalIterator():
        kinds = (r.feature, np.int16), (r.cell, np.uint8), (r.left, np.int32), (r.score, np.float32)
        nodes = Nodes(*(np.frombuffer(x, t) for x, t in kinds))
        below[r.tree][r.node] = nodes, np.frombuffer(r.importance), r.draws, r.ones
    whole = [_whole(top, own, width) for top, own in zip(tops, below)]
    shares = [x / x.sum() for _, x in whole if x.sum() > 0]
    importance = np.sum(shares, axis=0) / len(shares) if shares else np.zeros(width)
    return Forest(starts, [t for t, _ in whole], Vectors.dense(importance))
