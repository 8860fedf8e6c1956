"""A feed-forward net with tanh layers, fitted by Adam on mini-batches.

Rows are dealt to shards by a hash of their id.  In a pass every task takes
mini-batch steps on its shards from the same weights; weights and moments are
then averaged over the shards, by rows.  A table that fits one shard is fitted
as on one machine.  Several nets, one for each fold left out, learn in the same
passes and, in a task, in the same steps.  Each shard is a partition of its own,
packed once into arrays.  Inputs are scaled to mean 0 and deviation 1 of the
training rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.session import materialized

#: Rows of a shard, and epochs of a pass.
SHARD, EPOCHS = 50_000, 10
#: Rows packed together, and tasks of a pass for each core, where there are nets enough.
PACK, TASKS = 10_000, 2
#: Adam's decays and guard.
FIRST, SECOND, GUARD = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (10,) * 8
    rate: float = 0.001
    penalty: float = 0.0001
    batch: int = 200
    epochs: int = 200
    tolerance: float = 1e-4
    patience: int = 10
    seed: int = 2345


def shapes(inputs: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [inputs, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def split(flat: np.ndarray, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of each layer, as views into one vector, or into several that are stacked."""
    out, at = [], 0
    for a, b in sizes:
        out.append((flat[..., at : at + a * b].reshape(*flat.shape[:-1], a, b), flat[..., at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def initial(sizes: list[tuple[int, int]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in sizes:
        parts.append(rng.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)))
    return np.concatenate(parts)


def forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """The input and every layer's output; the last one is the log odds."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.tanh(z) if k < len(layers) - 1 else z)
    return out


class _Batch:
    """Losses and gradients of stacked nets, each on a batch of its own of ``n`` rows; all arrays are made once."""

    def __init__(self, flat: np.ndarray, sizes, n: int, penalty: float):
        self.flat, self.n, self.penalty = flat, n, penalty
        self.layers, self.out = split(flat, sizes), np.empty_like(flat)
        self.parts = split(self.out, sizes)
        penalties = np.zeros(flat.shape[-1])
        for w, _ in split(penalties, sizes):
            w[:] = penalty
        self.penalties = penalties
        self.values = [np.empty((len(flat), n, c)) for c in (sizes[0][0], *[b for _, b in sizes])]
        # two arrays of a width serve in turn, so that they stay in the core's cache
        pool = {(b, turn): np.empty((len(flat), n, b)) for _, b in sizes for turn in (0, 1)}
        self.deltas = [pool[b, k % 2] for k, (_, b) in enumerate(sizes)]
        self.slopes = {b: np.empty((len(flat), n, b)) for _, b in sizes[:-1]}
        self.y = np.empty((len(flat), n))

    def take(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> None:
        """The rows of every net's batch."""
        np.take(x, at, axis=0, out=self.values[0], mode="clip")
        np.take(y, at, out=self.y, mode="clip")

    def gradient(self) -> np.ndarray:
        values, deltas, last = self.values, self.deltas, len(self.layers) - 1
        for k, (w, b) in enumerate(self.layers):
            z = np.matmul(values[k], w, out=values[k + 1])
            z += b[:, None]
            if k < last:
                np.tanh(z, out=z)
        z = values[-1][..., 0]
        deltas[last][..., 0] = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - self.y) / self.n
        for k in range(last, -1, -1):
            np.matmul(values[k].swapaxes(1, 2), deltas[k], out=self.parts[k][0])
            np.add.reduce(deltas[k], axis=1, out=self.parts[k][1])
            if k:
                slope = np.square(values[k], out=self.slopes[self.layers[k][0].shape[1]])
                np.subtract(1, slope, out=slope)
                np.matmul(deltas[k], self.layers[k][0].swapaxes(1, 2), out=deltas[k - 1])
                deltas[k - 1] *= slope
        self.out += self.penalties * self.flat / self.n
        return self.out

    def losses(self) -> np.ndarray:
        """Mean log loss of each batch with the penalty on weights, at the weights of the last gradient; ask before these change."""
        z = self.values[-1][..., 0]
        weights = sum((w * w).sum(axis=(1, 2)) for w, _ in self.layers)
        return np.mean(np.logaddexp(0, z) - self.y * z, axis=1) + 0.5 * self.penalty * weights / self.n


def gradient(flat: np.ndarray, sizes, x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean log loss of a batch with the penalty on weights, and its gradient."""
    batch = _Batch(flat[None], sizes, len(y), penalty)
    batch.take(x, y, np.arange(len(y))[None])
    found = batch.gradient()[0]
    return float(batch.losses()[0]), found


def _epochs(
    states: np.ndarray, before: list[int], sizes, x: np.ndarray, y: np.ndarray, rows: list[np.ndarray], settings: Settings, epochs: int, seed
) -> tuple[np.ndarray, np.ndarray]:
    """Adam's steps over shuffled batches of a shard, of several nets at once.

    Of each net: its state (weights and both moments), its steps so far and the
    places of its rows.  Returns the states and the losses summed over the last epoch.
    """
    flat, m, v = (np.ascontiguousarray(s) for s in states.swapaxes(0, 1))
    size = settings.batch
    draws = [np.random.default_rng(seed) for _ in rows]
    steps = np.array(before, float)
    whole = min(len(r) for r in rows) // size  # batches that all nets have
    alone = [(j, low, low + size) for j, r in enumerate(rows) for low in range(whole * size, len(r), size)]
    turns = [(slice(None), k * size, (k + 1) * size) for k in range(whole)]
    turns += [(slice(j, j + 1), low, high) for j, low, high in alone]
    batches: dict[tuple, _Batch] = {}
    loss = np.zeros(len(rows))
    for epoch in range(epochs):
        order = [r[d.permutation(len(r))] for r, d in zip(rows, draws)]
        loss[:] = 0
        for own, low, high in turns:
            at = np.stack([o[low:high] for o in order[own]])
            key = (own.start, at.shape[1])
            if key not in batches:
                batches[key] = _Batch(flat[own], sizes, at.shape[1], settings.penalty)
            batch = batches[key]
            batch.take(x, y, at)
            g = batch.gradient()
            if epoch == epochs - 1:
                loss[own] += batch.losses() * at.shape[1]
            steps[own] += 1
            rates = np.array([settings.rate * np.sqrt(1 - SECOND**s) / (1 - FIRST**s) for s in steps[own].tolist()])[:, None]
            m[own] *= FIRST
            m[own] += (1 - FIRST) * g
            v[own] *= SECOND
            v[own] += (1 - SECOND) * g * g
            flat[own] -= rates * m[own] / (np.sqrt(v[own]) + GUARD)
    return np.stack([flat, m, v], axis=1), loss


@dataclass
class TanhNet:
    """A fitted net: scaling of its features, and weights."""

    features: list[str]
    center: np.ndarray
    width: np.ndarray
    hidden: tuple[int, ...]
    flat: np.ndarray
    losses: list[float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` and hard ``prediction``; a missing feature counts as its mean."""
        names = [f"f{k}" for k in range(len(self.features))]
        held = rows.select(F.struct(*rows.columns).alias("row"), *_doubles(self.features))
        center, width, flat = self.center, self.width, self.flat
        sizes = shapes(len(names), self.hidden)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layers = split(flat, sizes)
            for batch in batches:
                x = _scaled(batch, 1, len(names), center, width)
                z = forward(layers, x)[-1][:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["row", "score"])

        kind = held.schema["row"].dataType.simpleString()
        out = held.mapInArrow(run, f"row {kind}, score double")
        return out.select("row.*", "score").withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def scores(nets: list[TanhNet], rows: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of ``rows`` and ``scores``, one for each of ``nets``, which share features and scaling: one pass."""
    features, center, width = nets[0].features, nets[0].center, nets[0].width
    sizes = shapes(len(features), nets[0].hidden)
    flats = [net.flat for net in nets]
    held = rows.select(F.struct(*kept).alias("row"), *_doubles(features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = [split(flat, sizes) for flat in flats]
        for batch in batches:
            x = _scaled(batch, 1, len(features), center, width)
            z = np.column_stack([forward(own, x)[-1][:, 0] for own in layers])
            found = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(flats)), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "scores"])

    kind = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(run, f"row {kind}, scores array<double>").select("row.*", "scores")


def _doubles(features: list[str]) -> list[Column]:
    return [F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]


def _scaled(batch: pa.RecordBatch, first: int, many: int, center: np.ndarray, width: np.ndarray) -> np.ndarray:
    x = np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(many)])
    return np.nan_to_num((x - center) / width)


def scaling(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature; a constant one has deviation 1."""
    means = [F.avg(F.col(f).cast("double")).alias(f"m{k}") for k, f in enumerate(features)]
    widths = [F.stddev_pop(F.col(f).cast("double")).alias(f"s{k}") for k, f in enumerate(features)]
    found = rows.agg(*means, *widths).first()
    center = np.array([found[f"m{k}"] or 0.0 for k in range(len(features))])
    width = np.array([found[f"s{k}"] or 1.0 for k in range(len(features))])
    return center, width


def fit(
    train: DataFrame, features: list[str], settings: Settings = Settings(), key: str = "loan_id", fold: str | None = None, folds: int = 0
) -> list[TanhNet]:
    """One net, or with ``fold`` a net for each of ``folds`` that learns from the rows of the others.

    ``train`` has ``key``, ``label`` (0 or 1) and the ``features``.  Training
    ends after ``epochs``, or when no net's loss has fallen by ``tolerance``
    for ``patience`` epochs.  Equal rows in equal numbers give equal nets,
    however the table is partitioned.
    """
    known = train.filter(F.col("label").isNotNull())
    nets = list(range(folds)) if fold else [-1]
    own_fold = F.col(fold).cast("int") if fold else F.lit(-2)
    total = known.count()
    shards = max(1, -(-total // SHARD))
    center, width = scaling(known, features)
    rows = known.select(
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(key, F.lit(settings.seed)).alias("place"),
        own_fold.alias("fold"), F.col("label").cast("double").alias("label"), *_doubles(features),
    )
    rows = materialized(_packed(rows, shards, center, width))
    sizes = shapes(len(features), settings.hidden)
    states = {j: np.stack([initial(sizes, settings.seed), *np.zeros((2, sum(a * b + b for a, b in sizes)))]) for j in nets}
    losses: dict[int, list[float]] = {j: [] for j in nets}
    steps_before = dict.fromkeys(nets, 0)
    done = 0
    while done < settings.epochs and not all(_settled(x, settings) for x in losses.values()):
        epochs = min(EPOCHS, settings.epochs - done)
        found = _pass(rows, shards, states, steps_before, sizes, settings, epochs, done)
        for j, (state, loss, steps) in found.items():
            states[j] = state
            losses[j].append(loss)
            steps_before[j] += steps
        done += epochs
    return [TanhNet(features, center, width, settings.hidden, states[j][0], losses[j]) for j in nets]


def _settled(losses: list[float], settings: Settings) -> bool:
    waits = max(1, settings.patience // EPOCHS)
    return len(losses) > waits and min(losses[-waits:]) > min(losses[:-waits]) - settings.tolerance


def _packed(rows: DataFrame, shards: int, center: np.ndarray, width: np.ndarray) -> DataFrame:
    """``(shard, x, y, fold)``: each shard's rows in order, scaled, as arrays of up to ``PACK`` rows.

    Every shard has a partition of its own: dealt by a hash, some would share a
    partition, and its task would be the longest.
    """
    many = len(center)
    names = [f"f{k}" for k in range(many)]
    placed = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "label", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fold = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            x, y = _scaled(batch, 4, many, center, width), batch.column(3).to_numpy()
            for begin, end in _runs(own):
                for low in range(begin, end, PACK):
                    at = slice(low, min(end, low + PACK))
                    arrays = [pa.array([c[at].tobytes()], pa.binary()) for c in (x, y, fold)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(own[low])], pa.int32()), *arrays], ["shard", "x", "y", "fold"])

    return placed.mapInArrow(run, "shard int, x binary, y binary, fold binary")


def _groups(nets: list[int], shards: int, cores: int) -> list[list[int]]:
    """The nets that learn together: all of them, or fewer where there are fewer shards than keep the cores busy."""
    many = min(len(nets), max(1, -(-TASKS * cores // shards)))
    return [nets[k::many] for k in range(many)]


def _pass(rows: DataFrame, shards: int, states, before, sizes, settings: Settings, epochs: int, done: int) -> dict:
    """Of each net the state averaged over the shards, the mean loss and the most steps of a shard."""
    many = sizes[0][0]

    def learning(nets: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def learn(shard: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
                x, y, fold = (np.concatenate([np.frombuffer(b) for b in p]) for p in zip(*parts))
                own = {j: at for j in nets if len(at := np.flatnonzero(fold != j))}
                if not own:
                    return
                found, losses = _epochs(
                    np.stack([states[j] for j in own]), [before[j] for j in own], sizes, x.reshape(-1, many), y, list(own.values()),
                    settings, epochs, (settings.seed, shard, done),
                )
                for (j, at), new, loss in zip(own.items(), found, losses):
                    steps = epochs * -(-len(at) // settings.batch)
                    one = np.concatenate([new.ravel() * len(at), [loss, len(at), steps]])
                    k = np.arange(len(one))
                    columns = [np.full(len(k), j), k, np.full(len(k), shard), one]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["net", "k", "shard", "x"])

            shard, parts = None, []
            for batch in batches:  # sorted by shard
                for own, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                    if own != shard:
                        if parts:
                            yield from learn(shard, parts)
                        shard, parts = own, []
                    parts.append(arrays)
            if parts:
                yield from learn(shard, parts)

        return run

    groups = _groups(list(states), shards, rows.sparkSession.sparkContext.defaultParallelism)
    part = reduce(DataFrame.unionByName, [rows.mapInArrow(learning(g), "net long, k long, shard long, x double") for g in groups])
    found: dict[int, dict[int, tuple[float, float]]] = {}
    # added up in the order of the shards, as training carries the last bit of a sum far
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("shard", "x"))), lambda s: s["x"])
    total = F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x)
    for r in part.groupBy("net", "k").agg(total.alias("x"), F.max("x").alias("most")).collect():  # the nets' own size
        found.setdefault(r.net, {})[r.k] = (r.x, r.most)
    out = {}
    for j, values in found.items():
        x = np.array([values[k][0] for k in range(len(values))])
        n = x[-2]
        out[j] = (x[:-3].reshape(3, -1) / n, x[-3] / n, int(values[len(values) - 1][1]))
    return out


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    at = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else [0]
    return list(zip(at[:-1], at[1:]))
