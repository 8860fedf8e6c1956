"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts gives the features that tell the classes
apart (words and their beginnings) and the examples.  Every text is one pass
over an automaton of the features; their inverse document frequencies come from
all texts.  The examples stand in an inverted index with block maxima, which
finds the nearest ones by exact TF-IDF cosine: blocks are visited in the order
of their upper bounds until no block can hold a nearer example.  Votes weighted
by distance are calibrated on the examples, each left out of its own vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch, id_remainder, saved

#: Labelled texts that are learnt from, per class at most.
EXAMPLES = 4096
#: Features that are kept, and the least labelled texts that hold one.
FEATURES, LEAST = 4096, 4
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)
#: Neighbours that vote, examples per block of the index, and how votes sharpen with similarity.
NEIGHBOURS, BLOCK, SHARPNESS = 15, 64, 4.0
#: Queries answered together, and room for the error of single precision.
QUERIES, SLACK = 1024, 1e-5


def features_of(text: str) -> set[str]:
    """Words as ``" word "`` and their beginnings as ``" wor"``, lowered; a word is a run of letters or digits."""
    words = {w for w in _spaced(text).split(" ") if w}
    out = {f" {w} " for w in words}
    for n in BEGINNINGS:
        out |= {" " + w[:n] for w in words if len(w) > n}
    return out


_BETWEEN = re.compile(r"[\W_]+")


def _spaced(text: str) -> str:
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


def choose_features(docs: DataFrame, positives: int, negatives: int) -> list[str]:
    """The features with the largest chi-square between the classes.  ``docs``: ``(text, toxic)``, bounded."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts = (Counter(), Counter())
        for text, toxic in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            counts[toxic].update(features_of(text or ""))
        names = sorted(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()),
             pa.array([counts[0][x] for x in names], pa.int64())],
            ["feature", "p", "n"],
        )

    p, n = F.col("p"), F.col("n")
    total = float(positives + negatives)
    expected = (p + n) * (positives / total)
    spread = (p + n) * (positives / total) * (negatives / total) * (1 - (p + n) / (total + 1))
    counted = (
        by_batch(docs.select("text", F.col("toxic").cast("int")), batch, "feature string, p long, n long")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        .filter(p + n >= LEAST)
        .withColumn("chi", (p - expected) * (p - expected) / spread)
        .filter("chi > 10.83")  # one in a thousand by chance
    )
    return sorted(r.feature for r in counted.orderBy(F.desc("chi"), "feature").limit(FEATURES).collect())


class Matcher:
    """Counts the chosen features of a text in one pass."""

    def __init__(self, features: list[str]):
        self.machine = ahocorasick.Automaton()
        for k, x in enumerate(features):
            self.machine.add_word(x, k)
        if features:
            self.machine.make_automaton()
        self.any = bool(features)

    def counts(self, text: str) -> Counter:
        if not self.any or not text:
            return Counter()
        spaced = _spaced(text)
        # a beginning that is the whole word is the word's own feature
        return Counter(k for _, k in self.machine.iter(spaced))


class Index:
    """Examples by feature, in blocks with the largest weight of each feature in each block.

    A block's postings are a small dense table of features by examples, so that
    all queries that visit it are answered by one product.
    """

    def __init__(self, vectors: list[dict[int, float]], labels: np.ndarray, size: int):
        # alike examples into the same blocks: by their heaviest feature
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i].items(), key=lambda x: (x[1], -x[0]), default=(-1, 0))[0], i))
        self.example, self.labels = np.array(order, np.int64), labels[order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        self.weights = np.zeros((self.blocks, size, BLOCK), np.float32)
        for at, i in enumerate(order):
            for f, w in vectors[i].items():
                self.weights[at // BLOCK, f, at % BLOCK] = w
        self.most = np.ascontiguousarray(self.weights.max(axis=2).T) if size else np.zeros((0, self.blocks), np.float32)

    def nearest(self, queries: list[dict[int, float]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the places and cosines of the ``k`` nearest examples with a cosine above 0, ties by place.

        ``without``: an example that a query must not find.  Each query visits
        its blocks in runs that double, those with the largest bounds first,
        until no block left can hold a nearer example.  Products are taken in
        single precision with room for their error; what may be among the
        nearest is compared by cosines in double precision.
        """
        out = []
        for low in range(0, len(queries), QUERIES):
            out += self._nearest(queries[low : low + QUERIES], k, None if without is None else without[low : low + QUERIES])
        return out

    def _nearest(self, queries, k, without):
        many = len(queries)
        table = np.zeros((many, self.most.shape[0]), np.float32)
        for row, q in zip(table, queries):
            row[list(q.keys())] = list(q.values())
        bound = (table @ self.most) * (1 + SLACK) + SLACK
        order = np.argsort(-bound, axis=1, kind="stable")
        # cosines so far; a query's own example and places beyond the last stay out
        cosines = np.zeros((many, self.blocks * BLOCK), np.float32)
        worst = np.zeros(many, np.float32)
        at, run = 0, 4
        while at < self.blocks:
            asked = np.zeros((many, self.blocks), bool)
            np.put_along_axis(asked, order[:, at : at + run], True, axis=1)
            asked &= (bound > SLACK) & (bound >= worst[:, None] - SLACK)
            if not asked.any():
                break
            for b in np.flatnonzero(asked.any(axis=0)).tolist():
                who = np.flatnonzero(asked[:, b])
                if 2 * len(who) > many:  # the product for all costs less than to gather most
                    who = slice(None)
                cosines[who, b * BLOCK : (b + 1) * BLOCK] = table[who] @ self.weights[b]
            if without is not None:
                cosines[self.example_at(without)] = 0
            if cosines.shape[1] > k:
                worst = np.partition(cosines, -k, axis=1)[:, -k]
            at, run = at + run, run * 2
        return [self._exact(q, np.flatnonzero((c > 0) & (c >= w - SLACK)), k) for q, c, w in zip(queries, cosines, worst)]

    def example_at(self, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.empty(len(self.example), np.int64)
        place[self.example] = np.arange(len(self.example))
        return np.arange(len(without)), place[without]

    def _exact(self, query: dict[int, float], places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        features = np.fromiter(query.keys(), np.int64, len(query))
        held = self.weights[places[:, None] // BLOCK, features, places[:, None] % BLOCK].astype(np.float64)
        cosines = held @ np.fromiter(query.values(), np.float64, len(query))
        best = np.lexsort((places, -cosines))[:k]
        return places[best], cosines[best]


class Model:
    """``inputs``: (counts of features, label, weight) of each example; ``idf``: per feature."""

    def __init__(self, features: list[str], idf: np.ndarray, examples: list[Counter], labels: np.ndarray, prior: float, weights: np.ndarray):
        self.features, self.idf, self.prior = features, idf, prior
        vectors = [self.vector(x) for x in examples]
        self.index = Index(vectors, labels, len(features))
        self.line = (0.0, 1.0)
        raw = [self.vote(*x) for x in self.index.nearest(vectors, NEIGHBOURS, np.arange(len(vectors)))]
        self.line = _fitted(np.array(raw), labels, weights)

    def vector(self, counts: Counter) -> dict[int, float]:
        out = {f: (1 + math.log(c)) * self.idf[f] for f, c in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in out.values()))
        return {f: w / norm for f, w in out.items()} if norm else {}

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the weighted votes; the prior stands for one vote, and alone without neighbours."""
        weight = cosines**SHARPNESS
        toxic = float((weight * self.index.labels[places]).sum()) + self.prior
        clean = float((weight * (1 - self.index.labels[places])).sum()) + 1 - self.prior
        return math.log(toxic / clean)

    def score(self, texts: list[Counter]) -> list[tuple[float, list[int], list[float]]]:
        """Of each text: score, nearest examples and cosines; equal counts are looked up once."""
        keys = [tuple(sorted(x.items())) for x in texts]
        different = list(dict.fromkeys(keys))
        found = self.index.nearest([self.vector(dict(x)) for x in different], NEIGHBOURS)
        a, b = self.line
        seen = {}
        for key, (places, cosines) in zip(different, found):
            score = 1 / (1 + math.exp(-(a + b * self.vote(places, cosines))))
            seen[key] = score, self.index.example[places].tolist(), cosines.tolist()
        return [seen[x] for x in keys]


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic line by Newton's steps, slightly held back so that separable votes stay finite."""
    a, b, held = 0.0, 1.0, 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        error, curve = weight * (y - p), weight * p * (1 - p)
        ga, gb = error.sum() - held * a, (error * x).sum() - held * (b - 1)
        aa, ab, bb = curve.sum() + held, (curve * x).sum(), (curve * x * x).sum() + held
        det = aa * bb - ab * ab
        da, db = (ga * bb - gb * ab) / det, (gb * aa - ga * ab) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a), float(b)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``(id, held_out, score, predicted, neighbours, similarities)`` for every row.

    Ids whose crc32 leaves 0 modulo 5 are held out: their labels are not learnt.
    ``neighbours`` are the ids of the nearest examples.  Null, empty and
    featureless texts get the score of no votes.  An id labelled twice is toxic
    if any label says so; null labels and ids teach nothing; without labels of
    both classes every score is the share of toxic labels (0 without any).
    Repeated rows give a row each; columns other than id and text are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    known = (
        labels.select(F.col("doc_id").alias("id"), "toxic")
        .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & (id_remainder(F.col("id")) != 0))
        .groupBy("id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    population = np.array([size.get(0, 0), size.get(1, 0)], float)
    prior = float(population[1] / max(1.0, population.sum()))
    held_out = (id_remainder(F.col("id")) == 0).alias("held_out")
    if not population.all():
        nothing = [F.array().cast(f"array<{kind}>").alias("neighbours"), F.array().cast("array<double>").alias("similarities")]
        return rows.select(
            F.col("id").alias(ident), held_out, F.lit(prior).alias("score"),
            F.lit(int(prior >= 0.5)).alias("predicted"), *nothing,
        )
    # the sample: of each class the ids of smallest hash, bounded by EXAMPLES
    drawn = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES) for c in (0, 1)]
    sample = saved(drawn[0].unionByName(drawn[1]))
    examples = saved(
        rows.join(F.broadcast(sample), "id")  # 2 * EXAMPLES ids at most
        .groupBy("id")
        .agg(F.min("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    drawn_of = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    features = choose_features(examples, drawn_of.get(1, 0), drawn_of.get(0, 0)) if len(drawn_of) == 2 else []

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = _kept("matcher", features, lambda: Matcher(features))
        found = [sorted(matcher.counts(x or "").items()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[k for k, _ in x] for x in found], pa.list_(pa.int32())),
             pa.array([[c for _, c in x] for x in found], pa.list_(pa.int32()))],
            ["id", "features", "counts"],
        )

    vectors = saved(by_batch(rows, counted, f"id {kind}, features array<int>, counts array<int>", text=1))

    def texts_with(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(features))
        some = np.flatnonzero(held)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["f", "n"])

    # how many of all texts hold each feature: FEATURES rows at most
    held = by_batch(vectors.select("features"), texts_with, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    total = vectors.count()
    idf = np.full(len(features), math.log(1 + total))
    for r in held:
        idf[r.f] = math.log((1 + total) / (1 + r.n)) + 1
    learnt = sorted(
        (r.id, r.toxic, tuple(r.features), tuple(r.counts))
        for r in vectors.join(F.broadcast(examples.select("id", "toxic")), "id").dropDuplicates(["id"]).collect()
    )
    ids = [r[0] for r in learnt]
    y = np.array([r[1] for r in learnt])
    drawn_counts = np.array([max(1, (y == c).sum()) for c in (0, 1)], float)
    weights = (population / drawn_counts)[y] / population.sum() * len(y)
    model = Model(features, idf, [Counter(dict(zip(r[2], r[3]))) for r in learnt], y, prior, weights)
    shared = docs.sparkSession.sparkContext.broadcast((model, ids))
    id_type = pa.list_(pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, names = shared.value
        out = own.score([Counter(dict(zip(f, c))) for f, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.float64()),
             pa.array([[names[i] for i in x[1]] for x in out], id_type),
             pa.array([x[2] for x in out], pa.list_(pa.float64()))],
            ["id", "score", "neighbours", "similarities"],
        )

    result = by_batch(vectors, scored, f"id {kind}, score double, neighbours array<{kind}>, similarities array<double>")
    return result.select(
        F.col("id").alias(ident), held_out, "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarities",
    )


_kept_by: dict[str, tuple] = {}


def _kept(name: str, key: list[str], make):
    """What ``make`` gives, made once per worker for the same key."""
    if name not in _kept_by or _kept_by[name][0] != key:
        _kept_by[name] = (key, make())
    return _kept_by[name][1]
