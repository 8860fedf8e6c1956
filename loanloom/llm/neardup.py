"""Near duplicates by HyperMinHash registers.

Every text gets a sketch: its shingle hashes are dealt to buckets, and each
bucket keeps the number of leading zeros of its smallest hash and a few
mantissa bits after them.  Bands of registers bring similar texts together.
Within a band's bucket the Jaccard similarity is estimated from the registers,
corrected for registers that agree by chance; what may reach the threshold
forms clusters.  Within a cluster all pairs are confirmed on the full sets.

Copies with one and the same set are one node from the start.  Buckets and
clusters are cut into blocks, and every pair of blocks is one row of work:
no pair of texts is written, only the links that hold a block together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import (
    by_batch,
    components,
    discard,
    finished,
    fresh,
    membership,
    mixed,
    perhaps,
    saved,
    shingle_hashes,
    taken,
    utf8,
)

#: Registers, of which the bands use as many as they fill.
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
#: A register: 6 bits of leading zeros and this many mantissa bits.
MANTISSA = 10
#: A pair of similarity 0.85 shares no band with a probability below one in a million.
ROWS, BANDS = 5, 25
#: Members of a block; a row of work holds two blocks at most.
BLOCK = 256
#: Deviations of the estimate within which a pair is still looked at.
DEVIATIONS = 4.0


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of a text's sorted distinct hashes; an empty bucket borrows from a hashed other one."""
    h = np.sort(mixed(shingles))
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = h[first] << np.uint64(BUCKET_BITS)
    out = np.zeros(BUCKETS, np.uint16)
    filled = np.zeros(BUCKETS, bool)
    # frexp finds the highest set bit; the bits after it are the mantissa
    zeros = np.full(len(rest), 63, np.int64)
    some = rest > 0
    high = rest[some]
    exponent = np.frexp((high >> np.uint64(11)).astype(np.float64))[1]
    zeros[some] = np.minimum(63, 53 - exponent)
    mantissa = np.zeros(len(rest), np.int64)
    after = (high << (zeros[some] + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    mantissa[some] = after.astype(np.int64)
    out[bucket[first]] = (zeros << MANTISSA) | mantissa
    filled[bucket[first]] = True
    if len(first) < BUCKETS:
        source = np.arange(BUCKETS)
        empty, attempt = np.flatnonzero(~filled), 0
        while len(empty):
            attempt += 1
            pick = mixed(empty.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt * 0x9E3779B1)) & np.uint64(BUCKETS - 1)
            good = filled[pick.astype(np.int64)]
            source[empty[good]] = pick[good].astype(np.int64)
            empty = empty[~good]
        out = out[source]
    return out


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates of ``one`` against each row of ``others``.

    Two unrelated registers agree if their zeros (at 2**-(2z) each) and their
    mantissas do: about once in 3 * 2**MANTISSA.
    """
    agree = (others == one).mean(axis=1)
    chance = 1.0 / (3 << MANTISSA)
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def slack(similarity: float) -> float:
    return DEVIATIONS * (similarity * (1 - similarity) / BUCKETS) ** 0.5


class Forest:
    """Links that join what is not yet joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    forest = Forest(n)
    return [(i, j) for i, j in zip(left.tolist(), right.tolist()) if forest.join(i, j)]


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(n_shingles, node, sketch)`` beside the columns of ``docs`` other than its text.

    ``node`` is a 64-bit digest of the set, null for a text without words.
    """
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_shingles long, node long, sketch binary"])

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        count, node, sketch = [], [], []
        for x in utf8(rows.column(len(keep))):
            s = shingle_hashes(x)
            count.append(len(s))
            node.append(int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True) if len(s) else None)
            sketch.append(registers(s).tobytes() if len(s) else None)
        new = [pa.array(count, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())]
        return pa.RecordBatch.from_arrays(
            [*rows.columns[: len(keep)], *new], [*(f.name for f in keep), "n_shingles", "node", "sketch"]
        )

    return by_batch(docs.select(*[F.col(f.name) for f in keep], F.col(text).cast("string")), batch, schema)


def _blocks(members: DataFrame, sizes: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """``(group, members)`` rows of work: all members of small groups, else each pair of blocks.

    ``sizes`` is ``(group, n)``.  A member of a large group goes to one row per
    pair that its block is in.
    """
    many = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("node"), many)
    pairs: Column = F.when(many == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0).cast("long"), many - 1), lambda k: k != own),
            lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")),
        )
    )
    return (
        members.join(sizes, group)
        .select(group, "node", *payload, F.explode(pairs).alias("pair"))
        .groupBy(group, "pair")
        .agg(F.collect_list(F.struct("node", *payload)).alias("members"))  # two blocks at most
        .select("members")
    )


def candidate_clusters(nodes: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of nodes whose registers may reach ``similarity``, chained.  ``nodes``: node, n_shingles, sketch."""

    def keys(rows: pa.RecordBatch) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
        node = np.repeat(rows.column(0).to_numpy(), BANDS)
        band = np.ascontiguousarray(data[:, : ROWS * BANDS].reshape(len(data) * BANDS, ROWS))
        key = [xxhash.xxh3_64_intdigest(x.tobytes(), seed=k % BANDS) >> 1 for k, x in enumerate(band)]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node)], ["key", "node"])

    banded = saved(by_batch(nodes.select("node", "sketch"), keys, "key long, node long"))
    groups = (
        banded.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"),
             F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"))
        .filter("n > 1")
    )
    # bands with the same members are looked at once
    groups = saved(groups.groupBy("n", "low", "high", "members").agg(F.min("key").alias("key")))
    pairs = groups.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    large = groups.filter("n > 2").select("key", "n")
    members = banded.join(large.select("key"), "key").join(nodes.select("node", "sketch", "n_shingles"), "node")
    work = _blocks(members, large, "key", ["sketch", "n_shingles"])
    least = similarity - slack(similarity)

    def linked(rows: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for one in rows.column(0).to_pylist():
            node = [m["node"] for m in one]
            size = np.array([m["n_shingles"] for m in one], float)
            data = np.frombuffer(b"".join(m["sketch"] for m in one), np.uint16).reshape(-1, BUCKETS)
            forest = Forest(len(node))
            for i in range(len(node) - 1):
                near = estimate(data[i], data[i + 1 :]) >= least
                near &= np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :])
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    if forest.join(i, j):
                        a.append(node[i])
                        b.append(node[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = saved(components(pairs.unionByName(by_batch(work, linked, "a long, b long"))))
    discard(banded, groups)
    return out


def exact_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``i < j`` with ``100 * intersection >= percent * union``, by counting shared shingles."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at) > 1  # what one set alone has is in no intersection
    column = np.cumsum(shared) - 1
    held = shared[at]
    row, col = owner[held], column[at[held]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for low in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(col, [low, low + 8192])
        if hi > lo:
            hit = np.zeros((len(sets), min(8192, int(col[hi - 1]) - low + 1)), np.float32)
            hit[row[lo:hi], col[lo:hi] - low] = 1
            both += hit @ hit.T
    inter = np.rint(both).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    return np.nonzero(np.triu(100 * inter >= percent * union, 1))


def _linked(docs: DataFrame, percent: int, text: str, ident: str) -> DataFrame:
    """``(id, digest, n_shingles, node, root, component_id)`` for every row; ``digest`` is of the text."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(body).alias("digest"), body.alias("text"))
    sketched = saved(sketches(rows))
    nodes = saved(
        sketched.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("id").alias("least"), F.min(F.xxhash64("id", "digest")).alias("row"),
             F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    )
    clusters = candidate_clusters(nodes.select("node", "n_shingles", "sketch"), percent / 100)

    # the full sets of the texts in clusters, of one row for each node
    chosen = clusters.join(nodes.select("node", "row"), "node").select("node", "root", "row")

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, out = [], []
        for x in utf8(batch.column(1)):
            s = shingle_hashes(x).tobytes()
            out.append(s)
            node.append(int.from_bytes(xxhash.xxh3_64_digest(s), "big", signed=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["row", "node", "shingles"]
        )

    keyed = rows.filter("text IS NOT NULL").select(F.xxhash64("id", "digest").alias("row"), "text")
    texts = perhaps(keyed, "row", membership(chosen.select("row")))
    sets = by_batch(texts, full, "row long, node long, shingles binary").join(chosen, ["row", "node"])
    sets = saved(sets.dropDuplicates(["node"]).select("node", "root", "shingles"))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    work = _blocks(sets, sizes, "root", ["shingles"])

    def confirmed(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for one in batch.column(0).to_pylist():
            node = [m["node"] for m in one]
            i, j = exact_links([np.frombuffer(m["shingles"], np.uint64) for m in one], percent)
            for x, y in _spanning(i, j, len(node)):
                a.append(node[x])
                b.append(node[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    roots = components(by_batch(work, confirmed, "a long, b long"))
    owner = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    found = owner.join(least, "root").select("node", "root", "component_id")
    return sketched.drop("sketch").join(found, "node", "left")


def link_near_duplicates(
    docs: DataFrame, percent: int = 85, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Texts without words (null, empty, white space) have no shingles, are linked
    with nothing and are their own component.  ``component_id`` is the smallest
    id of the component; a null id is never the smallest, and a row with a null
    id among nothing else has a null component and is kept.  Repeated rows give
    a row each.  Other columns are not read.
    """
    out = _linked(docs, percent, text, ident)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(ident),
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 85, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest id, with its columns.

    Of repeated rows one stays, as of rows of different texts that share the
    smallest id.  Rows whose text has no words (null, empty, white space) all
    stay.  A null id is larger than any.  Whole texts are compared, however
    long; columns of any name are handed through.
    """
    body = F.col(text).cast("string")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("digest").alias("digest")))
    taken()  # tables of others stay
    linked = finished(_linked(docs, percent, text, ident).filter("node IS NOT NULL").select("id", "digest", "root"))
    stays = linked.groupBy("root").agg(first.alias("f")).select(F.col("f.id").alias("id"), F.col("f.digest").alias("digest"))
    row = fresh(docs, "row")
    key = lambda i, d: F.xxhash64(i, d).alias(row)
    counted = linked.select(key("id", "digest")).groupBy(row).agg(F.count("*").alias("n"))
    staying = stays.select(key("id", "digest"))
    leaving = counted.join(staying.withColumn("stays", F.lit(True)), row, "left").filter("stays IS NULL OR n > 1")
    marked = docs.withColumn(row, F.xxhash64(F.col(ident), F.xxhash64(body)))
    doubtful = membership(leaving.select(row))
    # most rows stay and need no exchange; the others are looked up
    sure = perhaps(marked, row, doubtful, inside=False)
    wordless = F.coalesce(F.btrim(body, F.lit(" \t\n\x0b\x0c\r")) == "", F.lit(True))
    looked_up = perhaps(marked, row, doubtful)
    found = looked_up.filter(~wordless).join(saved(staying), row, "left_semi").dropDuplicates([row])
    return sure.unionByName(found).unionByName(looked_up.filter(wordless)).select(*docs.columns)
