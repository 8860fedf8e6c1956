"""Near-duplicate vectors by NN-descent.

A neighbour graph begins with the best neighbours inside buckets of random
hyperplanes and is refined: the neighbours of each vector, in both directions,
are compared with each other, and better neighbours replace worse.  A list
that holds nothing below the threshold is saturated and doubles its length.
Edges above the threshold join vectors into components.  Where lists were ever
saturated a link may have found no room, so components with such lists are
compared with each other: centre with centre, and where threshold and radii let
them meet, member with member.  Inside a component every pair is compared in
double precision, block by block.  The A
bounded number of vectors, some drawn from all and some from those that have
links, are compared with all others to audit the recall.  The refinement goes on until the recall is good
enough; if it does not get there, all pairs are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch, components, saved
from loanloom.llm.neardup import _spanning

#: Length of a neighbour list, and how far a saturated one grows; beyond that :func:`merged` finds the links.
NEIGHBOURS, MOST_NEIGHBOURS = 8, 32
#: Edges that a neighbourhood gives a member in any case, and what single precision may be off by.
FEW, SLACK = 4, 1e-4
#: Hyperplane tables at least, vectors of a bucket on average, and of a block at most.
TABLES, BUCKET, BLOCK = 6, 64, 512
#: Share of the pairs at the threshold that shall share a first bucket: tables are added until they do.
SHARED = 0.9
#: Refinements before the first audit, and in all.
ROUNDS, MOST_ROUNDS = 2, 8
#: The audit draws from all vectors and from those with links, so many of each at most; the recall that it asks for.
AUDITED, RECALL = 2048, 0.99
SEED = 20_240_611


def _rows(names: str, types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names.split())


L, D, B = pa.int64(), pa.float64(), pa.binary()


def unit_vectors(vectors: DataFrame, ident: str, embedding: str) -> DataFrame:
    """``(id, node, vector)``: unit length in double precision; both null where there is no direction."""
    kind = vectors.schema[ident].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        node, vector = [], []
        for x in rows.column(1).to_pylist():
            v = np.array([np.nan] if not x or None in x else x, np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                v = v / (np.abs(v).max() or 1)  # large components must not overflow
                norm = np.sqrt(v @ v)
            if np.isfinite(norm) and norm > 0:
                raw = (v / norm).tobytes()
                node.append(xxhash.xxh3_64_intdigest(raw) >> 1)
                vector.append(raw)
            else:
                node.append(None)
                vector.append(None)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(node, L), pa.array(vector, B)], ["id", "node", "vector"])

    chosen = vectors.select(F.col(ident).alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return by_batch(chosen, batch, f"id {kind}, node long, vector binary")


def _matrix(members: list[dict], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(m["vector"] for m in members), np.float64).reshape(len(members), -1).astype(dtype)


def _best(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row of ``x`` its ``most`` nearest other rows: row, other, cosine."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    most = min(most, len(x) - 1)
    other = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most else np.empty((len(x), 0), np.int64)
    row = np.repeat(np.arange(len(x)), most)
    other = other.ravel()
    return row, other, sims[row, other].astype(np.float64)


def tables(bits: int, threshold: float) -> int:
    """How many tables of ``bits`` hyperplanes let a pair at the threshold share a bucket with probability SHARED."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return TABLES if same == 1 else max(TABLES, int(np.ceil(np.log(1 - SHARED) / np.log1p(-same))))


def first_graph(nodes: DataFrame, total: int, threshold: float) -> DataFrame:
    """Edges ``(a, b, cosine)`` to the best vectors in the same bucket of each table."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / BUCKET))))
    many = tables(bits, threshold)

    def buckets(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        planes: dict[int, np.ndarray] = {}
        by_size: dict[int, list[int]] = {}
        raw, node = rows.column(1).to_pylist(), rows.column(0).to_pylist()
        for i, v in enumerate(raw):
            by_size.setdefault(len(v), []).append(i)
        for size, at in by_size.items():
            if size not in planes:
                planes[size] = np.random.default_rng(SEED).standard_normal((size // 8, many * bits))
            x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
            sign = (x @ planes[size] > 0).reshape(len(at), many, bits)
            code = (sign * (1 << np.arange(bits))).sum(axis=2) if bits else np.zeros((len(at), many), np.int64)
            for t in range(many):
                out[0].extend([f"{t}/{size}/{c}" for c in code[:, t].tolist()])
                out[1].extend(node[i] for i in at)
                out[2].extend(raw[i] for i in at)
        return _rows("bucket node vector", [pa.string(), L, B], list(out))

    placed = saved(by_batch(nodes.select("node", "vector"), buckets, "bucket string, node long, vector binary"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    # a crowded bucket is dealt to blocks; the refinement joins them again
    work = (
        placed.join(sizes, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / BLOCK)))
        .groupBy("bucket", "block")
        .agg(F.collect_list(F.struct("node", "vector")).alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )

    def near(rows: pa.RecordBatch) -> pa.RecordBatch:
        a, b, c = [], [], []
        for members in rows.column(0).to_pylist():
            node = np.array([m["node"] for m in members])
            row, other, sims = _best(_matrix(members, np.float32), NEIGHBOURS)
            a += node[row].tolist()
            b += node[other].tolist()
            c += sims.tolist()
        return _rows("a b cosine", [L, L, D], [a, b, c])

    return by_batch(work, near, "a long, b long, cosine double")


def _lists(edges: DataFrame, lengths: DataFrame | None, threshold: float) -> DataFrame:
    """The best edges of each vector: ``(a, b, cosine, length)``, a saturated list doubled."""
    both = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    both = both.join(lengths, "a", "left").fillna(NEIGHBOURS, ["length"]) if lengths is not None else both.withColumn("length", F.lit(NEIGHBOURS))
    best = both.groupBy("a").agg(
        F.max("length").alias("length"),
        F.slice(F.sort_array(F.collect_list(F.struct("cosine", "b")), False), 1, MOST_NEIGHBOURS).alias("best"),
    )
    cut = best.select("a", "length", F.expr("slice(best, 1, length)").alias("best"))
    full = (F.size("best") >= F.col("length")) & (F.element_at("best", -1)["cosine"] >= threshold)
    longer = F.when(full, F.least(2 * F.col("length"), F.lit(MOST_NEIGHBOURS))).otherwise(F.col("length"))
    return cut.select("a", longer.alias("length"), F.inline("best"))


def refined(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """New edges found among the neighbours of each vector, in either direction.

    Each member of a neighbourhood gets its best few others there, and as many
    above the threshold as a list holds that was never saturated.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", F.lit(NEIGHBOURS).alias("length"))
    both = edges.select("a", "b", "cosine", "length").union(back)
    around = (
        both.groupBy("a")
        .agg(F.sort_array(F.collect_set(F.struct("cosine", "b")), False).alias("best"), F.max("length").alias("length"))
        .select("a", F.expr("slice(best, 1, 2 * length)").alias("best"))
        .select("a", F.explode(F.array_union("best.b", F.array("a"))).alias("node"))
    )
    work = (
        around.join(nodes.select("node", "vector"), "node")
        .groupBy("a")
        .agg(F.collect_list(F.struct("node", "vector")).alias("members"))  # 2 * MOST_NEIGHBOURS + 1 at most
        .filter(F.size("members") > 2)
        .select("members")
    )

    def near(rows: pa.RecordBatch) -> pa.RecordBatch:
        a, b, c = [], [], []
        for members in rows.column(0).to_pylist():
            node = np.array([m["node"] for m in members])
            row, other, sims = _best(_matrix(members, np.float32), NEIGHBOURS)
            each = sims.reshape(len(node), -1)
            few = min(FEW, each.shape[1])
            kept = (each >= np.minimum(-np.partition(-each, few - 1, axis=1)[:, few - 1 : few], threshold - SLACK)).ravel()
            a.append(node[row[kept]])
            b.append(node[other[kept]])
            c.append(sims[kept])
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return _rows("a b cosine", [L, L, D], [join(a, np.int64), join(b, np.int64), join(c, float)])

    return by_batch(work, near, "a long, b long, cosine double")


def _paired(many, own) -> Column:
    """All pairs of blocks ``(i, j)``, i up to j, that hold block ``own`` of ``many``."""
    return F.transform(
        F.sequence(F.lit(0).cast("long"), many - 1),
        lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")),
    )


def merged(clusters: DataFrame, full: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``clusters`` (node, root), where those joined by a link that no list had room for are one.

    A list never saturated has kept every link that was ever compared, so only
    clusters with nodes of ``full`` can hold such a link, both its ends in them.
    A cluster's centre is its smallest node, its radius the largest angle to a
    member; clusters farther apart than their radii and the threshold's angle
    share no link.  The others are compared exactly, block by block.
    """
    crowded = clusters.join(full, "node").select("root").distinct()
    members = saved(clusters.join(crowded, "root").join(nodes.select("node", "vector"), "node").select("root", "node", "vector"))
    centres = members.groupBy("root").agg(F.min(F.struct("node", "vector"))["vector"].alias("centre"), F.count("*").alias("n"))

    def angles(rows: pa.RecordBatch) -> pa.RecordBatch:
        cosine = [float(np.frombuffer(v) @ np.frombuffer(c)) for v, c in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())]
        return _rows("root angle", [L, D], [rows.column(0), np.arccos(np.clip(cosine, -1, 1))])

    centres = saved(centres)
    radii = by_batch(members.select("root", "vector").join(centres.select("root", "centre"), "root"), angles, "root long, angle double")
    centres = centres.join(radii.groupBy("root").agg(F.max("angle").alias("radius")), "root")
    many = max(1, -(-members.select("root").distinct().count() // BLOCK))
    own = F.pmod(F.xxhash64("root"), F.lit(many).cast("long"))
    work = (
        centres.select(
            F.length("centre").alias("size"), F.explode(_paired(F.lit(many).cast("long"), own)).alias("pair"),
            F.struct(F.col("root").alias("node"), F.col("centre").alias("vector"), "radius", "n", own.alias("block")).alias("member"),
        )
        .groupBy("size", "pair")
        .agg(F.collect_list("member").alias("members"))  # two blocks at most
        .select("pair", "members")
    )

    def within_reach(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for pair, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            x = _matrix(own, np.float64)
            radius, block = np.array([m["radius"] for m in own]), np.array([m["block"] for m in own])
            reach = np.arccos(threshold) + radius[:, None] + radius[None, :] + 1e-6
            meets = np.triu(np.arccos(np.clip(x @ x.T, -1, 1)) <= reach, 1)
            if pair["i"] != pair["j"]:
                meets &= block[:, None] != block[None, :]
            for i, j in zip(*(k.tolist() for k in np.nonzero(meets))):
                for column, value in zip(out, (own[i]["node"], own[j]["node"], -(-own[i]["n"] // BLOCK), -(-own[j]["n"] // BLOCK))):
                    column.append(value)
        return _rows("p q many_p many_q", [L, L, L, L], list(out))

    near = saved(by_batch(work, within_reach, "p long, q long, many_p long, many_q long"))

    def side(this: str, i: str, other: str, j: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col(f"many_{this}")).alias(i)
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"many_{other}") - 1)).alias(j)
        of = near.join(members.withColumnRenamed("root", this), this).select("p", "q", block, others, "vector")
        return of.select("p", "q", "i", "j", F.struct(F.lit(this).alias("of"), "vector").alias("member"))

    facing = (
        side("p", "i", "q", "j")
        .union(side("q", "j", "p", "i"))
        .groupBy("p", "q", "i", "j")
        .agg(F.collect_list("member").alias("members"))  # a block of each at most
        .select("p", "q", "members")
    )

    def meet(rows: pa.RecordBatch) -> pa.RecordBatch:
        hit = []
        for own in rows.column(2).to_pylist():
            x = [_matrix([m for m in own if m["of"] == of], np.float64) if any(m["of"] == of for m in own) else None for of in "pq"]
            hit.append(x[0] is not None and x[1] is not None and bool((x[0] @ x[1].T >= threshold).any()))
        return rows.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    links = saved(by_batch(facing, meet, "p long, q long").distinct())
    if links.isEmpty():
        return clusters
    roots = components(links, "p", "q").select(F.col("node").alias("root"), F.col("root").alias("to"))
    return saved(clusters.join(roots, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def exact_links(edges: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(node, n_links)`` and ``(node, root)`` from all pairs inside the components of ``edges``."""
    near = edges.filter(F.col("cosine") >= threshold - SLACK).select("a", "b")  # single precision so far
    full = edges.filter(F.col("length") > NEIGHBOURS).select(F.col("a").alias("node")).distinct()
    return links_inside(merged(saved(components(near)), full, nodes, threshold), nodes, threshold)


def links_inside(clusters: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(node, n_links)`` and ``(node, root)`` from all pairs inside the ``clusters`` (node, root)."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    many = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("node"), many)
    work = (
        clusters.join(sizes, "root")
        .join(nodes, "node")
        .select("root", "node", "vector", "copies", own.alias("block"), F.explode(_paired(many, own)).alias("pair"))
        .groupBy("root", "pair")
        .agg(F.collect_list(F.struct("node", "vector", "copies", "block")).alias("members"))  # two blocks at most
        .select("pair", "members")
    )

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        a, b, n = [], [], []
        for pair, members in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            x = _matrix(members, np.float64)
            close = x @ x.T >= threshold
            block = np.array([m["block"] for m in members])
            if pair["i"] != pair["j"]:
                close &= block[:, None] != block[None, :]
            np.fill_diagonal(close, False)
            node = [m["node"] for m in members]
            links = close @ np.array([m["copies"] for m in members], np.int64)
            at = np.flatnonzero(links).tolist()
            a += [node[i] for i in at]
            b += [None] * len(at)
            n += links[at].tolist()
            for i, j in _spanning(*np.nonzero(np.triu(close, 1)), len(node)):
                a.append(node[i])
                b.append(node[j])
                n.append(0)
        return _rows("a b n", [L, L, L], [a, b, n])

    found = saved(by_batch(work, compare, "a long, b long, n long"))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return saved(links), saved(components(found.filter("b IS NOT NULL").select("a", "b")))


def audit_queries(nodes: DataFrame, links: DataFrame) -> list[tuple[int, bytes]]:
    """At most ``AUDITED`` vectors of all, and as many of those that have links: those of least hash."""
    drawn = [
        part.orderBy(F.xxhash64("node"), "node").select("node", "vector").limit(AUDITED)
        for part in (nodes, nodes.join(links.filter("n_links > 0"), "node", "left_semi"))
    ]
    return sorted({(r.node, bytes(r.vector)) for r in drawn[0].union(drawn[1]).collect()})


def true_links(queries: list[tuple[int, bytes]], nodes: DataFrame, threshold: float) -> DataFrame:
    """``(node, n)``: the links of every query that has any, from a pass that compares each node with all of them."""
    held = nodes.sparkSession.sparkContext.broadcast(queries)  # 2 * AUDITED vectors at most

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[int, int] = {}
        node, raw, copies = (rows.column(k).to_pylist() for k in range(3))
        for size in {len(v) for v in raw}:
            at = [i for i, v in enumerate(raw) if len(v) == size]
            asked = [q for q in held.value if len(q[1]) == size]
            if not asked:
                continue
            x, y = (np.frombuffer(b"".join(v), np.float64).reshape(-1, size // 8) for v in ([q[1] for q in asked], [raw[i] for i in at]))
            close = x @ y.T >= threshold
            close &= np.array([q[0] for q in asked])[:, None] != np.array([node[i] for i in at])[None, :]
            for q, n in zip(asked, (close @ np.array([copies[i] for i in at], np.int64)).tolist()):
                if n:
                    found[q[0]] = found.get(q[0], 0) + n
        return _rows("node n", [L, L], [list(found), list(found.values())])

    return saved(by_batch(nodes.select("node", "vector", "copies"), compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")))


def recall(true: DataFrame, links: DataFrame) -> float:
    """The share of the true links of the audit's queries that ``links`` has; 1 if they have none."""
    sums = (
        true.join(links, "node", "left")
        .agg(F.sum("n").alias("true"), F.sum(F.least("n", F.coalesce("n_links", F.lit(0)))).alias("found"))
        .first()
    )
    return 1.0 if not sums.true else sums.found / sums.true


def all_pairs(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What :func:`exact_links` gives, from all pairs of nodes of equal length: the way out if no refinement suffices."""
    one = nodes.withColumn("root", F.length("vector").cast("long")).select("node", "root")
    return links_inside(saved(one), nodes, threshold)


def link_vectors(
    vectors: DataFrame, threshold: float = 0.95, ident: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    have no links and are their own component; so are vectors of other lengths
    to each other.  Equal vectors of several rows are links of each other
    (cosine 1) and one node of the graph.  ``component_id`` is the smallest id;
    null ids are never the smallest.  Other columns are not read.
    """
    rows = saved(unit_vectors(vectors, ident, embedding))
    nodes = saved(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.min("vector").alias("vector"))
    )
    total = nodes.count()
    true = None
    edges = saved(_lists(first_graph(nodes, total, threshold), None, threshold))
    done = 0
    while True:
        for _ in range(ROUNDS):
            found = refined(edges, nodes, threshold)
            edges = saved(_lists(edges.select("a", "b", "cosine").union(found), edges.select("a", "length").distinct(), threshold))
            done += 1
        links, roots = exact_links(edges, nodes, threshold)
        if true is None:
            true = true_links(audit_queries(nodes, links), nodes, threshold)
        if recall(true, links) >= RECALL:
            break
        if done >= MOST_ROUNDS:
            links, roots = all_pairs(nodes, threshold)
            break
    owner = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    known = owner.join(least, "root").join(links, "node", "left").select(
        "node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    )
    out = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(ident),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
