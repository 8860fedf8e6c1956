"""Packs token sequences by cutting-stock column generation.

A document longer than a sequence gives whole sequences and one remainder.  The
histogram of remainders, at most one number per length, goes to the driver.
There a linear program over packing patterns is solved: its dual prices go to a
knapsack (dynamic programming over the sequence length) that yields the next
pattern, until none improves it.  Patterns are rounded down, what is left is
packed by best fit.  Documents are ranked within their remainder's length, and
the rank says which copy of which pattern takes the remainder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.bpe import read_ranks
from loanloom.llm.common import by_batch, ranges, saved
from loanloom.llm.pretokens import split

#: Parts that the documents of one length are dealt to for ranking.
PARTS = 4096
#: The linear program ends when its value is within this share of a bound.
GAP = 1e-3
#: Pre-tokens that a worker remembers.
REMEMBERED = 150_000


def knapsack(size: int, lengths: np.ndarray, worth: np.ndarray) -> tuple[float, np.ndarray]:
    """The best multiset of ``lengths`` that fits ``size``: its worth and how often it takes each."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(lengths)
    by_length, gains = lengths[order], worth[order]
    upto = np.searchsorted(by_length, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            value = best[c - by_length[:k]] + gains[:k]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], took[c] = value[i], i
    pattern, c = np.zeros(len(lengths), np.int64), size
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[order[took[c]]] += 1
            c -= by_length[took[c]]
    return float(best[size]), pattern


def first_patterns(size: int, lengths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A basis to begin with, and its inverse: patterns filled longest first, each used until one length runs out.

    A pattern holds no length that an earlier one has used up, so the matrix is
    triangular in the order in which lengths run out, and regular.
    """
    runs_out = []
    left, alive = demand.copy(), np.ones(len(lengths), bool)
    out = np.zeros((len(lengths), len(lengths)))
    for p in range(len(lengths)):
        room, pattern = size, out[:, p]
        for i in np.flatnonzero(alive)[::-1].tolist():
            if lengths[i] <= room and (left[i] > 0 or room == size):
                pattern[i] = min(room // lengths[i], max(1, int(left[i])))
                room -= int(pattern[i]) * int(lengths[i])
        inside = np.flatnonzero(pattern)
        copies = left[inside] / pattern[inside]
        gone = inside[int(copies.argmin())]
        left[inside] = np.maximum(left[inside] - pattern[inside] * copies.min(), 0)
        left[gone], alive[gone] = 0, False
        runs_out.append(int(gone))
    inverse = np.zeros_like(out)
    for p, i in enumerate(runs_out):
        row = np.zeros(len(lengths))
        row[i] = 1
        for q in np.flatnonzero(out[i, :p]).tolist():
            row -= out[i, q] * inverse[q]
        inverse[p] = row / out[i, p]
    return out, inverse


def patterns(size: int, lengths: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Basic patterns (a row each), how often each is used, fractionally, and by what share their number may exceed the least.

    Patterns are added until that share is within ``GAP`` by the better of two
    bounds, the prices' and the total length's; or, should pivots no longer
    change the number, after as many idle ones as there are lengths.
    """
    basis, inverse = first_patterns(size, lengths, demand)  # column p: pattern p
    # products without a thread pool, which a driver that has forked cannot count on
    times = lambda x: np.einsum("ij,j->i", inverse, x)
    used = np.maximum(times(demand), 0)
    least, idle = float((lengths * demand).sum()) / size, 0
    while True:
        price = inverse.sum(axis=0)
        worth, column = knapsack(size, lengths, price)
        number = used.sum()
        least = max(least, number / worth)  # no solution uses fewer
        if number <= (1 + GAP) * least or idle > len(lengths):
            break
        step = times(column.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
        used = np.maximum(times(demand), 0)
        idle = 0 if used.sum() < number * (1 - 1e-12) else idle + 1
    return np.rint(basis.T).astype(np.int64), used, used.sum() / least - 1


@dataclass
class Plan:
    """Where the remainder of a length and a rank goes.

    Sorted by ``key = length << 40 | first rank``; a row serves the ranks from
    there on, ``each`` of them in one sequence.
    """

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    gap: float = 0.0  # of the linear program, before patterns are rounded

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 40) | rank
        at = np.searchsorted(self.key, key, "right") - 1
        nth = key - self.key[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def plan_packing(size: int, histogram: dict[int, int]) -> Plan:
    """A plan for ``histogram`` (length below ``size``: number of remainders)."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    rows, sequences, gap = [], 0, 0.0
    left, rank = demand.copy(), np.zeros(len(lengths), np.int64)

    def take(pattern: np.ndarray, copies: int) -> None:
        nonlocal sequences
        offset = 0
        for i in np.flatnonzero(pattern).tolist():
            each = int(pattern[i])
            rows.append(((int(lengths[i]) << 40) | int(rank[i]), each, sequences, offset))
            offset += each * int(lengths[i])
            rank[i] += each * copies
            left[i] -= each * copies
        sequences += copies

    if len(lengths):
        basis, used, gap = patterns(size, lengths, demand.astype(float))
        for pattern, x in zip(basis, np.floor(used + 1e-7).astype(np.int64)):
            here = pattern > 0
            copies = min([int(x), *(left[here] // pattern[here]).tolist()])
            if copies > 0:
                take(pattern, copies)
        room: list[int] = []
        inside: list[np.ndarray] = []
        for i in range(len(lengths) - 1, -1, -1):
            for _ in range(int(left[i])):
                length = int(lengths[i])
                fits = [(r, b) for b, r in enumerate(room) if r >= length]
                if fits:
                    b = min(fits)[1]
                else:
                    b = len(room)
                    room.append(size)
                    inside.append(np.zeros(len(lengths), np.int64))
                room[b] -= length
                inside[b][i] += 1
        for pattern in inside:
            take(pattern, 1)
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences=sequences, gap=gap)


class Tokens:
    """Little-endian 32-bit ids of a text; whole pre-tokens are encoded once and remembered."""

    def __init__(self, ranks_path: str):
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={}
        )
        self.kept: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        kept, out = self.kept, []
        for token in split(text):
            own = kept.get(token)
            if own is None:
                own = np.array(self.encoding._encode_single_piece(token), "<u4").tobytes()
                if len(kept) >= REMEMBERED:
                    kept.clear()
                if len(token) <= 64:
                    kept[token] = own
            out.append(own)
        return b"".join(out)


def pack(
    docs: DataFrame,
    ranks: str,
    size: int = 1024,
    end: int = 0,
    text: str = "text",
    ident: str = "doc_id",
) -> DataFrame:
    """One row for each piece of a document.

    ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.  A
    document is the ids of its whole text and one ``end`` id; a null or empty
    text is the end id alone.  Pieces are cut after every ``size`` ids.
    Repeated rows and null ids are documents of their own.  No rows: no pieces.

    ``ranks`` is the vocabulary as a rank file; merging by it gives the ids of
    the same vocabulary's JSON file.
    """
    kind = docs.schema[ident].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokens(ranks)  # of this task; the worker may serve other stages next
        for rows in batches:
            yield cut_batch(own, rows)

    def cut_batch(own: Tokens, rows: pa.RecordBatch) -> pa.RecordBatch:
        count, sums = [], []
        for x in rows.column(1):  # one text at a time
            ids = own.ids(x.as_py() or "") + last
            count.append(len(ids) // 4)
            sums.append([zlib.crc32(ids[a : a + 4 * size]) for a in range(0, len(ids), 4 * size)])
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(count, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            ["id", "n", "sums"],
        )

    chosen = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    cuts = saved(chosen.mapInArrow(cut, f"id {kind}, n long, sums array<long>"))
    rows = cuts.select(
        "*",
        (F.col("n") % size).cast("int").alias("rest"),
        F.floor(F.col("n") / size).cast("long").alias("whole"),
        F.pmod(F.xxhash64("id", "n"), F.lit(PARTS)).cast("int").alias("part"),
    )

    # ranks and running counts, from the totals of (remainder, part)
    parts = saved(rows.groupBy("rest", "part").agg(F.count("*").alias("docs"), F.sum("whole").alias("wholes")))
    by_rest = parts.groupBy("rest").agg(F.sum("docs").alias("docs"), F.sum("wholes").alias("wholes"))
    histogram, first_whole, total = {}, {}, 0
    for r in sorted(by_rest.collect()):  # one row for each length
        first_whole[r.rest] = total
        total += r.wholes
        if r.rest:
            histogram[r.rest] = r.docs
    plan = plan_packing(size, histogram)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "rest",
        "part",
        F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("wholes").over(earlier), F.lit(0)).alias("wholes_before"),
    )
    within = Window.partitionBy("rest", "part").orderBy("id", "n", "sums")
    ranked = rows.join(starts, ["rest", "part"]).select(
        "id",
        "n",
        "sums",
        "rest",
        (F.col("docs_before") + F.row_number().over(within) - 1).alias("rank"),
        (
            F.col("wholes_before")
            + F.sum("whole").over(within.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("whole")
        ).alias("nth_whole"),
    )
    rest_starts = np.zeros(size, np.int64)
    for k, v in first_whole.items():
        rest_starts[k] = v

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, rest, rank, nth = (batch.column(k).to_numpy() for k in (1, 3, 4, 5))
        sums = batch.column(2)
        many = (n + size - 1) // size
        row = np.repeat(np.arange(len(n)), many)
        piece = ranges(np.zeros(len(n), np.int64), many)
        length = np.minimum(size, n[row] - piece * size)
        sequence = plan.sequences + rest_starts[rest[row]] + nth[row] + piece
        offset = np.zeros(len(row), np.int64)
        short = np.flatnonzero(length < size)
        if len(short):
            sequence[short], offset[short] = plan.place(length[short], rank[row[short]])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(piece * size), pa.array(length), sums.flatten(),
             pa.array(n[row]), pa.array(sequence), pa.array(offset)],
            ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    out = by_batch(
        ranked,
        pieces,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return out.withColumnRenamed("id", ident)
