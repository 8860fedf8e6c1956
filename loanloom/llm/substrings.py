"""Repeated byte strings by suffix arrays over the places where repeats are possible.

A window of ``length`` bytes is represented by the smallest hash among its
pieces (128 bytes of 400).  Equal windows have equal representatives at equal distances,
so only places that share a representative can hold a repeat, and each window
belongs to one representative.  The bytes around such a place form a segment;
segments with one representative go together, the equal ones once.  A task
sorts its segments' suffixes in two stages: suffixes smaller than their
successors are sorted directly, bucket scans induce the others; windows whose
neighbour in that order has a common prefix of ``length`` bytes are repeated.

Groups with very many different segments are split by what the windows hold in
common, so that no task gets a whole group.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch, discard, finished, fresh, membership, mixed, perhaps, saved, taken, utf8

LENGTH = 400
#: Windows hold this many pieces' lengths at least; shorter pieces find more places that repeat by chance.
PIECES = 3
#: Bytes of text that are sorted together.
CHUNK = 1 << 18
#: Different segments of one representative beyond which the group is split.
LARGE = 64
#: Window starts that a split segment serves.
SPAN = 32
#: Bytes whose pieces are hashed at a time.
STEP = 1 << 20
#: Words of a passage that is noticed wherever it stands twice, and of the runs that are compared for it (a power of two).
PASSAGE, RUN = 50, 32
#: Bytes between words, and a number for each byte.
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def piece_length(length: int) -> int:
    """The longest power of two that fits a window :data:`PIECES` times."""
    return 1 << max(0, (length // PIECES).bit_length() - 1)


def piece_hashes(data: np.ndarray, piece: int) -> np.ndarray:
    """A 64-bit hash of every piece of ``data`` by doubling; ``piece`` is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width, base = 1, 0xD6E8FEB86659FD93
    while width < piece:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def representatives(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one representative: its hash, its place, first and last window start.

    The representative of a window is the leftmost smallest piece hash in it.
    """
    found = []
    windows = len(data) - length + 1
    piece = piece_length(length)
    inside = length - piece + 1  # pieces of a window
    for low in range(0, max(0, windows), STEP):
        n = min(STEP, windows - low)
        h = piece_hashes(data[low : low + n + length - 1], piece)
        # sliding minimum by doubling; ties to the left as the hash goes before the place
        place = np.arange(len(h))
        value, width = h, 1
        while width * 2 <= inside:
            value, place = _lower(value[:-width], place[:-width], value[width:], place[width:])
            width *= 2
        if width < inside:
            k = inside - width
            value, place = _lower(value[:-k], place[:-k], value[k:], place[k:])
        place = place[:n]
        change = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(change[1:], n) - 1
        found.append((h[place[change]], place[change] + low, change + low, last + low))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _lower(v1, p1, v2, p2):
    right = v2 < v1
    return np.where(right, v2, v1), np.where(right, p2, p1)


def suffix_order(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` by their first ``depth`` bytes, in two stages.

    Stage one sorts the suffixes that are smaller than their successors.  Stage
    two scans the buckets of the first byte upwards and puts the suffix before
    each one scanned, if it is the larger, at the next place of its bucket.
    """
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    # smaller than the successor: the next different byte is larger; the last suffix is not
    smaller = np.zeros(n, bool)
    differ = np.flatnonzero(data[1:] != data[:-1])
    run_end = np.full(n, n, np.int64)
    if len(differ):
        at = np.searchsorted(differ, np.arange(n))
        has = at < len(differ)
        run_end[has] = differ[at[has]]
        inner = run_end < n
        smaller[inner] = data[run_end[inner] + 1] > data[run_end[inner]]
    direct = np.flatnonzero(smaller).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    direct_byte = data[direct]
    bounds = np.searchsorted(direct_byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1], np.int64))  # the last suffix is larger than the empty one
    out = []

    def pass_on(block: np.ndarray, c: int) -> np.ndarray:
        """Gives each bucket above ``c`` the larger suffixes before ``block``; returns those of ``c`` itself."""
        before = block[block > 0] - 1
        before = before[~smaller[before]]
        byte = data[before]
        own = before[byte == c]
        above, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        above, byte = above[order], byte[order]
        for start, stop in zip(*(lambda f: (f, np.append(f[1:], len(byte))))(np.flatnonzero(np.diff(byte, prepend=-1)))):
            waiting[byte[start]].append(above[start:stop])
        return own

    data = data.astype(np.int64)
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(wave):  # suffixes that begin with a run of c follow from the shorter run
            out.append(wave)
            wave = pass_on(wave, c)
        block = direct[bounds[c] : bounds[c + 1]]
        if len(block):
            out.append(block)
            pass_on(block, c)
    return np.concatenate(out)


def repeated_starts(segments: list[bytes], spans: list[int], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the window starts 0..span-1 whose window occurs twice among the segments.

    A segment with several copies repeats all its windows.
    """
    out = [np.zeros(s, bool) for s in spans]
    for k, c in enumerate(copies):
        if c > 1:
            out[k][:] = True
    text = b"\xff".join(segments) + b"\xff"  # no byte of UTF-8
    begins = np.cumsum([0] + [len(s) + 1 for s in segments[:-1]])
    order = suffix_order(text, length)
    owner = np.searchsorted(begins, order, "right") - 1
    start = order - begins[owner]
    # a window that ends in its segment, whether this segment owns it or not
    sizes = np.array([len(s) for s in segments])
    valid = start + length <= sizes[owner]
    order, owner, start = order[valid], owner[valid], start[valid]
    same = np.fromiter(
        (text[i : i + length] == text[j : j + length] for i, j in zip(order[:-1].tolist(), order[1:].tolist())),
        bool,
        max(0, len(order) - 1),
    )
    # windows at the same distance from one representative are equal or not; chance equals elsewhere count too
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k, s in zip(owner[twice].tolist(), start[twice].tolist()):
        if s < len(out[k]):
            out[k][s] = True
    return out


def _table(rows: list[tuple], *names_and_types) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names_and_types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, names_and_types)], [n for n, _ in names_and_types]
    )


L, B = pa.int64(), pa.binary()


def node_of(text: str) -> Column:
    """A 64-bit digest of a text; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def _sorted_groups(parts: DataFrame, length: int) -> DataFrame:
    """``(group, digest, hits)`` by suffix order; ``parts``: group, digest, span, copies, segment."""
    grouped = parts.groupBy("group").agg(F.collect_list(F.struct("digest", "span", "copies", "segment")).alias("members"))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        out, bunch, size = [], [], 0

        def flush() -> None:
            columns = [[m[k] for _, m in bunch] for k in ("segment", "span", "copies")]
            for (group, m), hit in zip(bunch, repeated_starts(*columns, length)):
                if hit.any():
                    out.append((group, m["digest"], hit.tobytes()))
            bunch.clear()

        for group, members in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if len(members) == 1 and members[0]["copies"] > 1:  # one content, at several places
                out.append((group, members[0]["digest"], b"\1" * members[0]["span"]))
                continue
            bunch += [(group, m) for m in members]
            size += sum(len(m["segment"]) for m in members)
            if size >= CHUNK:
                flush()
                size = 0
        if bunch:
            flush()
        return _table(out, ("group", L), ("digest", L), ("hits", B))

    return by_batch(grouped, run, "group long, digest long, hits binary")


def _resolve(segments: DataFrame, spans: tuple[int, ...], length: int) -> DataFrame:
    """``(group, digest, hits)``: which window starts of each different segment are repeated.

    ``segments``: group, shift (of the representative in the segment), span
    (starts that it serves), copies, segment; ``digest`` names the content.
    Groups of more than ``LARGE`` different segments are cut into slices of
    ``spans[0]`` starts, counted from the representative; windows of a slice
    can only be equal if the bytes that all its windows share are, so those
    name the slice's new group.  A slice of one start is its window.
    """
    distinct = saved(
        segments.groupBy("group", "digest").agg(
            F.sum("copies").alias("copies"), F.min("span").alias("span"),
            F.min("shift").alias("shift"), F.min("segment").alias("segment"),
        )
    )
    if not spans:  # one window for each segment: copies tell
        return distinct.filter("copies > 1").select("group", "digest", F.expr("X'01'").alias("hits"))
    sizes = distinct.groupBy("group").agg(F.count("*").alias("n"), F.max("copies").alias("most"))
    small = distinct.join(sizes.filter(f"n <= {LARGE} AND (n > 1 OR most > 1)").select("group"), "group")
    large = distinct.join(sizes.filter(f"n > {LARGE}").select("group"), "group")
    step = spans[0]

    def split(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for group, digest, copies, span, shift, x in zip(*(c.to_pylist() for c in rows.columns)):
            for low in range(-shift // step * step, span - shift, step):
                a, b = max(0, low + shift), min(span, low + shift + step)
                shared = x[low + shift + step - 1 : low + shift + length]
                new = xxhash.xxh3_64_intdigest(group.to_bytes(8, "big", signed=True) + shared, low & 0xFFFF) >> 1
                piece = x[a : b - 1 + length]
                out.append((group, digest, a, new, shift - a, b - a, copies, piece, xxhash.xxh3_64_intdigest(piece, a - shift & 0xFFFF) >> 1))
        return _table(out, ("parent", L), ("whole", L), ("begin", L), ("group", L), ("shift", L), ("span", L),
                      ("copies", L), ("segment", B), ("digest", L))

    columns = ["group", "digest", "copies", "span", "shift", "segment"]
    slices = saved(
        by_batch(large.select(*columns), split, "parent long, whole long, begin long, group long, shift long, "
                 "span long, copies long, segment binary, digest long")
    )
    recurs = slices.groupBy("group").agg(F.count("*").alias("n"), F.max("copies").alias("most")).filter("n > 1 OR most > 1")
    live = slices.join(recurs.select("group"), "group")
    found = _resolve(live.select("group", "digest", "shift", "span", "copies", "segment"), spans[1:], length)
    parts = slices.select("parent", "whole", "begin", "group", "digest").join(found, ["group", "digest"])
    together = parts.groupBy("parent", "whole").agg(F.collect_list(F.struct("begin", "hits")).alias("parts"))

    def merge(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for group, digest, own in zip(*(c.to_pylist() for c in rows.columns)):
            hit = np.zeros(max(p["begin"] + len(p["hits"]) for p in own), bool)
            for p in own:
                hit[p["begin"] : p["begin"] + len(p["hits"])] = np.frombuffer(p["hits"], bool)
            out.append((group, digest, hit.tobytes()))
        return _table(out, ("group", L), ("digest", L), ("hits", B))

    return _sorted_groups(small.select("group", "digest", "span", "copies", "segment"), length).unionByName(
        by_batch(together, merge, "group long, digest long, hits binary")
    )


def find_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``(node, n_removed, spans, kept)`` for each different text with repeated bytes.

    ``node`` is :func:`node_of` the text, ``spans`` the maximal repeated byte
    intervals, ``kept`` the other bytes.  A repeated window starts at two places
    of one text or of two rows' texts, so texts of several rows repeat whole.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(node_of(text).alias("node"), body.alias("text")).filter(F.octet_length("text") >= length)

    def represent(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [
            (np.full(len(r[0]), n, np.int64), *r)
            for n, r in (
                (n, representatives(np.frombuffer(x, np.uint8), length))
                for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            )
        ]
        if not parts:
            return None
        node, h, place, first, last = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), *map(pa.array, (node, place, first, last))], ["rep", "node", "place", "first", "last"]
        )

    copies = saved(rows.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.octet_length("text")).cast("long").alias("n")))
    marks = by_batch(rows, represent, "rep long, node long, place long, first long, last long")
    marks = saved(marks.dropDuplicates(["rep", "node", "first"]))  # copies of a text give the same marks
    # a representative that one place of one text has is no repeat, and copies repeat anyway
    shared = marks.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    places = (
        marks.join(shared, "rep")
        .groupBy("node")  # at most one text's own places
        .agg(F.collect_list(F.struct("rep", "place", "first", "last")).alias("places"))
    )
    places = saved(places)
    near = perhaps(rows, "node", membership(places.select("node")))
    concerned = saved(near.dropDuplicates(["node"]).join(places, "node").join(copies, "node"))
    discard(marks)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for node, x, places, many in zip(*(c.to_pylist() for c in batch.columns)):
            for p in places:
                segment, shift = x[p["first"] : p["last"] + length], p["place"] - p["first"]
                out.append((node, p["rep"], p["first"], shift, p["last"] - p["first"] + 1, many, segment,
                            xxhash.xxh3_64_intdigest(segment, shift) >> 1))
        return _table(out, ("node", L), ("group", L), ("first", L), ("shift", L), ("span", L), ("copies", L),
                      ("segment", B), ("digest", L))

    schema = "node long, group long, first long, shift long, span long, copies long, segment binary, digest long"
    segments = saved(by_batch(concerned.select("node", "text", "places", "copies"), cut, schema))
    hits = _resolve(segments.drop("node", "first"), (SPAN, 1), length)
    found = (
        segments.select("group", "digest", "node", "first")
        .join(hits, ["group", "digest"])
        .groupBy("node")
        .agg(F.collect_list(F.struct("first", "hits")).alias("hits"))
    )
    partly = concerned.filter("copies = 1").select("node", "text").join(found, "node")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for node, x, hits in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.concatenate([np.flatnonzero(np.frombuffer(h["hits"], bool)) + h["first"] for h in hits])
            spans = covered(np.unique(at), length)
            kept = b"".join(x[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(x)]))
            out.append((node, len(x) - len(kept), [{"first": a, "end": b} for a, b in spans], kept))
        intervals = pa.list_(pa.struct([("first", L), ("end", L)]))
        return _table(out, ("node", L), ("n_removed", L), ("spans", intervals), ("kept", B))

    schema = "node long, n_removed long, spans array<struct<first: long, end: long>>, kept binary"
    whole = copies.filter("copies > 1").select(
        "node", F.col("n").alias("n_removed"),
        F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("end"))).alias("spans"),
        F.expr("X''").alias("kept"),
    )
    return by_batch(partly, keep, schema).unionByName(whole)


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal intervals under the windows at the sorted ``starts``."""
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``1 << bits`` powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        power = np.full(1 << bits, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power))
    return tuple(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and 64-bit hashes of the words in ``data``, by sums of its bytes times powers of a number."""
    edge = np.flatnonzero(np.diff(GAP[data], prepend=True, append=True))
    first, end = edge[::2], edge[1::2]
    out, low = np.empty(len(first), np.uint64), 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(end, first[low] + STEP, "right")))
        part = data[first[low] : end[high - 1]]
        begin, stop = first[low:high] - first[low], end[low:high] - first[low]
        power, inverse = _powers((len(part) - 1).bit_length())
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * power[: len(part)], out=total[1:])
        out[low:high] = mixed((total[stop] - total[begin]) * inverse[begin])
        low = high
    return first, out


def passage_marks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the texts by winnowing: the hash of a run of words, the text's number and the run's first word.

    Of the runs inside :data:`PASSAGE` neighbouring words the leftmost with the
    smallest hash is a mark, so equal passages hold an equal one.
    """
    first, h = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    begins = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
    owner = np.searchsorted(begins, first, "right") - 1
    starts = np.flatnonzero(owner[: max(0, len(owner) - PASSAGE + 1)] == owner[PASSAGE - 1 :])  # inside one text
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64))
    width, base = 1, 0xD6E8FEB86659FD93
    while width < RUN:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    h = value = mixed(h)
    place, width, inside = np.arange(len(h)), 1, PASSAGE - RUN + 1
    while width < inside:
        k = min(width, inside - width)
        value, place = _lower(value[:-k], place[:-k], value[k:], place[k:])
        width += k
    place = place[starts]
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]  # they rise
    return h[place], owner[place], place - np.searchsorted(owner, owner[place])


def shared_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(node, n_shared_words)`` for each different text with marks that stand elsewhere too: the words under those.

    Every passage of :data:`PASSAGE` words that starts at two places of the
    texts holds such a mark; fewer than :data:`RUN` common words hold none.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(node_of(text).alias("node"), body.alias("text")).filter(F.octet_length("text") >= 2 * PASSAGE - 1)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, own, first = passage_marks(utf8(batch.column(1)))
        order = np.lexsort((first, h, own))
        h, own, first = h[order], own[order], first[order]
        new = np.ones(len(h), bool)  # a text's equal marks are one row
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        firsts = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)), pa.int32()), pa.array(first))
        node = batch.column(0).to_numpy()[own[at]]
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(node), firsts], ["mark", "node", "firsts"])

    marks = saved(by_batch(rows, mark, "mark long, node long, firsts array<long>", text=1, most=1 << 20))
    often = marks.groupBy("mark").agg(F.sum(F.size("firsts")).alias("n")).filter("n > 1").select("mark")
    starts = marks.join(often, "mark").groupBy("node").agg(F.sort_array(F.flatten(F.collect_set("firsts"))).alias("s"))
    gaps = f"zip_with(slice(s, 2, size(s)), slice(s, 1, size(s) - 1), (b, a) -> least(b - a, {RUN}L))"
    return starts.select("node", F.expr(f"aggregate({gaps}, {RUN}L, (x, y) -> x + y)").alias("n_shared_words"))


def removal_digests(docs: DataFrame, text: str = "text", ident: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words)`` for every row.

    A null text is an empty one; texts shorter than ``length`` bytes lose
    nothing.  Equal texts of several rows repeat each other.  Null ids are
    rows like others; other columns are not read.  Passages of many words may
    hold fewer bytes than ``length``; :func:`shared_words` tells of those, and
    nothing is removed for them.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(ident).alias("id"), node_of(text).alias("node"),
        F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"),
    )
    found = find_repeats(docs, text, length).select(
        "node", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha")
    )
    return rows.join(found, "node", "left").join(shared_words(docs, text), "node", "left").select(
        F.col("id").alias(ident), "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"),
    )


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes; a character goes only if all its bytes do.

    All rows and columns stay, columns of any name among them.  Null texts stay
    null, empty ones and those shorter than ``length`` bytes as they are; rows
    with equal texts repeat each other and become empty.  Whole texts are read,
    however long.
    """

    def whole_characters(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own, x, spans in zip(*(c.to_pylist() for c in batch.columns)):
            parts, at = [], 0
            for s in spans:
                a, b = s["first"], s["end"]
                while a < b and x[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(x) and x[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(x[at:a])
                at = b
            out.append((own, b"".join([*parts, x[at:]]).decode()))
        return _table(out, (node, L), (kept_text, pa.string()))

    node = fresh(docs, "node")
    kept_text, changed_flag = fresh(docs, "kept_text"), fresh(docs, "changed_flag")
    taken()  # tables of others stay
    found = finished(find_repeats(docs, text, length).select("node", "spans"))
    body = F.col(text).cast("string").cast("binary")
    marked = docs.withColumn(node, node_of(text))
    concerned = membership(found.select("node"))
    looked_up = perhaps(marked, node, concerned)
    texts = looked_up.select(F.col(node).alias("node"), body.alias("bytes")).dropDuplicates(["node"]).join(found, "node")
    kept = saved(by_batch(texts.select("node", "bytes", "spans"), whole_characters, f"{node} long, {kept_text} string"))
    changed = looked_up.join(kept.withColumn(changed_flag, F.lit(True)), node, "left")
    new = F.when(F.col(changed_flag), F.col(kept_text)).otherwise(F.col(text).cast("string"))
    changed = changed.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
    return perhaps(marked, node, concerned, inside=False).select(*docs.columns).unionByName(changed)
