"""Structure repair of conversations.

A conversation is well formed if its roles read: perhaps a system turn, then
user and assistant in turn, ending with the assistant.  Rows are kept, given
another role or deleted, and empty turns are inserted, at the least cost.

Every way to edit is a path through the edit lattice, whose nodes are (rows
read, role last written).  Bidirectional Dijkstra finds the cheapest: a heap
from the start and a heap from the ends take turns, the search goes on until
no other crossing can be as cheap, and of all crossings of least cost the one
with the least audit (edits' initials) is taken.

Rows are ordered by range over the whole table and cut into blocks, so no task
holds a conversation: of a conversation in many blocks, each block is solved
from every role to every role, and blocks are joined by the same search, some
at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch, discard, saved

#: What edits cost, and what a truncated row adds if it stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a block, and blocks joined at a time.
BLOCK, JOINED = 1024, 32
#: Solved blocks that a worker remembers, and how long they may be.
REMEMBERED, SHORT = 16_384, 64
#: What counts as a space, and how a sentence ends.
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: States: nothing written, or the last role's initial.  A row's code holds its initial's state or 0, and its faults.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
MUST_GO, SHORTENED = 4, 8
#: What may follow a state, the role that other edits write there, and from where a state is reached.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
WRITTEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REACHED = {q: tuple(p for p in FOLLOWS if q in FOLLOWS[p]) for q in range(4)}
GOALS = (START, ASSISTANT)

Node = tuple[int, int]
Moves = Callable[[int, int], Iterator[tuple[str, int, Node]]]


def crossing(start: Node, goals: list[Node], ahead: Moves, behind: Moves) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest paths from ``start`` to any of ``goals``; None if there is none.

    ``ahead`` gives a node's edges (edits, cost, next node), ``behind`` those
    that lead to it.  Nodes are taken in the order of cost and position, which
    every edge raises; so a node's least audit is known when it is taken.
    (Two audits of one node with the same cost never begin with each other:
    what is longer by inserts costs more.  Least parts hence make least wholes.)
    """
    front: dict[Node, tuple[int, str]] = {start: (0, "")}
    back: dict[Node, tuple[int, str]] = {g: (0, "") for g in goals}
    fore, rear = [(0, *start)], sorted((0, -i, q) for i, q in goals)
    taken_front: set[Node] = set()
    taken_back: set[Node] = set()
    best = min((0 for g in goals if g == start), default=None)
    while fore and rear and (best is None or fore[0][0] + rear[0][0] <= best):
        if fore[0][0] <= rear[0][0]:
            cost, i, q = heappop(fore)
            node = i, q
            if node in taken_front:
                continue
            taken_front.add(node)
            text = front[node][1]
            for edits, more, to in ahead(i, q):
                label = cost + more, text + edits
                if to not in front or label < front[to]:
                    if to not in front or label[0] < front[to][0]:
                        heappush(fore, (label[0], *to))
                    front[to] = label
                if to in back and (best is None or label[0] + back[to][0] < best):
                    best = label[0] + back[to][0]
        else:
            cost, i, q = heappop(rear)
            node = -i, q
            if node in taken_back:
                continue
            taken_back.add(node)
            text = back[node][1]
            for edits, more, to in behind(-i, q):
                label = cost + more, edits + text
                if to not in back or label < back[to]:
                    if to not in back or label[0] < back[to][0]:
                        heappush(rear, (label[0], -to[0], to[1]))
                    back[to] = label
                if to in front and (best is None or label[0] + front[to][0] < best):
                    best = label[0] + front[to][0]
    if best is None:
        return None
    audits = [front[g][1] for g in goals if g in taken_front and front[g][0] == best]
    if start in taken_back and back[start][0] == best:
        audits.append(back[start][1])
    for node in taken_front:
        cost, text = front[node]
        for edits, more, to in ahead(*node):
            if to in taken_back and cost + more + back[to][0] == best:
                audits.append(text + edits + back[to][1])
    return best, min(audits)


def solve(codes: bytes, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """The cheapest edits of a block of rows from one state to any of some."""
    n = len(codes)

    def ahead(i: int, q: int):
        if i < n:
            code = codes[i]
            yield "D", DELETE, (i + 1, q)
            if not code & MUST_GO:
                more = TRUNCATED if code & SHORTENED else 0
                if code & 3 in FOLLOWS[q]:
                    yield "K", KEEP + more, (i + 1, code & 3)
                yield "R", REROLE + more, (i + 1, WRITTEN[q])
        yield "I", INSERT, (i, WRITTEN[q])

    def behind(i: int, q: int):
        if i:
            code = codes[i - 1]
            yield "D", DELETE, (i - 1, q)
            if not code & MUST_GO:
                more = TRUNCATED if code & SHORTENED else 0
                for p in REACHED[q]:
                    if code & 3 == q:
                        yield "K", KEEP + more, (i - 1, p)
                    if WRITTEN[p] == q:
                        yield "R", REROLE + more, (i - 1, p)
        for p in REACHED[q]:
            if WRITTEN[p] == q:
                yield "I", INSERT, (i, p)

    return crossing((0, start), [(n, g) for g in goals], ahead, behind)


@lru_cache(REMEMBERED)
def _remembered(codes: bytes) -> tuple[int, str]:
    return solve(codes, START, GOALS)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation's rows."""
    return _remembered(codes) if len(codes) <= SHORT else solve(codes, START, GOALS)


def all_ways(codes: bytes) -> list[tuple[int, str] | None]:
    """The cheapest edits of a block from every state to every state, row by row."""
    return [solve(codes, p, (q,)) for p in range(4) for q in range(4)]


def joined_ways(blocks: list[list[tuple[int, str] | None]]) -> list[tuple[int, str] | None]:
    """The same for blocks in a row, from theirs."""
    n = len(blocks)

    def ahead(j: int, q: int):
        if j < n:
            for r in range(4):
                if way := blocks[j][4 * q + r]:
                    yield way[1], way[0], (j + 1, r)

    def behind(j: int, q: int):
        if j:
            for p in range(4):
                if way := blocks[j - 1][4 * p + q]:
                    yield way[1], way[0], (j - 1, p)

    return [crossing((0, p), [(n, q)], ahead, behind) for p in range(4) for q in range(4)]


def damaged(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, turn, role, text, gone)``: rows with faults made on purpose, drawn from conversation and turn.

    The draw is the crc32 of ``conversation:turn`` modulo 20: 0 drops the row
    (it stays as a mark, ``gone``), 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 makes the role user.  Nulls are one space, except
    that a null conversation or turn stays null beside the draw.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space(conversation), F.lit(":"), space(turn)).cast("binary")) % 20
    own = space(text)
    kind = "string" if conversations.schema[conversation].dataType.simpleString() == "string" else "long"
    rows = conversations.select(
        F.col(conversation).cast(kind).alias("conv"),
        F.when(draw != 0, F.col(turn).cast("long")).alias("turn"),
        F.when(draw == 0, "").when(draw == 4, "user").otherwise(space(role)).alias("role"),
        F.when(draw <= 1, "").when(draw == 2, F.translate(own, ENDS, "")).otherwise(own).alias("text"),
        (draw == 0).alias("gone"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _ordered_faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, digest, gone, initial, blank, ended, first, copies)``: one row for equal rows.

    ``first`` tells that no row before it has its role and text.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    some = (
        rows.select(
            "conv", "turn", "role", "gone", _digest(F.col("text")).alias("digest"),
            F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
            F.substring(bare, -1, 1).isin(*ENDS).alias("ended"),
        )
        .groupBy("conv", "turn", "role", "gone", "digest", "initial", "blank", "ended")
        .agg(F.count("*").alias("copies"))
    )
    some = saved(some)
    seen = (
        some.filter("NOT gone")
        .groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("untimed"))
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    begins = F.when(F.col("untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    out = some.join(seen, same, "left").withColumn("first", F.coalesce(begins, F.lit(False))).drop("c", "r", "d", "least", "untimed")
    out.source = some
    return out


STATS = ["blank", "duplicate", "truncated", "illegal"]


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.codes = conv, bytearray()
        self.first = self.last = None
        self.turns = 0
        self.count = dict.fromkeys(STATS, 0)

    def add(self, turn, code: int, fault: str | None, many: int) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
            self.last = turn
        if fault:
            self.count[fault] += many
        if self.codes:
            before = self.codes[-1] & 3
            self.count["illegal"] += not before or code & 3 not in FOLLOWS[before]
        self.count["illegal"] += many - 1  # no role follows itself
        self.codes += bytes([code]) * many


def _blocks(kind: str) -> tuple[Callable, str]:
    """The function that reads ordered rows and gives their blocks, solved, and its schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, number, first, out = None, 0, True, []

        def close(whole: bool) -> None:
            codes = bytes(piece.codes)
            ways = [repair(codes)] if whole else all_ways(codes)
            out.append(
                {
                    "conv": piece.conv, "part": part, "number": number, "whole": whole, "first": piece.first, "last": piece.last,
                    "turns": piece.turns, **piece.count, "head": codes[0] & 3 if codes else None, "tail": codes[-1] & 3 if codes else None,
                    "cost": [w and w[0] for w in ways], "audit": [w and w[1] for w in ways],
                }
            )

        for batch in batches:
            for r in batch.to_pylist():
                if piece is None or r["conv"] != piece.conv:
                    if piece is not None:
                        close(number == 0 and not first)
                        first = False
                    piece, number = _Piece(r["conv"]), 0
                if r["gone"]:
                    continue
                code, fault = INITIALS.get(r["initial"], 0), None
                if r["blank"]:
                    code, fault = code | MUST_GO, "blank"
                elif not r["first"]:
                    code, fault = code | MUST_GO, "duplicate"
                elif not r["ended"]:
                    code, fault = code | SHORTENED, "truncated"
                left = r["copies"]
                while left:
                    if len(piece.codes) >= BLOCK:
                        close(False)
                        piece, number = _Piece(r["conv"]), number + 1
                    many = min(left, BLOCK - len(piece.codes))
                    if fault in (None, "truncated"):
                        many = 1
                    piece.add(r["turn"], code, fault, many)
                    left -= many
                    if fault in (None, "truncated"):  # the other copies repeat it
                        code, fault = INITIALS.get(r["initial"], 0) | MUST_GO, "duplicate"
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if piece is not None:
            close(False)  # it may go on in the next partition
            yield pa.RecordBatch.from_pylist(out, schema)

    types = {"conv": None, "part": pa.int64(), "number": pa.int64(), "whole": pa.bool_()}
    types |= dict.fromkeys(["first", "last", "turns", *STATS, "head", "tail"], pa.int64())
    types |= {"cost": pa.list_(pa.int64()), "audit": pa.list_(pa.string())}
    types["conv"] = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema(types)
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return run, ", ".join(f"{k} {names[t]}" for k, t in types.items())


def _joined(pieces: DataFrame, part: Column, number: Column) -> DataFrame:
    """Pieces of a conversation that share ``part`` and ``number``, made one."""
    names = [f.name for f in pieces.schema]
    members = pieces.groupBy("conv", part.alias("p"), number.alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("part", "number", *names[4:]))).alias("members")
    )
    kind = pieces.schema["conv"].dataType.simpleString()
    _, schema = _blocks(kind)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in rows.to_pylist():
            found = r["members"]
            one = {"conv": r["conv"], "part": r["p"], "number": r["n"], "whole": False}
            one |= {k: sum(m[k] for m in found) for k in ["turns", *STATS]}
            timed = [m for m in found if m["first"] is not None]
            one["turns"] -= sum(a["last"] == b["first"] for a, b in zip(timed, timed[1:]))
            one |= {"first": timed[0]["first"] if timed else None, "last": timed[-1]["last"] if timed else None}
            full = [m for m in found if m["head"] is not None]
            one["illegal"] += sum(not a["tail"] or b["head"] not in FOLLOWS[a["tail"]] for a, b in zip(full, full[1:]))
            one |= {"head": full[0]["head"] if full else None, "tail": full[-1]["tail"] if full else None}
            ways = joined_ways([[None if c is None else (c, a) for c, a in zip(m["cost"], m["audit"])] for m in found])
            one |= {"cost": [w and w[0] for w in ways], "audit": [w and w[1] for w in ways]}
            out.append(one)
        return pa.RecordBatch.from_pylist(out, _arrow(schema))

    return by_batch(members, batch, schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(k, types[t]) for k, t in (x.split(" ") for x in schema.split(", "))])


def structure_report(rows: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for every conversation of ``rows``.

    ``rows`` has the columns of :func:`damaged`; rows that are ``gone`` only
    say that a conversation exists.  A conversation's rows are taken by turn,
    nulls first, ties by role and then by the sha256 of the text.  A row's
    first fault counts: blank, duplicate, truncated.  A role is known by its
    first character; one that begins with none of s, u and a cannot be kept.
    """
    faults = _ordered_faults(rows)
    key = ["conv", "turn", "role", "digest"]
    run, schema = _blocks(rows.schema["conv"].dataType.simpleString())
    blocks = saved(faults.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, schema))
    discard(faults.source)
    pieces = blocks.filter("NOT whole").drop("whole").select("conv", "part", "number", F.lit(False).alias("whole"), *blocks.columns[4:])
    # first the pieces of one partition, then those of neighbouring partitions
    while True:
        most, parts, convs = pieces.agg(
            F.max("number"), F.count_distinct("part", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull()),
            F.count_distinct(F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull()),
        ).first()
        if most:
            pieces = saved(_joined(pieces, F.col("part"), F.floor(F.col("number") / JOINED).cast("long")))
        elif parts > convs:
            pieces = saved(_joined(pieces, F.floor(F.col("part") / JOINED).cast("long"), F.col("number")))
        else:
            break
    # from the start (the first row of ways) to nothing written or to the assistant
    ends = [F.struct(F.col("cost")[g].alias("cost"), F.col("audit")[g].alias("audit")) for g in GOALS]
    least = F.array_min(F.filter(F.array(*ends), lambda x: x["cost"].isNotNull()))
    whole = blocks.filter("whole").withColumn("way", F.struct(F.col("cost")[0].alias("cost"), F.col("audit")[0].alias("audit")))
    both = whole.unionByName(pieces.withColumn("way", least))
    return both.select(
        "conv",
        F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *STATS, F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"),
    )


def _edited(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The report's row of each conversation and then its rows, in order, a conversation in one partition."""
    told = report.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.struct(*report.columns[1:]).alias("told"),
    )
    texts = rows.filter("NOT gone").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text",
        F.lit(None).cast(told.schema["told"].dataType).alias("told"),
    )
    order = ["conv", "kind", "turn", "role", "digest"]
    return told.unionByName(texts).repartition("conv").sortWithinPartitions(*order).drop("kind", "turn", "digest")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(report's row or None, role, text)`` for each conversation's beginning and each of its repaired turns.

    Reads on row by row; all it holds of a conversation is its audit.
    """
    audit, at, state = "", 0, START

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = WRITTEN[state]
            at += 1
            yield None, ROLES[state], ""

    for batch in batches:
        for conv, role, text, told in zip(*(c for c in batch.columns)):
            told = told.as_py()
            if told is not None:
                yield from inserts()
                audit, at, state = told["audit"], 0, START
                yield (conv.as_py(), told), None, None
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                role = role.as_py()
                state = INITIALS[role[0]]
                yield None, role, text.as_py()
            elif edit == "R":
                state = WRITTEN[state]
                yield None, ROLES[state], text.as_py()
    yield from inserts()


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``(conv, position, role, text)``: the turns of every conversation after its edits, counted from 0."""
    kind = rows.schema["conv"].dataType.simpleString()
    types = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, out = None, 0, []
        for told, role, text in _written(batches):
            if told:
                conv, position = told[0], 0
                continue
            out.append((conv, position, role, text))
            position += 1
            if len(out) == BLOCK:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    return _edited(rows, report).mapInArrow(run, f"conv {kind}, position long, role string, text string")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["conv", "position", "role", "text"])


def repair_digests(
    conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The report of damaged conversations with ``repaired_sha256``, a row for every id, null included.

    Equal to the digest over :func:`repaired_turns` as ``role:text``, joined by
    line feeds.  A digest is read in order, so a conversation's turns pass one
    task here, one after the other, and none is held.  Other columns are not
    read; repeated rows are duplicates; an empty table gives no rows.
    """
    rows = damaged(conversations, conversation, turn, role, text)
    report = saved(structure_report(rows))
    kind = rows.schema["conv"].dataType.simpleString()
    fields = ["gaps", *STATS, "cost"]
    types = [pa.string() if kind == "string" else pa.int64(), *[pa.int64()] * len(fields), pa.string(), pa.string()]
    names = [conversation, *fields, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest, joint = [], None, None, b""

        def close() -> None:
            if head:
                out.append((head[0], *(head[1][k] for k in fields), head[1]["audit"], digest.hexdigest()))

        for told, role, text in _written(batches):
            if told:
                close()
                head, digest, joint = told, hashlib.sha256(), b""
                if len(out) >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out.clear()
            else:
                digest.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = f"`{conversation}` {kind}, " + ", ".join(f"{k} long" for k in fields) + ", audit string, repaired_sha256 string"
    return _edited(rows, report).mapInArrow(run, schema)
