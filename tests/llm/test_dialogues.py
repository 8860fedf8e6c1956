"""Conversation repair against a plain search over all ways to edit."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from loanloom.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind int, told long, digest string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
WRITTEN = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def _rows_of(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        convs[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    place = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(v, key=place) for c, v in convs.items()}


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _expected(rows):
    faults = _faults(rows)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def inserted(found):
        again = True
        while again:
            again = False
            for q, (cost, audit, out) in list(found.items()):
                new = cost + 3, audit + "I", [*out, ROLES[WRITTEN[q]] + ":"]
                if WRITTEN[q] not in found or new[:2] < found[WRITTEN[q]][:2]:
                    found[WRITTEN[q]], again = new, True
        return found

    found = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, audit, out) in found.items():
            ways = [(q, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in FOLLOWS[q]:
                    ways.append((role[:1], (cost + more, audit + "K", [*out, f"{role}:{text}"])))
                ways.append((WRITTEN[q], (cost + 3 + more, audit + "R", [*out, f"{ROLES[WRITTEN[q]]}:{text}"])))
            for to, way in ways:
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        found = inserted(after)
    cost, audit, out = min((found[q] for q in ("", "a") if q in found), key=lambda x: x[:2])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), out


def _made(seed, convs, long):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for k in range(rng.choice([1, 2, 3, 5, 9, *long])):
            turn = rng.choice([None, *range(40)]) if rng.random() < 0.5 else k
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", None, "", "unknown"])
            rows.append((conv, turn, role, rng.choice(["a.", "b!", "c", "d? \n", "", " \t", None, f"{k}.", f"{k}", "é。", "漢?"])))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(5)


def _digest(out):
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("block,joined", [(1024, 32), (7, 2)])
def test_equals_plain_search(spark, monkeypatch, block, joined):
    monkeypatch.setattr(dialogues, "BLOCK", block)
    monkeypatch.setattr(dialogues, "JOINED", joined)
    rows = _made(block, 40, [30, 120])
    rows += [(77, 5, "user", "again and again.")] * 60  # a hot row
    got = {r[0]: tuple(r)[1:] for r in dialogues.repair_digests(_frame(spark, rows)).collect()}
    want = {c: _expected(v) for c, v in _rows_of(rows).items()}
    assert got == {c: (*stats, _digest(out)) for c, (stats, out) in want.items()}


def test_repaired_turns_are_well_formed(spark):
    rows = _made(9, 30, [20])
    damaged = dialogues.damaged(_frame(spark, rows))
    turns = dialogues.repaired_turns(damaged, dialogues.structure_report(damaged)).collect()
    want = {c: _expected(v)[1] for c, v in _rows_of(rows).items()}
    got = {c: [] for c in want}
    for r in sorted(turns, key=lambda r: r.position):
        assert r.position == len(got[r.conv])
        got[r.conv].append(f"{r.role}:{r.text}")
    assert got == want
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out)) for out in got.values())


def test_least_of_all_audits():
    """Every audit of a few rows, tried out."""
    rng = random.Random(1)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 2 | 8, 3 | 8, 2 | 4, 8]) for _ in range(rng.randrange(4)))
        best = None
        for length in range(2 * len(codes) + 3):
            for audit in product("DIKR", repeat=length):
                i, q, cost = 0, 0, 0
                for edit in audit:
                    if edit == "I":
                        q, cost = dialogues.WRITTEN[q], cost + 3
                        continue
                    if i == len(codes):
                        break
                    code, i = codes[i], i + 1
                    if edit == "D":
                        cost += 4
                        continue
                    if code & 4 or (edit == "K" and code & 3 not in dialogues.FOLLOWS[q]):
                        break
                    cost += 3 * (code & 8 > 0) + 3 * (edit == "R")
                    q = code & 3 if edit == "K" else dialogues.WRITTEN[q]
                else:
                    if i == len(codes) and q in (0, 3):
                        best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
        assert dialogues.repair(codes) == best


def test_text_ids_and_empty_table(spark):
    rows = [("c 1", 0, "user", "a."), ("c 1", 1, "assistant", "b."), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "c string, t int, r string, x string")
    got = {r.c: r for r in dialogues.repair_digests(frame, "c", "t", "r", "x").collect()}
    assert got.keys() == {"c 1", None} and got[None].audit in ("", "D")
    assert dialogues.repair_digests(frame.limit(0), "c", "t", "r", "x").count() == 0
