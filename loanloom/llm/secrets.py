"""Secret scan: a trigram inverted index picks the texts each regex is run on.

Every rule's regex is turned into a Boolean query of trigrams that any match
must hold.  A batch of texts gets postings for those trigrams, the postings are
intersected and united as the query says, and only the texts that remain are
scanned with the regex.  Rules that have no mandatory trigram scan all texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch, utf8


@dataclass(frozen=True)
class Rule:
    """``shortest``: characters that ``group`` of a match needs, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0


#: The kinds of the base, in their order, then those that the scan adds.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # the same spans as of [0-9a-f]+ with 32 characters or more
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    # up to the END line; where that is missing, up to the end of the base64 lines
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
        r"(?:(?:[^-]|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
        r"|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*(?:(?:\\[nrt]|[\s\"',>#*])*[A-Za-z0-9+/]{16,}={0,2})*"
        r"(?:(?<=[A-Za-z0-9+/]{16})(?:\\[nrt]|[\s\"',>#*]){1,8}[A-Za-z0-9+/]+={0,2})?)",
    ),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}\b"),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]{3,}+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: A set of literal strings is followed no further than this.
MOST_STRINGS = 256
#: Bytes that are indexed at a time.
PIECE = 1 << 20


# A query is True (no condition), ("and", ...), ("or", ...) or a trigram.
def _all(parts):
    parts = {p for p in parts if p is not True}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", *sorted(parts, key=str))


def _any(parts):
    parts = set(parts)
    if True in parts or not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else ("or", *sorted(parts, key=str))


def _trigrams(strings: set[bytes]):
    """What a text must hold if it holds one of ``strings``."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(op, arg) -> set[bytes] | None:
    """All texts that a part can match, lowered; None if they are too many."""
    if op is rc.LITERAL:
        return {chr(arg).encode().lower()}
    if op is rc.IN:
        if all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).encode().lower() for _, a in arg}
        return None
    if op is rc.AT:
        return {b""}
    if op is rc.SUBPATTERN:
        return _joined(arg[-1])
    if op is rc.BRANCH:
        each = [_joined(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 4:
        one = _joined(arg[2])
        if one is None:
            return None
        out, power = set(), {b""}
        for k in range(arg[1] + 1):
            out |= power if k >= arg[0] else set()
            power = {a + b for a in power for b in one}
            if len(power) > MOST_STRINGS:
                return None
        return out
    return None


def _joined(parts) -> set[bytes] | None:
    out = {b""}
    for op, arg in parts:
        one = _strings(op, arg)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _needs(parts):
    """The query of a sequence: literal runs are joined, what lies between them adds its own."""
    found, run = [], {b""}
    for op, arg in parts:
        one = _strings(op, arg)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        found.append(_trigrams(run))
        run = one if one is not None else {b""}
        if one is None:
            if op is rc.SUBPATTERN:
                found.append(_needs(arg[-1]))
            elif op is rc.BRANCH:
                found.append(_any(_needs(x) for x in arg[1]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                found.append(_needs(arg[2]))
    return _all([*found, _trigrams(run)])


def trigram_query(pattern: str):
    """The Boolean query over lowered trigrams that every text with a match satisfies."""
    return _needs(rp.parse(pattern))


def _leaves(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(_leaves, query[1:]))


class Scanner:
    """Compiled rules with the queries of their trigrams."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII)) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted(set().union(*map(_leaves, self.queries)))
        self.place = {g: k for k, g in enumerate(grams)}
        codes = np.array([int.from_bytes(g, "big") for g in grams], np.uint32)
        self.codes, self.wanted = codes, np.zeros(1 << 24, bool)
        self.wanted[codes] = True

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """``[trigram, text]``: whether the lowered text holds the trigram."""
        out = np.zeros((len(self.codes), len(texts)), bool)
        ends = np.cumsum([len(x) + 1 for x in texts])
        joined = b"\x00".join(texts).lower() + b"\x00"
        for low in range(0, len(joined) - 2, PIECE):
            data = np.frombuffer(joined[low : low + PIECE + 2], np.uint8).astype(np.uint32)
            code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            at = np.flatnonzero(self.wanted[code])
            out[np.searchsorted(self.codes, code[at]), np.searchsorted(ends, at + low, "right")] = True
        return out

    def _holds(self, query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.place[query]]
        parts = [self._holds(q, postings) for q in query[1:]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans ``(start, rule, end)`` in code points, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        read: dict[int, str] = {}
        postings = self.postings(texts)
        for k, (rule, regex) in enumerate(self.rules):
            for i in np.flatnonzero(self._holds(self.queries[k], postings)).tolist():
                if not texts[i]:
                    continue
                if self.queries[k] is True:
                    text = texts[i].decode()
                elif i not in read:
                    text = read[i] = texts[i].decode()
                else:
                    text = read[i]
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.shortest:
                        found[i].append((m.start(), k, m.end()))
        for x in found:
            x.sort()
        return found


_scanners: dict[tuple, Scanner] = {}


def scanner(rules=RULES) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def written(spans: list[tuple[int, int, int]], rules=RULES, most: int | None = None) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if most is None or k < most)


def scan_secrets(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row.

    A null text is an empty one, which has no spans.  Repeated rows and null ids
    give a row each; other columns are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = scanner().spans(utf8(rows.column(1)))
        count = lambda k: pa.array([sum(s[1] == k for s in x) for x in found], pa.int64())
        sha = [hashlib.sha256(written(x, most=3).encode()).hexdigest() for x in found]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), count(0), count(1), count(2), pa.array(sha, pa.string()), pa.array([written(x) for x in found], pa.string())],
            ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    out = by_batch(
        docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")),
        batch,
        f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
    return out.withColumnRenamed("id", ident)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced; all rows and columns stay, null stays null."""
    order = docs.columns
    at = order.index(text)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = rows.column(at)
        raw = utf8(column)
        found = scanner().spans(raw)
        new = [x if not s else masked(b.decode(), s) for x, b, s in zip(column.to_pylist(), raw, found)]
        return rows.set_column(at, rows.schema.field(at), pa.array(new, column.type))

    return by_batch(docs, batch, docs.schema)
