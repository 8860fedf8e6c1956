"""Byte-level BPE encoding and decoding in two tiers.

Whole pre-tokens that are vocabulary entries are resolved by a minimal perfect
hash.  The others are merged from bytes: a heap gives the lowest-ranked
adjacent pair, links give its neighbours.  Recent results are kept, up to a
bound, so that frequent pre-tokens are resolved once.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch
from loanloom.llm.pretokens import split

#: Pre-tokens that a worker remembers.
REMEMBERED = 150_000
#: Bits of a heap entry that hold the position.
POSITION = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """Maps each of n keys to its own slot in 0..n-1 by hashing and displacing.

    Keys are dealt to n/2 buckets; the largest buckets first look for a
    displacement that puts all their keys on free slots, single keys get a slot
    that is left.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 2)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        dealt: list[list[int]] = [[] for _ in range(self.buckets)]
        code = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(code)) < self.n:
            raise ValueError("two keys have one hash")
        for k, h in enumerate(code):
            dealt[h % self.buckets].append(k)
        free = iter(())
        for b in sorted(range(self.buckets), key=lambda b: -len(dealt[b])):
            own = dealt[b]
            if not own:
                break
            if len(own) == 1:
                if not isinstance(free, list):
                    free = [s for s in range(self.n) if self.slots[s] < 0]
                self.shift[b] = -1 - (slot := free.pop())
                self.slots[slot] = own[0]
                continue
            d = 0
            while True:
                at = {self._slot(code[k], d) for k in own}
                if len(at) == len(own) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for k in own:
                self.slots[self._slot(code[k], d)] = k

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFF)) % self.n

    def find(self, key: bytes) -> int:
        """The slot where ``key`` would be; the caller compares the key that is there."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else self._slot(h, d)


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        words = list(self.ranks)
        self.hash = PerfectHash(words)
        self.at = [(words[k], (self.ranks[words[k]],)) for k in self.hash.slots]
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.text_of = {v: str(v) for v in self.bytes_of}
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that is no vocabulary entry."""
        n, rank = len(piece), self.ranks.get
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(piece[i : i + 2], -1) for i in range(n)]
        now[n - 1] = -1
        heap = [(r << POSITION) | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        mask = (1 << POSITION) - 1
        while heap:
            top = heappop(heap)
            i = top & mask
            if now[i] != top >> POSITION:
                continue
            j = following[i]
            k = following[j]
            following[i], now[j] = k, -1
            if k < n:
                before[k] = i
                r = now[i] = rank(piece[i : following[k]], -1)
                if r >= 0:
                    heappush(heap, (r << POSITION) | i)
            else:
                now[i] = -1
            p = before[i]
            if p >= 0:
                r = now[p] = rank(piece[p:k], -1)
                if r >= 0:
                    heappush(heap, (r << POSITION) | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : following[i]]])
            i = following[i]
        return tuple(out)

    def encode_piece(self, token: str) -> tuple[int, ...]:
        piece = token.encode()
        word, ids = self.at[self.hash.find(piece)]
        return ids if word == piece else self.merge(piece)

    def encode(self, text: str) -> list[int]:
        kept, out = self.kept, []
        for token in split(text):
            ids = kept.get(token)
            if ids is None:
                ids = self.encode_piece(token)
                if len(kept) >= REMEMBERED:
                    kept.clear()
                if len(token) <= 64:
                    kept[token] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``(id, ids)`` for every row: the ids of the whole text; null and empty texts have none."""
    kind = docs.schema[ident].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        ids = [own.encode(x or "") for x in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return by_batch(
        docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")),
        batch,
        f"id {kind}, ids array<int>",
    ).withColumnRenamed("id", ident)


def decode_documents(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded`` (binary): the bytes that ``ids`` stand for; null ids give none."""
    at = rows.columns.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"

    def batch(table: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        out = pa.array([own.decode(x or []) for x in table.column(at).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*table.columns, out], [*table.schema.names, "decoded"])

    return by_batch(rows, batch, schema)


def round_trip_digests(
    docs: DataFrame, vocabulary: str, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` for every row.

    Encodes the whole text, decodes the ids and digests both; ids never leave
    the task.  A null text is empty: no tokens, digests of nothing.  Repeated
    rows and null ids give a row each; other columns are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        count, coded, decoded = [], [], []
        for x in rows.column(1):  # one text at a time
            ids = own.encode(x.as_py() or "")
            count.append(len(ids))
            coded.append(hashlib.sha256(",".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return by_batch(
        docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")),
        batch,
        f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    ).withColumnRenamed("id", ident)
