"""Whole queries against brute force on the smallest driver tables, where SQL has no say."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from loanloom.llm import queries
from loanloom.llm.bpe import read_ranks


@pytest.fixture(scope="module")
def texts(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def _sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_packing(spark, data, texts):
    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: [*own.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in queries.op4_packing(spark, data).collect():
        own_ids = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own_ids) == r.length and zlib.crc32(own_ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert pieces.keys() == ids.keys()
    filled = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        filled += at
    assert filled / (1024 * len(sequences)) > 0.9


def test_encoding(spark, data, texts):
    ranks = read_ranks(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_bpe(spark, data).collect()}
    want = {}
    for i, t in texts.items():
        ids = own.encode_ordinary(t)
        want[i] = (len(ids), _sha(",".join(map(str, ids))), _sha(t))
    assert got == want


def test_substrings(spark, data, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    starts = Counter(t[k : k + 400] for t in raw.values() for k in range(len(t) - 399))
    want = {}
    for i, t in raw.items():
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 399):
            if starts[t[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(t), int(gone.sum()), spans, _sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_substrings(spark, data).collect()}
    assert got == want


KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def test_secrets(spark, data, texts):
    want = {}
    for i, t in texts.items():
        spans = []
        for k, (name, (regex, group, least)) in enumerate(KINDS.items()):
            spans += [(m.start(), k, name, m.end()) for m in regex.finditer(t) if len(m[group]) >= least]
        spans.sort()
        counts = Counter(s[2] for s in spans)
        want[i] = (*(counts[k] for k in KINDS), _sha(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)))
    rows = queries.op10_secrets(spark, data).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == want
    for r in rows:  # the base spans are among all
        assert sum(x.split(":")[0] in KINDS for x in r.spans.split(",") if x) >= r.n_assign + r.n_access + r.n_hex


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licenses(spark, data, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
        places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[i] = (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
    rows = queries.op5_licenses(spark, data).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
