"""Passages of many words in fewer bytes than op9 removes."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from loanloom.llm import substrings


def _words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghij", k=4)) for _ in range(n)]


def _texts() -> list[tuple]:
    passage, short = _words(1, 50), _words(2, 31)
    rows = [
        (0, " ".join(_words(10, 70) + passage + _words(11, 30))),
        (1, "\n".join(_words(12, 3) + passage)),  # other gaps
        (2, " ".join(_words(13, 40) + short + _words(14, 40))),
        (3, " ".join(short + _words(15, 60))),
        (4, " ".join(_words(16, 60) + _words(17, 9) + _words(16, 60))),  # inside one text
        (5, " ".join(["x", "y"] * 400)),  # a period
        (6, " ".join(_words(18, 60))),
        (6, " ".join(_words(18, 60))),  # a copy
        (7, " ".join(_words(19, 49))),
        (8, " ".join(_words(19, 49))),  # copies, too short
        (9, None), (10, ""), (11, " \n"), (None, "é" * 300), (12, " ".join(_words(20, 2000))),
    ]
    return rows


def test_passages_of_fewer_bytes(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(3)
    rows = substrings.removal_digests(docs).collect()
    assert len(rows) == len(_texts())
    got = {r.doc_id: r.n_shared_words for r in rows}
    assert {i for i, n in got.items() if n} == {0, 1, 4, 5, 6}
    assert 32 <= got[0] == got[1] <= 50 and 64 <= got[4] <= 120 and 32 <= got[6] <= 60
    assert {r.doc_id: r.n_removed for r in rows}[0] == 0  # 249 bytes: less than the contract removes


def test_marks_against_all_windows():
    draw = random.Random(5)
    pool = [_words(100 + i, 80) for i in range(12)]
    texts = []
    for i in range(150):
        parts = _words(1000 + i, draw.randrange(60))
        for _ in range(draw.randrange(3)):
            own, low = draw.choice(pool), draw.randrange(60)
            parts += own[low : low + draw.randrange(20, 80)] + _words(5000 + draw.randrange(10**6), draw.randrange(20))
        texts.append(" ".join(parts))
    h, own, first = substrings.passage_marks([t.encode() for t in texts])
    often = Counter(h.tolist())
    flagged = {o for o, x in zip(own.tolist(), h.tolist()) if often[x] > 1}

    def sharing(n: int) -> set[int]:
        runs = [[tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)] for t in texts]
        count = Counter(r for x in runs for r in x)
        return {i for i, x in enumerate(runs) if any(count[r] > 1 for r in x)}

    assert sharing(substrings.PASSAGE) <= flagged <= sharing(substrings.RUN)
    assert 0 < len(sharing(substrings.PASSAGE)) < len(texts)
    for o, f, x in list(zip(own.tolist(), first.tolist(), h.tolist()))[::50]:  # the same words, the same hash
        alone = " ".join(texts[o].split()[f : f + 32]).encode()
        at, words = substrings.word_hashes(np.frombuffer(alone, np.uint8))
        assert len(at) == 32 and (words == substrings.word_hashes(np.frombuffer(b"\t" + alone, np.uint8))[1]).all()


def test_words_longer_than_a_step(monkeypatch):
    data = np.frombuffer(b"aa " + b"b" * 100 + b" aa\n" + b"b" * 100 + b"\x0bb aa", np.uint8)
    whole = substrings.word_hashes(data)
    monkeypatch.setattr(substrings, "STEP", 8)
    first, h = substrings.word_hashes(data)
    assert first.tolist() == whole[0].tolist() == [0, 3, 104, 107, 208, 210] and (h == whole[1]).all()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
