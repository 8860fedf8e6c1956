"""Every operator on tables with nulls, repeats, empty and long texts, and clashing column names."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loanloom.llm import bpe, embeddings, licenses, lm, neardup, packing, quality, secrets, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, id string, row long, digest int"
LABELS = "doc_id long, quality int, toxic int"


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def _documents():
    rng = random.Random(11)
    base = _words(rng, 150)
    passage = _words(rng, 90)
    near = base.split(" ")
    near[70] = "changed"
    texts = [
        base, base, " ".join(near), None, "", " \n\t", "short text", _words(rng, 30) + " " + passage,
        _words(rng, 40) + " " + passage + " " + _words(rng, 20), "é" * 500, "word " * 400, _words(rng, 5000),
        "Licensed under the Apache License, Version 2.0. token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"",
    ]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "x", "y", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "short text", "en", None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(13)] + [(None, 1, 1), (2, None, None), (3, 0, 1)]
    return spark.createDataFrame(rows, LABELS)


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PER_ROW = {
    "toxicity": lambda d, s: toxicity.score_toxicity(d, s),
    "quality": lambda d, s: quality.apply_quality(d, s),
    "neardup": lambda d, s: neardup.link_near_duplicates(d),
    "licenses": lambda d, s: licenses.scan_licenses(d),
    "lm": lambda d, s: lm.score_texts(d),
    "bpe": lambda d, s: bpe.round_trip_digests(d, RANKS),
    "substrings": lambda d, s: substrings.removal_digests(d),
    "secrets": lambda d, s: secrets.scan_secrets(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(docs, labels, name):
    rows = PER_ROW[name](docs, labels).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in _documents()), key=key)
    assert PER_ROW[name](docs.limit(0), labels.limit(0)).count() == 0


def test_near_duplicates_and_repeats(docs):
    found = {r.doc_id: r for r in neardup.link_near_duplicates(docs).collect()}
    assert [found[i].component_id for i in (0, 1, 2, 3, 5)] == [0, 0, 0, 3, 5]
    assert found[3].n_shingles == 0 and found[6].n_shingles == 1 and found[6].component_id == 6
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and not {1, 2} & set(ids) and ids.count(3) == 1 and ids.count(6) == 1

    texts = [(r[1] or "").encode() for r in _documents()]
    starts = {}
    for x in texts:
        for k in range(len(x) - 399):
            starts[x[k : k + 400]] = starts.get(x[k : k + 400], 0) + 1
    want = []
    for x in texts:
        gone = bytearray(len(x))
        for k in range(len(x) - 399):
            if starts[x[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want.append((len(x), sum(gone)))
    assert sorted((r.n_bytes, r.n_removed) for r in substrings.removal_digests(docs).collect()) == sorted(want)
    cut = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert cut[3].text is None and cut[6].text == "short text" and cut[1].text == "" and cut[9].text == ""
    assert cut[0].node == "x" and cut[0].digest == 2


def test_licenses_and_secrets(docs):
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    r = found[12]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (1, 3, 3, "apache", "apache,apache-2.0")
    assert found[3].labels == "" and found[3].score == 0 and found[3].n_words == 0
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert masked[12].endswith("2.0. [secret]\"") and masked[3] is None


def test_licence_spellings(spark):
    cases = {
        "Released under GPLv3": "gpl-3", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "WTFPLv2": "wtfpl-2", "Released under the MPL 2.0": "mpl-2.0",
        "under EUPL 1.2": "eupl-1.2", "BSD-3-Clause": "bsd-3-clause", "CC Zero": "cc0", "an example of simple words": "",
    }
    table = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scan_licenses(table).collect()}
    assert {x: found[i] for i, x in enumerate(cases)} == cases


def test_licence_identifiers_and_notices(spark):
    tags = {"MIT": "mit", "Apache-2.0": "apache-2.0", "ISC": "isc", "Zlib": "zlib", "EPL-2.0": "epl-2.0", "CDDL-1.0": "cddl-1.0",
            "PostgreSQL": "postgresql", "BSL-1.0": "bsl-1.0", "OFL-1.1": "ofl-1.1", "Artistic-2.0": "artistic-2.0"}
    cases = {f"// SPDX-License-Identifier: {x}\ncode": label for x, label in tags.items()}
    cases |= {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,": "isc",
    }
    table = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(table).collect()}
    assert all(label in found[i] for i, label in enumerate(cases.values())), found


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.01]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]),
            (6, [1.0, None]), (7, [0.0, 1.0]), (None, [1.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link_vectors(table).collect()}
    assert found[0] == (3, 0, True) and found[1] == (3, 0, False) and found[2] == (3, 0, False)
    for i in (3, 4, 5, 6, 7, 9, 10):
        assert found[i] == (0, i, True)
    assert found[None] == (3, 0, False)
    assert embeddings.link_vectors(table.limit(0)).count() == 0


def test_links_between_dense_groups(spark):
    rng = np.random.default_rng(8)
    first, aside = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    second = 0.965 * first + np.sqrt(1 - 0.965**2) * aside
    x = np.concatenate([c + 0.004 * rng.standard_normal((60, 64)) for c in (first, second)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert true.mean() > 110
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embeddings.link_vectors(table).collect()}
    assert [found[i].n_links for i in range(120)] == true.tolist()
    assert {r.component_id for r in found.values()} == {0}


def test_recall_binds_where_few_vectors_have_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 32))
    x[7], x[211] = x[150], x[33]
    x[7, 0] += 0.5
    x[211, 0] += 0.5
    none = embeddings._lists(spark.createDataFrame([], "a long, b long, cosine double"), None, 0.95)
    monkeypatch.setattr(embeddings, "first_graph", lambda *_: none.select("a", "b", "cosine"))  # a graph that finds nothing
    monkeypatch.setattr(embeddings, "MOST_ROUNDS", 2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embeddings.link_vectors(table).collect()}
    assert {i: r.component_id for i, r in found.items() if r.n_links} == {7: 7, 150: 7, 33: 33, 211: 33}


def test_tables_grow_with_the_hyperplanes():
    same = 1 - np.arccos(0.95) / np.pi
    assert all(1 - (1 - same**bits) ** embeddings.tables(bits, 0.95) >= 0.9 for bits in range(30))


def test_packing_covers_every_row(docs):
    rows = packing.pack(docs, RANKS).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_binomial_bound(spark):
    from math import comb

    p = 0.01
    rows = spark.createDataFrame([(0, 2000), (5, 2000), (19, 2000), (30, 2000), (0, 0)], "k long, n long")
    got = [r.p for r in rows.select(quality.binomial_at_most("k", "n", p).alias("p")).collect()]
    want = [sum(comb(2000, i) * p**i * (1 - p) ** (2000 - i) for i in range(k + 1)) for k in (0, 5, 19)]
    assert all(abs(a - b) < 1e-9 * b for a, b in zip(got, want)) and got[3:] == [1.0, 1.0]


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
    assert {r.doc_id for r in now.collect()} <= {0, 7, 8, 11}
