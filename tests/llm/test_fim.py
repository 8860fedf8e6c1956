"""Fill-in-middle: against SQL over lists of units, and against a plain cut of every text."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanloom.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, id string, h1 long"


def _plain(ident, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return ident, n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, z = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < suffix_first:
        return ident, n, "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return ident, n, "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


TEXTS = [
    "one\ntwo\nthree", "one\n", "\n", "\n\n\n", "no line end", "", None, "é\nüü\n漢字\n🙂🙂\n", "has <S> inside\nx", "<\nP>\n<P", "<\n<S\n>",
    "a\n" * 3000, "x" * 70_000 + "\n" + "é" * 9 + "\n" + "y" * 70_000, "\r\nab\r\n", "8 bytes\n8 bytes\n", "ends <P\n",
]
ROWS = [(i, t, 1, "f", "i", 3) for i, t in enumerate(TEXTS * 6)]
ROWS += [ROWS[0], ROWS[0], (None, "null id\nb\n", None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def _key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("rate,suffix_first", [(100, 50), (60, 0), (0, 100)])
def test_equals_plain_cut(docs, rate, suffix_first):
    out = fim.fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    got = sorted(map(tuple, out.collect()), key=_key)
    assert got == sorted((_plain(r[0], r[1], 7, rate, suffix_first) for r in ROWS), key=_key)
    rebuilt = out.select("doc_id", fim.restored(out.output, out.form).alias("t")).collect()
    assert sorted(map(tuple, rebuilt), key=_key) == sorted(((r[0], r[1] or "") for r in ROWS), key=_key)


def test_other_marks_and_seed(docs):
    marks = ("[prefix>", "[suffix>", "{middle}")
    out = fim.fill_in_middle(docs.filter("doc_id < 16"), seed=8, marks=marks)
    rows = out.withColumn("t", fim.restored(out.output, out.form, marks)).collect()
    assert {r.doc_id: r.t for r in rows} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert any(r.form != "plain" and "<S>" in r.output for r in rows)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S>", ""), ("<P>", "<S>", "M<"), ("|P|", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=bad)


def test_empty_table(docs):
    assert fim.transformation_digests(docs.limit(0)).count() == 0


def test_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = fim.transformation_digests(spark.read.parquet(f"{data}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(fim.SQL).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab\né🙂", max_size=40), st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=6), st.integers(0, 2))
def test_cuts_of_any_batch(rows, skipped):
    whole = pa.array(["pad\n"] * skipped + [r[0] for r in rows], pa.large_string())
    import numpy as np

    texts = whole.slice(skipped)
    found = fim.cut_texts(texts, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    for (text, a, b), n, one, two, before, between in zip(rows, *(x.tolist() for x in found)):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        i, j = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        head, middle = "".join(units[:i]), "".join(units[i:j])
        assert (n, one, two, before, between) == (
            len(units), len(head.encode()), len((head + middle).encode()), len(head), len(middle),
        )
