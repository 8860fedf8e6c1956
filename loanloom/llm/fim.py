"""Fill-in-middle transformation of documents.

A text is cut into units, its lines, and rewritten as prefix, suffix and middle
with a mark before each, so that a model trained on it learns to fill gaps.
Cuts are found word by word: the UTF-8 bytes of a batch of texts are read as
64-bit words, the bytes that end a unit are marked by arithmetic on whole
words, marks are counted by ``bitwise_count``, the running count is searched
for the word that holds a cut, and the cut's byte inside the word is selected
by arithmetic again.  No text is split into a list of units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import by_batch

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rewritten, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7

_U = np.uint64
ONES, HIGH, LOW7 = _U(0x0101010101010101), _U(0x8080808080808080), _U(0x7F7F7F7F7F7F7F7F)


def marks_of(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of every byte of ``words`` that equals ``byte``; exact, no carry leaves a byte."""
    x = words ^ (ONES * _U(byte))
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def starts_of(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that begins a code point: all but 10xxxxxx."""
    return ~(words & HIGH & ~((words << _U(1)) & HIGH)) & HIGH


class Marked:
    """Marked bytes of a buffer: how many stand before a byte, and where the next ones are."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.until = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.until[1:])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes ahead of each offset."""
        word, rest = at >> 3, (at & 7).astype(_U)
        inside = self.marks[np.minimum(word, len(self.marks) - 1)] & ((_U(1) << (rest << _U(3))) - _U(1))
        return self.until[word] + np.bitwise_count(inside)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The offset of each mark, counted from 0."""
        word = np.searchsorted(self.until, nth, side="right") - 1
        wanted = (nth - self.until[word] + 1).astype(_U)
        running = (self.marks[word] >> _U(7)) * ONES  # byte k: marks in bytes 0 to k
        reached = ((running | HIGH) - wanted * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def cut_texts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts ``(large_string)``: units, byte offsets of both cuts, code points of prefix and middle.

    ``first`` and ``second`` are drawn numbers; modulo the units plus 1 they
    say after how many units a text is cut, the smaller one first.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    base = int(offsets[0])
    at = offsets - base
    held = texts.buffers()[2]
    raw = np.zeros((int(at[-1]) >> 3) * 8 + 8, np.uint8)
    if at[-1]:
        raw[: at[-1]] = np.frombuffer(held, np.uint8, int(at[-1]), base)
    words = raw.view("<u8")
    ends = Marked(marks_of(words, 0x0A))
    start, end = at[:-1], at[1:]
    ahead = ends.before(start)
    lines = ends.before(end) - ahead
    units = lines + ((end > start) & (raw[np.maximum(end - 1, 0)] != 0x0A))

    def cut(after: np.ndarray) -> np.ndarray:
        inner = (after > 0) & (after <= lines)
        place = np.where(after > 0, end, start)
        place[inner] = ends.select(ahead[inner] + after[inner] - 1) + 1
        return place

    a, b = first % (units + 1), second % (units + 1)
    one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    points = Marked(starts_of(words))
    at_one = points.before(one)
    return units, one - start, two - start, at_one - points.before(start), points.before(two) - at_one


def _drawn(ident: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex digest of ``seed:id``, as numbers; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must differ and begin with a character that stands nowhere else in any of them.

    Then a mark that is read in an output was written as one: it cannot begin
    in a text's own characters and end in those of a written mark.
    """
    if len({*marks}) != 3 or not all(marks) or any(m[0] in n[1:] for m in marks for n in marks):
        raise ValueError("each mark needs a first character that no mark holds further on")


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    ident: str = "doc_id",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row.

    ``n`` counts lines, ``output`` is the rewritten text.  A null text is
    empty.  Empty texts, texts that hold a mark and those beyond ``rate`` stay
    as they are (form ``plain``, counts null).  The draws depend on the id
    alone, so repeated rows get the same result; a null id draws as the empty
    text.  Other columns are not read.
    """
    check_marks(marks)
    kind = docs.schema[ident].dataType.simpleString()
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2, h3, h4 = _drawn(F.col(ident), seed)
    plain = (F.length(own) == 0) | (h3 % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(own, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    chosen = docs.select(
        F.col(ident).alias("id"), own.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2")
    )
    p, s, m = (mark.encode() for mark in marks)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1).cast(pa.large_string())
        drawn = [rows.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)]
        units, one, two, before, between = cut_texts(texts, *drawn)
        forms = rows.column(2).to_pylist()
        out = []
        for x, shape, i, j in zip(texts.cast(pa.large_binary()), forms, one.tolist(), two.tolist()):
            x = x.as_py()
            if shape == "psm":
                x = b"".join((p, x[:i], s, x[j:], m, x[i:j]))
            elif shape == "spm":
                x = b"".join((s, x[j:], p, x[:i], m, x[i:j]))
            out.append(x)
        none = np.array([shape == "plain" for shape in forms], bool)
        return pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                pa.array(units, pa.int64()),
                rows.column(2),
                pa.array(before, pa.int64(), mask=none),
                pa.array(between, pa.int64(), mask=none),
                pa.array(out, pa.large_binary()).cast(pa.large_string()),
            ],
            ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    names = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return by_batch(chosen, batch, names, text=1).withColumnRenamed("id", ident)


def restored(
    output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> Column:
    """The text that :func:`fill_in_middle` rewrote, from its output and form alone; null if either is."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(a) + (len(first) + len(second) + 1))
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + (len(m) + 1))

    prefix, suffix, middle = parts(p, s)
    last, head, between = parts(s, p)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(head, between, last))
    )


def transformation_digests(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """:func:`fill_in_middle` with digests of the output and of the text rebuilt from it, in place of the output."""
    out = fill_in_middle(docs, text, ident)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(
        ident, "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same result in SQL, from a list of units.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j
  FROM u
), p AS (
  SELECT *, array_to_string(units[1:i], '') AS a, array_to_string(units[i + 1:j], '') AS b, array_to_string(units[j + 1:n], '') AS z FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
         ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
