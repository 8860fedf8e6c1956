"""Quality rules whose cutoffs come with a guarantee, in DataFrame functions only.

Each rule rejects texts beyond a cutoff.  A cutoff may be used in a stratum
only if labelled texts show that it rejects few good ones: the exact binomial
probability of so few false rejections, if their true share were the allowed
one, must be below the error level shared among all cutoffs, rules and strata
(Bonferroni).  The allowed share itself is shared among the rules, so that all
rules together keep within it.  Of the cutoffs that may be used the one that
tells bad from good best is taken; without one, the rule is off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import WORD_GAP, fresh, saved

WHITE = " \t\n\x0b\x0c\r"
#: Words that every text needs, and the most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Rule:
    """Rejects where ``sign * share > sign * cutoff``; cutoffs from loose to strict."""

    name: str
    share: tuple[str, str]
    cutoffs: tuple[float, ...]
    sign: int = 1


RULES = (
    Rule("symbols", ("n_symbols", "word_chars"), (0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04)),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    Rule("repeats", ("n_repeat_words", "n_words"), (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("long_words", ("word_chars", "n_words"), (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    Rule("short_words", ("word_chars", "n_words"), (1.5, 2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0), -1),
)
#: Strata by language; any other and a missing language share one.
STRATA = ("en", "de", "fr", "es")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def _covered(s: Column) -> Column:
    """Words in windows that have an equal neighbour in ``s``, the windows sorted by content."""
    same = lambda e, j: (F.get(s, j - 1)["w"] == e["w"]) | (F.get(s, j + 1)["w"] == e["w"])
    found = F.filter(s, lambda e, j: F.coalesce(same(e, j), F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda e: F.sequence(e["i"], e["i"] + 2)))))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice.

    Hashes show texts without a repeated window; for the others windows are
    compared as text.
    """
    at = F.sequence(F.lit(0), F.size(w) - 3)
    window = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
    hashed = F.transform(at, lambda i: F.xxhash64(*window(i)))
    spelled = F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))
    none_twice = _let(hashed, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) < 4, 0).when(none_twice, 0).otherwise(_let(F.sort_array(spelled), _covered))


def with_measures(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """``docs`` and a struct of counts over the whole text.

    A null text has no words and no lines.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    of_words = _let(
        _words(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = _let(
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    n_symbols = F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")
    parts = F.struct(of_words.alias("w"), of_lines.alias("l"), n_symbols)
    # inline keeps the optimizer from writing the long expressions out once per field
    held = fresh(docs, "parts")
    rows = docs.select(*docs.columns, F.inline(F.array(F.struct(parts.alias(held)))))
    fields = F.expr(
        f"named_struct('n_words', {held}.w.n_words, 'word_chars', {held}.w.word_chars, 'n_symbols', {held}.n_symbols,"
        f" 'n_lines', {held}.l.n_lines, 'n_dup_lines', {held}.l.n_dup_lines, 'n_repeat_words', {held}.w.n_repeat_words,"
        f" 'base_failed', {held}.w.n_words < {LEAST_WORDS}"
        f" OR 100 * {held}.w.n_repeat_words > {MOST_REPEATED} * {held}.w.n_words)"
    )
    return rows.select(*docs.columns, fields.alias(name))


def _beyond(rule: Rule, cutoff: str, of: str = "") -> str:
    share = f"{rule.sign} * try_divide(double({of}{rule.share[0]}), double({of}{rule.share[1]}))"
    return f"coalesce({share} > {rule.sign} * {cutoff}, false)"


def _log_gamma(x: str) -> str:
    """Stirling's series at x + 8, brought back by the recurrence."""
    y = f"({x} + 8)"
    series = f"1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7))"
    back = " - ".join(f"ln({x} + {k})" for k in range(8))
    return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + {series} - {back})"


def binomial_at_most(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X of n trials at p, for k below n * p; else 1, which no test accepts.

    The terms fall from k downwards; those further than twelve deviations add
    nothing that a double could hold.
    """
    k, n = f"double({k})", f"double({n})"
    first = (
        f"exp({_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')}"
        f" + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"
    )
    terms = f"bigint(least({k}, ceil(12 * sqrt({n} * {p}D)) + 60))"
    walked = (
        f"aggregate(sequence(0L, {terms}), struct(1D AS term, 0D AS total), (a, j) -> struct("
        f"a.term * ({k} - j) / ({n} - {k} + j + 1) * {(1 - p) / p}D AS term, a.total + a.term AS total)).total"
    )
    return F.expr(f"CASE WHEN {n} > 0 AND {k} < {n} * {p}D THEN {first} * {walked} ELSE 1D END")


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise(F.lit("other"))


def fit_cutoffs(
    labelled: DataFrame, risk: float = 0.05, error: float = 0.05, good: str = "quality"
) -> DataFrame:
    """``(stratum, <rule> ...)``: one row per stratum with labelled rows, one cutoff or null per rule.

    ``labelled`` has the measures, ``stratum`` and the label of each text.  With probability
    ``1 - error`` no stratum's rules reject more than ``risk`` of its good
    texts.
    """
    levels = ", ".join(
        f"struct('{r.name}' AS rule, {' + '.join(f'int({_beyond(r, f"{c}D")})' for c in r.cutoffs)} AS level)"
        for r in RULES
    )
    cutoffs = ", ".join(f"'{r.name}', array({', '.join(f'{c}D' for c in r.cutoffs)})" for r in RULES)
    by_rule = Window.partitionBy("stratum", "rule")
    stricter = by_rule.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        labelled.filter(F.col(good).isin(0, 1))
        .select("stratum", good, F.expr(f"inline(array({levels}))"))
        .groupBy("stratum", "rule", "level")
        .agg(F.count(F.when(F.col(good) == 1, 1)).alias("g"), F.count(F.when(F.col(good) == 0, 1)).alias("b"))
    )
    # every level of a stratum's rule, also those that no text stops at
    grid = found.select("stratum", "rule").distinct().select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(max(len(r.cutoffs) for r in RULES)))).alias("level")
    )
    tests = (len(STRATA) + 1) * sum(len(r.cutoffs) for r in RULES)
    each = (
        grid.join(found, ["stratum", "rule", "level"], "left")
        .fillna(0, ["g", "b"])
        .select(
            *["stratum", "rule", "level"],
            F.sum("g").over(by_rule).alias("good"),
            F.sum("b").over(by_rule).alias("bad"),
            F.sum("g").over(stricter).alias("k"),
            F.sum("b").over(stricter).alias("hit"),
        )
        .filter("level > 0")
        .withColumn("cutoff", F.expr(f"get(map({cutoffs})[rule], level - 1)"))
        .withColumn("p", binomial_at_most("k", "good", risk / len(RULES)))
        .withColumn("gain", F.col("hit") / F.greatest("bad", F.lit(1)) - F.col("k") / F.greatest("good", F.lit(1)))
        .filter((F.col("p") <= error / tests) & (F.col("gain") > 0) & F.col("cutoff").isNotNull())
    )
    best = F.max_by("cutoff", F.struct(F.col("gain"), -F.col("level")))
    return each.groupBy("stratum").pivot("rule", [r.name for r in RULES]).agg(best)


def _cutoffs(measured: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """``measured``: id, stratum and the measures."""
    known = labels.select(F.col("doc_id").alias("id"), "quality").groupBy("id").agg(F.min("quality").alias("quality"))
    return fit_cutoffs(measured.join(known, "id"), risk, error)


def _reason() -> Column:
    """The first rule that rejects, of the columns ``m`` (measures) and ``cut``; null if none does."""
    beyond = ", ".join(
        f"CASE WHEN {_beyond(r, f'cut.{r.name}', 'm.')} THEN '{r.name}' END" for r in RULES
    )
    return F.expr(f"CASE WHEN m.base_failed THEN 'base' ELSE coalesce({beyond}) END")


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    cut = cutoffs.select("stratum", F.struct(*[r.name for r in RULES]).alias("cut"))
    return rows.join(F.broadcast(cut), "stratum", "left")  # a row for each stratum


def apply_quality(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = 0.05,
    error: float = 0.05,
    text: str = "text",
    ident: str = "doc_id",
    lang: str = "lang",
) -> DataFrame:
    """``(id, lang, measures, base_failed, kept, rejected_by)`` for every row of ``docs``.

    Null and empty texts have no words and fail the base.  Null ids have no
    label but are judged; a null language belongs to the stratum "other".  An
    id labelled twice counts as bad if any label says so.  No labels: only the
    base rejects.  Repeated rows give a row each; other columns are not read.
    """
    chosen = docs.select(F.col(ident).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = with_measures(chosen, name="m").select("id", "lang", "m", stratum().alias("stratum"))
    measured = saved(measured)
    cutoffs = _cutoffs(measured.select("id", "stratum", "m.*"), labels, risk, error)
    judged = _with_cutoffs(measured, cutoffs).withColumn("rejected_by", _reason())
    return judged.select(
        F.col("id").alias(ident), F.col("lang").alias(lang), "m.*", "rejected_by", F.col("rejected_by").isNull().alias("kept")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that :func:`apply_quality` keeps, with their columns.

    Nulls, repeated rows, ids labelled twice and empty texts are judged as
    there; whole texts are measured, however long.  Columns of any name are
    handed through.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    measured = with_measures(rows, name="m").select("doc", "m", stratum("doc.lang").alias("stratum"))
    # the measures are taken twice: to write the texts, or to shuffle the labelled ones, takes more disk
    cutoffs = saved(_cutoffs(measured.select(F.col("doc.doc_id").alias("id"), "stratum", "m.*"), labels, risk, error))
    return _with_cutoffs(measured, cutoffs).filter(_reason().isNull()).select("doc.*")
