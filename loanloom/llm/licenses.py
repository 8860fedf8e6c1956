"""License scan by ordered signature rules, in DataFrame functions only.

A text that passes the gate is reduced to its words.  These select the rules
whose keyword begins one of them, only those regexes run on it,
and of overlapping detections the ones that lie within another are suppressed:
the longer interval stays, and of equal intervals the rule of higher priority.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanloom.llm.common import saved

#: Everything that is no letter, digit or character beyond ASCII, in raw text.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrase and label of the base.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label, keyword, name as a regex over words, versions that have labels of their own.
LICENSES = (
    ("gpl", "gnu", "gnu (?:general public licen[sc]e|gpl)", ("1", "2", "3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e", ("2 1", "3")),
    ("lgpl", "library", "gnu library general public licen[sc]e", ("2",)),
    ("lgpl", "lgpl", "lgpl", ("2 1", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ("1", "3")),
    ("agpl", "agpl", "agpl", ("3",)),
    ("gfdl", "documentation", "gnu free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mit", "mit", "mit licen[sc]e", ()),
    ("mit", "expat", "expat licen[sc]e", ()),
    ("x11", "x11", "x11 licen[sc]e", ()),
    ("bsd", "berkeley", "berkeley software distribution licen[sc]e", ()),
    ("bsd", "bsd", "bsd licen[sc]e", ()),
    ("bsd-2-clause", "bsd", "(?:simplified bsd licen[sc]e|2 clause bsd licen[sc]e|bsd 2 clause)", ()),
    ("bsd-3-clause", "bsd", "(?:(?:new|modified|revised|3 clause) bsd licen[sc]e|bsd 3 clause)", ()),
    ("isc", "isc", "isc licen[sc]e", ()),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[sc]e", ("1 0", "2 0")),
    ("cddl", "common", "common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cpl", "common", "common public licen[sc]e", ("1 0",)),
    ("ipl", "ibm", "ibm public licen[sc]e", ("1 0",)),
    ("artistic", "artistic", "artistic licen[sc]e", ("1 0", "2 0")),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", ()),
    ("libpng", "libpng", "libpng licen[sc]e", ("2",)),
    ("bsl", "boost", "boost software licen[sc]e", ("1 0",)),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("beerware", "beerware", "beerware licen[sc]e", ()),
    ("python", "python", "python (?:software foundation )?licen[sc]e", ("2",)),
    ("php", "php", "php licen[sc]e", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby licen[sc]e", ()),
    ("openssl", "openssl", "openssl licen[sc]e", ()),
    ("postgresql", "postgresql", "postgresql licen[sc]e", ()),
    ("w3c", "w3c", "w3c(?: software)? licen[sc]e", ()),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", ()),
    ("eupl", "european", "european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 1", "1 2")),
    ("osl", "open", "open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free licen[sc]e", ("1 1", "2 0", "2 1", "3 0")),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", ()),
    ("ofl", "font", "(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("odbl", "database", "open (?:data commons open )?database licen[sc]e", ("1 0",)),
    ("upl", "permissive", "universal permissive licen[sc]e", ("1 0",)),
    ("mulan", "mulan", "mulan permissive software licen[sc]e", ("1", "2")),
    ("qpl", "q", "q public licen[sc]e", ("1 0",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc0", "zero", "(?:creative commons|cc) zero", ("1 0",)),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", "creative commons attribution", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    ("public-domain", "domain", "(?:in|into|to) the public domain", ()),
)
#: Label, SPDX identifier as words where it is no name of the list above, versions that have labels of their own.
IDENTIFIERS = (
    ("gfdl", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("1 0", "1 1", "2 0")),
    ("mit", "mit(?! 0)", ()),
    ("x11", "x11", ()),
    ("isc", "isc", ()),
    ("epl", "epl", ("1 0", "2 0")),
    ("cddl", "cddl", ("1 0", "1 1")),
    ("cpl", "cpl", ("1 0",)),
    ("ipl", "ipl", ("1 0",)),
    ("artistic", "artistic", ("1 0", "2 0")),
    ("zlib", "zlib", ()),
    ("libpng", "libpng", ("2 0",)),
    ("bsl", "bsl", ("1 0",)),
    ("beerware", "beerware", ()),
    ("python", "(?:python|psf)", ("2 0",)),
    ("php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", ()),
    ("openssl", "openssl", ()),
    ("postgresql", "postgresql", ()),
    ("w3c", "w3c", ()),
    ("ms-pl", "ms pl", ()),
    ("ms-rl", "ms rl", ()),
    ("osl", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "afl", ("1 1", "2 0", "2 1", "3 0")),
    ("ncsa", "ncsa", ()),
    ("ofl", "ofl", ("1 0", "1 1")),
    ("odbl", "odbl", ("1 0",)),
    ("upl", "upl", ("1 0",)),
    ("mulan", "mulanpsl", ("1 0", "2 0")),
    ("qpl", "qpl", ("1 0",)),
)
#: Label, keyword, characteristic sentence of a notice that need not name its license.
NOTICES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsl", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[sc]e"),
)
#: Words that may stand between the grant's verb and the name.
TERMS = "(?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
VERBS = "(?:dual )?(?:licen[sc]ed|released|distributed|available|published|redistributed|provided)"


@dataclass(frozen=True)
class Rule:
    """``priority``: a lower number wins; ``weight``: how far the form is to be trusted."""

    label: str
    keyword: str
    regex: str
    priority: int
    weight: float
    base: bool = False


def signatures() -> list[Rule]:
    """All rules in order: identifiers, grants, versions, plain mentions, notices, the base's phrases."""
    out = []
    for label, keyword, name, versions in LICENSES:
        out.append(Rule(label, keyword, f"spdx licen[sc]e identifier {name}", 0, 1.0))
        out.append(Rule(label, keyword, f"{VERBS} under {TERMS}{name}", 1, 0.95))
        for v in versions:
            number = f"(?:{name})(?: v| version| or)? ?v?{v}"
            own = f"{label}-{v.replace(' ', '.')}"
            out.append(Rule(own, keyword, f"spdx licen[sc]e identifier {number}", 0, 1.0))
            out.append(Rule(own, keyword, f"{VERBS} under {TERMS}{number}", 1, 1.0))
            out.append(Rule(own, keyword, number, 2, 0.9))
        out.append(Rule(label, keyword, name, 3, 0.7))
    for label, name, versions in IDENTIFIERS:
        form = f"spdx licen[sc]e identifier {name}"
        out.append(Rule(label, "spdx", form, 0, 1.0))
        out += [Rule(f"{label}-{v.replace(' ', '.')}", "spdx", f"{form} {v}", 0, 1.0) for v in versions]
    out += [Rule(label, keyword, sentence, 1, 0.9) for label, keyword, sentence in NOTICES]
    out += [Rule(label, phrase.split(" ")[0], phrase, 4, 0.7, True) for phrase, label in BASE]
    return out


def gate() -> str:
    """A text without a match of this holds no phrase of any rule: all others hold ``licen[sc]``."""
    free = {x for _, _, x, _ in LICENSES} | {x for _, _, x in NOTICES} | {x for x, _ in BASE}
    free = sorted(x for x in free if not x.endswith(("licen[sc]e", "license")))
    raw = (x.replace(" ?", GAP + "*").replace(" ", GAP + "+") for x in free)
    return f"(?i)licen[sc]|(?:^|{GAP})(?:{'|'.join(raw)})"


def _rule_table(spark: SparkSession) -> DataFrame:
    rows = [(k, r.label, r.keyword, f"(?<= )(?:{r.regex})(?= )", r.priority, r.weight, r.base)
            for k, r in enumerate(signatures())]
    schema = "rule int, label string, keyword string, regex string, priority int, weight double, base boolean"
    return spark.createDataFrame(rows, schema)


def _spaces(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``.

    ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``
    and ``detections``, the intervals ``(label, first, end, weight)`` that were
    not suppressed.  Without a detection the labels are empty text and the score
    is 0, else it is the largest weight.  A null text is an empty one.  Repeated
    rows and null ids give a row each; other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lowered = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ends = F.substring(body, 1, 1).rlike(GAP).cast("long") + F.substring(body, -1, 1).rlike(GAP).cast("long")
    spaced = F.concat(F.lit(" "), F.regexp_replace(lowered, GAP + "+", " "), F.lit(" "))
    rows = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),  # fixed from here on, as the table is written
            F.col(ident).alias("id"),
            F.when(body == "", 0).otherwise(F.size(F.split(body, GAP + "+")) - ends).cast("long").alias("n_words"),
            F.when(body.rlike(gate()), F.regexp_replace(spaced, "^ +| +$", " ")).alias("spaced"),
        )
    )
    rules = _rule_table(docs.sparkSession)
    keywords = sorted({r.keyword for r in signatures()})
    # a version may be joined to the keyword, which then only begins the word
    held = F.array_compact(F.array(*(F.when(F.contains("spaced", F.lit(f" {k}")), F.lit(k)) for k in keywords)))
    tried = (
        rows.filter("spaced IS NOT NULL")
        .select("row", "spaced", F.explode(held).alias("keyword"))
        .join(F.broadcast(rules), "keyword")  # as many rows as there are rules
    )
    parts = tried.select(
        *["row", "rule", "label", "priority", "weight", "base"],
        F.regexp_extract_all("spaced", "regex", F.lit(0)).alias("hits"),
        F.split("spaced", F.col("regex")).alias("between"),
    ).filter(F.size("hits") > 0)
    so_far = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = (
        parts.select(
            *["row", "rule", "label", "priority", "weight", "base"],
            F.posexplode(F.arrays_zip(F.col("hits").alias("hit"), F.col("between").alias("gap"))).alias("nth", "part"),
        )
        .filter("part.hit IS NOT NULL")
        .select("*", _spaces(F.col("part.hit")).alias("inside"), _spaces(F.col("part.gap")).alias("outside"))
        .select("*", (F.sum(F.col("inside") + F.col("outside")).over(so_far) - F.col("inside") - 1).alias("first"))
        .select(
            *["row", "label", "priority", "weight", "base", "rule"],
            F.col("first").cast("long").alias("first"),
            (F.col("first") + F.col("inside") + 1).cast("long").alias("end"),
        )
    )
    longest = Window.partitionBy("row").orderBy("first", F.desc("end"), "priority", "rule")
    seen = F.max("end").over(longest.rowsBetween(Window.unboundedPreceding, -1))
    kept = each.withColumn("stays", F.coalesce(seen, F.lit(-1)) < F.col("end"))
    found = kept.groupBy("row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_set"),
        F.array_sort(F.collect_set(F.when(F.col("base") | F.col("stays"), F.col("label")))).alias("all_set"),
        F.max(F.when(F.col("base") | F.col("stays"), F.col("weight"))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("first", "end", "label", "weight")))).alias(
            "detections"
        ),
    )
    return rows.drop("spaced").join(found, "row", "left").select(
        F.col("id").alias(ident),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base_set", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all_set", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "detections",
    )
