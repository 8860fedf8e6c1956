"""The corpus queries in SQL, by brute force, where SQL can say them."""

from loanloom.llm.quality import LEAST_WORDS, MOST_REPEATED, RULES, STRATA

#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

#: The smallest node that each node of ``link(a, b)`` reaches, itself included; nodes without links are left out.
_REACHED = """
sided AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS other FROM sided UNION SELECT r.node, l.b FROM reach r JOIN sided l ON r.other = l.a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), f AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY shingle) > 1
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, max(x.n) AS m, max(y.n) AS n, count(*) AS c
  FROM f x JOIN f y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (m + n - c)
), {_REACHED}
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM s LEFT JOIN root ON doc_id = node
"""

EMBEDDING_LINKS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95
), {_REACHED}, many AS (SELECT a AS node, count(*) AS n FROM sided GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN root ON vec_id = root.node LEFT JOIN many ON vec_id = many.node
"""


def _quality(risk: float = 0.05, error: float = 0.05) -> str:
    sign = {r.name: r.sign for r in RULES}
    share = {r.name: f"{r.sign}e0 * {r.share[0]} / nullif({r.share[1]}, 0)" for r in RULES}
    level = lambda r: " + ".join(f"CASE WHEN {share[r.name]} > {sign[r.name] * c}e0 THEN 1 ELSE 0 END" for c in r.cutoffs)
    levels = " UNION ALL ".join(f"SELECT stratum, quality, '{r.name}' AS rule, {level(r)} AS level FROM known" for r in RULES)
    steps = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {k} AS level, {c}e0 AS cutoff" for r in RULES for k, c in enumerate(r.cutoffs, 1))
    tests = (len(STRATA) + 1) * sum(len(r.cutoffs) for r in RULES)
    rejected = " OR ".join(
        f"coalesce({share[r.name]} > {r.sign} * (SELECT cutoff FROM best b WHERE b.stratum = m.stratum AND rule = '{r.name}'), false)" for r in RULES
    )
    p = risk / len(RULES)
    names = ", ".join(f"'{x}'" for x in STRATA)
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words,
    CASE WHEN lang IN ({names}) THEN lang ELSE 'other' END AS stratum FROM documents
), windows AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, win) > 1
), repeated AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY 1
), held AS (
  SELECT w.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n, 0) AS repeat_words
  FROM w LEFT JOIN repeated r ON w.row = r.row
), m AS (
  SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(repeat_words AS BIGINT) AS n_repeat_words,
    len(words) < {LEAST_WORDS} OR 100 * repeat_words > {MOST_REPEATED} * len(words) AS base_failed FROM held
), known AS (
  SELECT m.*, quality FROM m JOIN (SELECT doc_id AS l, min(quality) AS quality FROM labels GROUP BY 1) ON doc_id = l WHERE quality IN (0, 1)
), leveled AS ({levels}
), step AS ({steps}
), tested AS (
  SELECT stratum, s.rule, s.level, any_value(cutoff) AS cutoff, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad,
    count(*) FILTER (quality = 1 AND l.level >= s.level) AS k, count(*) FILTER (quality = 0 AND l.level >= s.level) AS hit
  FROM leveled l JOIN step s ON l.rule = s.rule GROUP BY 1, 2, 3
), risky AS (
  SELECT *, CASE WHEN good > 0 AND k < good * {p}e0 THEN list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln({p}e0) + (good - j) * ln(1 - {p}e0)))) ELSE 1 END AS p,
    hit / greatest(bad, 1) - k / greatest(good, 1) AS gain FROM tested
), best AS (
  SELECT stratum, rule, cutoff FROM risky WHERE p <= {error / tests!r} AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, level) = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {rejected}) AS kept FROM m
"""


QUALITY = _quality()


#: crc32 of ASCII text ``{0}``, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda p: CAST(ascii(substr({0}, p, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END)), CAST(4294967295 AS BIGINT))"""
_BARE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
#: Up to two empty turns behind a label; a third would only bring back the role of the first.
_INSERTED = """
SELECT conv_id, i, q, cost, audit, written FROM {0}
UNION ALL SELECT conv_id, i, w, cost + 3, audit || 'I', list_append(written, name || ':') FROM {0} JOIN follows USING (q)
UNION ALL SELECT conv_id, i, v.w, cost + 6, audit || 'II', list_append(list_append(written, u.name || ':'), v.name || ':')
  FROM {0} JOIN follows u USING (q) JOIN follows v ON u.w = v.q
"""

CONVERSATIONS = f"""
WITH RECURSIVE follows(q, w, name) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), drawn AS (SELECT *, {_CRC32.format('key')} % 20 AS draw FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE draw WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place, {_BARE} AS bare FROM damaged
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair FROM ordered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY 1
), every AS (SELECT DISTINCT conv_id FROM conversations
), start AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS written FROM every
), label(conv_id, i, q, cost, audit, written) AS (
  SELECT * FROM ({_INSERTED.format('start')})
  UNION ALL
  SELECT * FROM (
    WITH edited AS (
      SELECT l.conv_id, l.i + 1 AS i, unnest([
        {{'q': l.q, 'cost': l.cost + 4, 'audit': l.audit || 'D', 'written': l.written}},
        CASE WHEN fault NOT IN ('blank', 'duplicate') AND (left(role, 1) = f.w OR (l.q = '' AND left(role, 1) = 's'))
          THEN {{'q': left(role, 1), 'cost': l.cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'audit': l.audit || 'K',
                'written': list_append(l.written, role || ':' || text)}} END,
        CASE WHEN fault NOT IN ('blank', 'duplicate')
          THEN {{'q': f.w, 'cost': l.cost + 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'audit': l.audit || 'R',
                'written': list_append(l.written, f.name || ':' || text)}} END]) AS e
      FROM label l JOIN follows f ON l.q = f.q JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.place = l.i + 1
    ), flat AS (SELECT conv_id, i, e.q AS q, e.cost AS cost, e.audit AS audit, e.written AS written FROM edited WHERE e IS NOT NULL
    ), grown AS ({_INSERTED.format('flat')})
    SELECT conv_id, i, q, cost, audit, written FROM grown QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
  )
), best AS (
  SELECT l.conv_id, cost, audit, written FROM label l LEFT JOIN counted c ON l.conv_id IS NOT DISTINCT FROM c.conv_id
  WHERE l.i = coalesce(n, 0) AND q IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY l.conv_id ORDER BY cost, audit) = 1
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(written, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counted c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
