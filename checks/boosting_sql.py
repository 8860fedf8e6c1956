"""Boosted trees spelt out in SQL, round by round and level by level, for the oracles."""

from checks.registry import oracle
from loanloom.operators.boosting import CELLS, UNIT, Settings
from loanloom.plans.default_model import CATEGORIES, LOGGED, NUMBERS


def draw(seed: int) -> str:
    return f"CAST('0x' || substr(md5(loan_id || '#{seed}'), 1, 12) AS BIGINT) / 281474976710656.0e0"


def _rows(known: str) -> dict[str, str]:
    """``parted``: every labelled loan with its part; ``known`` tells which ones are split into train and test."""
    logs = ", ".join(f"{'-' if s < 0 else ''}ln({c}) AS log_{c}" for c, s in LOGGED.items())
    vintage = "SELECT loan_id AS vintage_of, substr(orig_dte, 4, 4) AS orig_year FROM acq"
    return {
        "drawn": f"SELECT *, {logs}, {draw(0)} AS split_draw, {known} AS is_known FROM located JOIN ({vintage}) ON loan_id = vintage_of",
        "parted": """SELECT *, CASE WHEN NOT is_known THEN 'late'
            WHEN row_number() OVER (PARTITION BY is_known, label ORDER BY split_draw) <= round(count(*) OVER (PARTITION BY is_known, label) * 0.25e0)
            THEN 'test' ELSE 'train' END AS part FROM drawn""",
    }


def _features() -> dict[str, str]:
    numbers = " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS name, NULL AS of, NULL AS level" for k, c in enumerate(NUMBERS))
    texts = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS of, part, loan_id, CAST({c} AS VARCHAR) AS level FROM parted" for i, c in enumerate(CATEGORIES)
    )
    wide = " UNION ALL ".join(f"SELECT loan_id, part, {k} AS k, CAST({c} AS DOUBLE) AS x FROM parted" for k, c in enumerate(NUMBERS))
    return {
        "texts": texts,
        "levels": """SELECT i, of, level FROM (SELECT DISTINCT i, of, level FROM texts WHERE part = 'train' AND level IS NOT NULL)
            QUALIFY row_number() OVER (PARTITION BY of ORDER BY level) > 1""",
        "feature": f"""{numbers} UNION ALL SELECT {len(NUMBERS)} - 1 + row_number() OVER (ORDER BY i, level),
            of || '_' || regexp_replace(level, '[^0-9A-Za-z]+', '_', 'g'), of, level FROM levels""",
        "long": f"""{wide} UNION ALL SELECT loan_id, part, k, CASE WHEN t.level = f.level THEN 1.0e0 ELSE 0.0e0 END
            FROM texts t JOIN feature f ON t.of = f.of""",
        "vals": """SELECT k, x, count(*) AS n FROM long WHERE part = 'train' AND x IS NOT NULL GROUP BY 1, 2""",
        "ranks": """SELECT k, x, sum(n) OVER (PARTITION BY k ORDER BY x) - n AS n_before, sum(n) OVER (PARTITION BY k) AS n_total,
            count(*) OVER (PARTITION BY k) AS many FROM vals""",
        "starts": f"""SELECT k, start, row_number() OVER (PARTITION BY k ORDER BY start) AS cell FROM
            (SELECT k, min(x) AS start FROM ranks
             GROUP BY k, CASE WHEN many <= {CELLS} THEN x ELSE floor(n_before * {CELLS} / n_total) END)""",
        "cells": """SELECT l.loan_id, l.k, CASE WHEN l.x IS NULL THEN 0 ELSE coalesce(s.cell, 1) END AS cell
            FROM long l ASOF LEFT JOIN starts s ON l.k = s.k AND l.x >= s.start""",
    }


def _strength(g: str, h: str, s: Settings) -> str:
    return f"(({g}) / {UNIT:.1f}e0) * (({g}) / {UNIT:.1f}e0) / (({h}) / {UNIT:.1f}e0 + {s.penalty}e0)"


def _gains(sums: str, s: Settings) -> str:
    least = s.least_weight * UNIT
    ways = " UNION ALL ".join(
        f"""SELECT node, k, cell, {left} AS missing_left, g_until{minus_g} AS gl, h_until{minus_h} AS hl,
        g_all - (g_until{minus_g}) AS gr, h_all - (h_until{minus_h}) AS hr FROM tried WHERE cell > 0"""
        for left, minus_g, minus_h in (("false", " - g_gap", " - h_gap"), ("true", "", ""))
    )
    totals = ", ".join(
        f"""sum({x}) OVER (PARTITION BY node, k) AS {x}_all, sum(CASE WHEN cell = 0 THEN {x} ELSE 0 END) OVER (PARTITION BY node, k) AS {x}_gap,
        sum({x}) OVER (PARTITION BY node, k ORDER BY cell) AS {x}_until"""
        for x in "gh"
    )
    return f"""WITH tried AS (SELECT node, k, cell, {totals} FROM {sums}), ways AS ({ways})
        SELECT *, {_strength('gl', 'hl', s)} + {_strength('gr', 'hr', s)} - {_strength('gl + gr', 'hl + hr', s)} AS gain
        FROM ways WHERE hl >= {least:.1f}e0 AND hr >= {least:.1f}e0"""


def _chain(s: Settings, rounds: int, depth: int) -> dict[str, str]:
    base = 0.5 if s.objective == "squared" else 0.0
    out = {
        "m0": f"""SELECT p.loan_id, part, label, c.cells, {base}e0 AS margin FROM parted p
            JOIN (SELECT loan_id, list(cell ORDER BY k) AS cells FROM cells GROUP BY 1) c ON p.loan_id = c.loan_id"""
    }
    weight = f"CASE WHEN label = 1 THEN {s.positive_weight}e0 ELSE 1.0e0 END"
    for t in range(rounds):
        seed = s.seed + t
        if s.objective == "squared":
            first, second = f"(margin - label) * {weight}", weight
        else:
            first, second = f"(p - label) * {weight}", f"p * (1 - p) * {weight}"
        units = lambda x: f"CASE WHEN part = 'train' AND {draw(seed)} < {s.rows}e0 THEN CAST(round({x} * {UNIT:.1f}e0) AS BIGINT) END"  # noqa: E731, B023
        out[f"c{t}"] = f"""SELECT k FROM feature QUALIFY row_number() OVER (ORDER BY md5(name || '#{seed}'), k)
            <= greatest(1, floor(count(*) OVER () * {s.columns}e0))"""
        out[f"a{t}_0"] = f"""SELECT loan_id, part, label, cells, margin, CAST(1 AS BIGINT) AS node, {units(first)} AS g, {units(second)} AS h
            FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m{t})"""
        for d in range(depth):
            out[f"s{t}_{d}"] = f"""SELECT node, k, cell, sum(g) AS g, sum(h) AS h FROM
                (SELECT node, g, h, unnest(cells) AS cell, unnest(range(len(cells))) AS k FROM a{t}_{d} WHERE g IS NOT NULL AND node >= {1 << d})
                WHERE k IN (SELECT k FROM c{t}) GROUP BY 1, 2, 3"""
            out[f"w{t}_{d}"] = _gains(f"s{t}_{d}", s)
            out[f"b{t}_{d}"] = f"""SELECT * FROM w{t}_{d} WHERE gain > {s.least_gain}
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, k, cell, missing_left) = 1"""
            out[f"a{t}_{d + 1}"] = f"""SELECT a.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN a.node
                WHEN CASE WHEN cells[k + 1] = 0 THEN missing_left ELSE cells[k + 1] <= cell END THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
                FROM a{t}_{d} a LEFT JOIN b{t}_{d} b ON a.node = b.node"""
        leaf = lambda g, h: f"-({g} / {UNIT:.1f}e0) / ({h} / {UNIT:.1f}e0 + {s.penalty}e0) * {s.rate}e0"
        leaves = " UNION ALL ".join(
            f"SELECT 2 * node AS node, {leaf('gl', 'hl')} AS w FROM b{t}_{d} UNION ALL SELECT 2 * node + 1, {leaf('gr', 'hr')} FROM b{t}_{d}"
            for d in range(depth)
        )
        out[f"m{t + 1}"] = f"""SELECT loan_id, part, label, cells, margin + coalesce(w, 0.0e0) AS margin
            FROM a{t}_{depth} a LEFT JOIN ({leaves}) v ON a.node = v.node"""
    areas = " UNION ALL ".join(f"SELECT {t} AS round, label, margin FROM m{t + 1} WHERE part = 'test'" for t in range(rounds))
    out["curve"] = f"""SELECT round, margin, pos, tp, tp + fp AS n, sum(pos) OVER (PARTITION BY round) AS positives,
        coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY round ORDER BY margin DESC), 1) AS before FROM
        (SELECT round, margin, pos, sum(pos) OVER (PARTITION BY round ORDER BY margin DESC) AS tp,
           sum(neg) OVER (PARTITION BY round ORDER BY margin DESC) AS fp FROM
           (SELECT round, margin, sum(label) AS pos, sum(1 - label) AS neg FROM ({areas}) GROUP BY 1, 2))"""
    out["area"] = "SELECT round, sum(pos * (before + tp / n) / 2) / max(positives) AS pr_auc FROM curve GROUP BY 1"
    out["stop"] = f"""SELECT min(round) AS last, min_by(best, round) AS best FROM
        (SELECT a.round, arg_max(b.round, (b.pr_auc, -b.round)) AS best FROM area a JOIN area b ON b.round <= a.round GROUP BY 1)
        WHERE round - best >= {s.patience} OR round = {rounds - 1}"""
    out["split"] = " UNION ALL ".join(
        f"SELECT {t} AS tree, node, k, cell, missing_left, gain, (hl + hr) / {UNIT:.1f}e0 AS cover FROM b{t}_{d}"
        for t in range(rounds)
        for d in range(depth)
    )
    final = " UNION ALL ".join(f"SELECT {t} AS round, loan_id, part, label, margin FROM m{t + 1}" for t in range(rounds))
    p = "1 / (1 + exp(-margin))" if s.objective == "logistic" else "margin"
    out["kept"] = f"SELECT loan_id, part, label, {p} AS score FROM ({final}) WHERE round = (SELECT best FROM stop)"
    return out


def boosted(final: str, s: Settings, rounds: int, known: str = "true", depth: int | None = None) -> str:
    """``final`` over the first ``rounds`` rounds; exact where the stop is among them, or where ``s`` has no more."""
    steps = _rows(known) | _features() | _chain(s, rounds, s.depth if depth is None else depth)
    return oracle(final, "located", "acq", extra=steps, stored=True)
