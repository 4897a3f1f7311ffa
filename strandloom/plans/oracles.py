"""SQL for the registered queries, in the dialect of the test driver's engine.

Alignments are a recursive table: a step is an anti-diagonal, a row is a cell of a pair, lag() reaches the neighbour
above. Whoever reads a pair's last cell has its score, and with strings its alignment.
"""

from __future__ import annotations

from ..functions.config import AlignConfig, Scaler

LOW = "-1e15"


def primers(table: str, key: str, tag: str) -> str:
    return f"SELECT {key}::BIGINT AS k, substr(translate(md5(concat('{tag}', {key})), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (16 + {key} % 12)::INT) AS seq FROM {table}"


def complement(x: str) -> str:
    return f"translate({x}, 'ACGTacgt', 'TGCAtgca')"


def reverse_complement(x: str) -> str:
    return f"reverse({complement(x)})"


def sql_bool(x: bool) -> str:
    return "true" if x else "false"


def factor(config: AlignConfig, indices: tuple[str, str, str, str]) -> str:
    if config.scaler is None or not any(config.free):
        return "1.0::DOUBLE"
    assert isinstance(config.scaler, Scaler)
    terms = [f"1.0::DOUBLE / pow((greatest({x}, 0) + 1)::DOUBLE / {config.scaler.temperature}, {config.scaler.decay})" for x, on in zip(indices, config.free, strict=True) if on]
    return "(" + " + ".join(terms) + ")"


def substitution(config: AlignConfig, x: str, y: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{a}' AND {y} = '{b}' THEN {s}::DOUBLE" for a, b, s in config.matrix.rows()) + " END"


def aligned(pairs: str, config: AlignConfig, strings: bool = False) -> str:
    """pairs: SQL with columns k1, k2, seq1, seq2 → k1, k2, seq1, seq2, score[, aligned1, aligned2]."""
    first, close = config.costs
    extend = config.gap_extend
    l1, r1, l2, r2 = map(sql_bool, config.free)
    f = lambda kind, i, j: factor(config, (f"({i}) - {int(kind != 1)}", f"n - ({i})", f"({j}) - {int(kind != 2)}", f"m - ({j})"))
    end1 = lambda i, j: f"(CASE WHEN ({i}) = 0 AND {l1} THEN 0.0 ELSE {close} * {f(1, i, j)} END)"
    end2 = lambda i, j: f"(CASE WHEN ({j}) = 0 AND {l2} THEN 0.0 ELSE {close} * {f(2, i, j)} END)"
    free1, free2 = f"((i = 0 AND {l1}) OR (i = n AND {r1}))", f"((j = 0 AND {l2}) OR (j = m AND {r2}))"
    gap1, run1 = (f"(CASE WHEN {free1} THEN 0.0 ELSE {c} * {f(1, 'i', 'j')} END)" for c in (first, extend))
    gap2, run2 = (f"(CASE WHEN {free2} THEN 0.0 ELSE {c} * {f(2, 'i', 'j')} END)" for c in (first, extend))
    cand = {
        0: ["lq0 + sub", f"(lq1 + sub) + {end1('i - 1', 'j - 1')}", f"(lq2 + sub) + {end2('i - 1', 'j - 1')}"],
        1: [f"h0 + {gap1}", f"h1 + {run1}", f"h2 + ({gap1} + {end2('i', 'j - 1')})"],
        2: [f"lh0 + {gap2}", f"lh1 + ({gap2} + {end1('i - 1', 'j')})", f"lh2 + {run2}"],
    }
    valid = {0: "i >= 1 AND j >= 1 AND j <= m", 1: "j >= 1 AND j <= m", 2: "i >= 1 AND j >= 0 AND j <= m"}
    rows = ("a", "b") if strings else ()
    carried = [f"h{s}" for s in range(3)] + [f"q{s}" for s in range(3)]
    texts = [f"{r}{s}" for r in rows for s in range(3)] + [f"q{r}{s}" for r in rows for s in range(3)]
    start = ", ".join([f"CASE WHEN i = 0 THEN 0.0 ELSE {LOW} END::DOUBLE AS h0"] + [f"{LOW}::DOUBLE AS {c}" for c in carried[1:]] + [f"''::VARCHAR AS {c}" for c in texts])
    lags = ", ".join(f"lag({c}) OVER w AS l{c}" for c in (*carried, *texts))
    scored = ", ".join(f"CASE WHEN {valid[k]} THEN {c} ELSE {LOW} END AS c{k}{s}" for k in range(3) for s, c in enumerate(cand[k]))
    best = ", ".join(f"greatest(c{k}0, c{k}1, c{k}2, {LOW}) AS h{k}" for k in range(3)) + ", " + ", ".join(f"h{s} AS q{s}" for s in range(3))
    if strings:

        def chosen(r: str, k: int) -> str:
            text = {"a": "'-'" if k == 1 else "substr(seq1, i, 1)", "b": "'-'" if k == 2 else "substr(seq2, j, 1)"}[r]
            name = lambda s: {0: f"lq{r}{s}", 1: f"{r}{s}", 2: f"l{r}{s}"}[k]
            return f"CASE WHEN NOT ({valid[k]}) THEN '' WHEN c{k}0 >= c{k}1 AND c{k}0 >= c{k}2 THEN {name(0)} || {text} WHEN c{k}1 >= c{k}2 THEN {name(1)} || {text} ELSE {name(2)} || {text} END AS {r}{k}"

        best += ", " + ", ".join(chosen(r, k) for r in rows for k in range(3)) + ", " + ", ".join(f"{r}{s} AS q{r}{s}" for r in rows for s in range(3))
    ends = f"h0 AS e0, h1 + CASE WHEN {r1} THEN 0.0 ELSE {close} * {f(1, 'n', 'm')} END AS e1, h2 + CASE WHEN {r2} THEN 0.0 ELSE {close} * {f(2, 'n', 'm')} END AS e2"
    pick = lambda r: f"CASE WHEN e0 >= e1 AND e0 >= e2 THEN {r}0 WHEN e1 >= e2 THEN {r}1 ELSE {r}2 END"
    extra = f", {pick('a')} AS aligned1, {pick('b')} AS aligned2" if strings else ""
    return f"""
WITH RECURSIVE pairs AS ({pairs}),
sized AS (SELECT k1, k2, seq1, seq2, length(seq1)::INT AS n, length(seq2)::INT AS m FROM pairs),
dp AS (
  SELECT k1, k2, seq1, seq2, n, m, 0 AS d, i, {start}
  FROM (SELECT *, unnest(range(0, n + 1))::INT AS i FROM sized)
  UNION ALL
  SELECT k1, k2, seq1, seq2, n, m, d, i, {best}
  FROM (SELECT *, {scored}
    FROM (SELECT *, {substitution(config, 'substr(seq1, i, 1)', 'substr(seq2, j, 1)')} * {f(0, 'i', 'j')} AS sub
      FROM (SELECT * EXCLUDE (d), d + 1 AS d, d + 1 - i AS j, {lags} FROM dp WHERE d < n + m WINDOW w AS (PARTITION BY k1, k2 ORDER BY i))))
)
SELECT k1, k2, seq1, seq2, greatest(e0, e1, e2) AS score{extra}
FROM (SELECT *, {ends} FROM dp WHERE d = n + m AND i = n)"""


def aligned3(triples: str, config: AlignConfig, strings: bool = False) -> str:
    """triples: SQL with columns k1, k2, k3, seq1, seq2, seq3 → these and score[, aligned1, aligned2, aligned3]. A step is a plane
    i + j + k = d, a row a cell (i, j) of it; h, g and f are the seven scores of the last three planes, and with strings
    th, tg and tf the columns so far, three characters each. Of equal candidates the first kind wins."""
    first, close = config.costs
    place, size = ("i", "j", "kk"), ("n", "m", "l")

    def penalty(kind: int, prev: int) -> str:
        parts = []
        for s in range(3):
            left, right = map(sql_bool, config.free[2 * s : 2 * s + 2])
            if kind >> s & 1:
                cost = config.gap_extend if prev >> s & 1 else first
                parts.append(f"(CASE WHEN ({place[s]} = 0 AND {left}) OR ({place[s]} = {size[s]} AND {right}) THEN 0.0 ELSE {cost} END)")
            elif prev >> s & 1:
                parts.append(f"(CASE WHEN {place[s]} = 1 AND {left} THEN 0.0 ELSE {close} END)")
        return " + ".join(parts) or "0.0"

    source = {0: "fij", 1: "gj", 2: "gi", 3: "h", 4: "gij", 5: "hj", 6: "hi"}
    subs = {(0, 1): "s12", (0, 2): "s13", (1, 2): "s23"}
    letter = lambda s: f"substr(seq{s + 1}, {place[s]}, 1)"
    candidates, kinds, texts = [], [], []
    for kind in range(7):
        used = [s for s in range(3) if not kind >> s & 1]
        valid = " AND ".join(["kk BETWEEN 0 AND l", *(f"{place[s]} > 0" for s in used)])
        sub = " + ".join(v for k, v in subs.items() if k[0] in used and k[1] in used) or "0.0"
        found = ", ".join(f"{source[kind]}[{prev + 1}] + {sub} + ({penalty(kind, prev)})" for prev in range(7))
        candidates.append(f"CASE WHEN {valid} AND {source[kind]} IS NOT NULL THEN [{found}] END AS c{kind}")
        kinds.append(f"coalesce(list_max(c{kind}), {LOW})")
        chars = " || ".join("'-'" if kind >> s & 1 else letter(s) for s in range(3))
        texts.append(f"CASE WHEN c{kind} IS NULL THEN '' ELSE t{source[kind]}[list_position(c{kind}, list_max(c{kind}))] || {chars} END")
    scores = ", ".join(f"{substitution(config, letter(x), letter(y))} AS {name}" for (x, y), name in subs.items())
    ends = ", ".join(f"h[{k + 1}] + " + (" + ".join(str(close) for s in range(3) if k >> s & 1 and not config.free[2 * s + 1]) or "0.0") for k in range(7))
    none, blank = "[" + ", ".join([LOW] * 7) + "]::DOUBLE[]", "[" + ", ".join(["''"] * 7) + "]::VARCHAR[]"
    planes = [("h", "hj", "wj"), ("g", "gj", "wj"), ("h", "hi", "wi"), ("g", "gi", "wi"), ("g", "gij", "wd"), ("f", "fij", "wd")]
    lags = ", ".join(f"lag({x}) OVER {w} AS {y}" for x, y, w in planes)
    start, now = "", ""
    if strings:
        lags += ", " + ", ".join(f"lag(t{x}) OVER {w} AS t{y}" for x, y, w in planes)
        start = f", {blank} AS th, {blank} AS tg, {blank} AS tf"
        now = f", [{', '.join(texts)}] AS th, th AS tg, tg AS tf"
    row = lambda s: f"array_to_string(list_transform(range(0, length(t) // 3), lambda c: substr(t, c * 3 + {s}, 1)), '') AS aligned{s}"
    out = f"SELECT k1, k2, k3, seq1, seq2, seq3, list_max(e) AS score{', ' + ', '.join(map(row, (1, 2, 3))) if strings else ''} FROM (SELECT *{', th[list_position(e, list_max(e))] AS t' if strings else ''} FROM (SELECT *, [{ends}] AS e FROM dp WHERE d = n + m + l AND i = n AND j = m))"
    return f"""
WITH RECURSIVE sized AS (SELECT *, length(seq1)::INT AS n, length(seq2)::INT AS m, length(seq3)::INT AS l FROM ({triples})),
dp AS (
  SELECT k1, k2, k3, seq1, seq2, seq3, n, m, l, i, j, 0 AS d, CASE WHEN i = 0 AND j = 0 THEN [0.0, {", ".join([LOW] * 6)}]::DOUBLE[] ELSE {none} END AS h, {none} AS g, {none} AS f{start}
  FROM (SELECT *, unnest(range(0, m + 1))::INT AS j FROM (SELECT *, unnest(range(0, n + 1))::INT AS i FROM sized))
  UNION ALL
  SELECT k1, k2, k3, seq1, seq2, seq3, n, m, l, i, j, d, [{", ".join(kinds)}] AS h, h AS g, g AS f{now}
  FROM (SELECT *, {", ".join(candidates)} FROM (SELECT *, {scores} FROM (
    SELECT * EXCLUDE (d), d + 1 AS d, d + 1 - i - j AS kk, {lags}
    FROM dp WHERE d < n + m + l
    WINDOW wj AS (PARTITION BY k1, k2, k3, i ORDER BY j), wi AS (PARTITION BY k1, k2, k3, j ORDER BY i), wd AS (PARTITION BY k1, k2, k3, i - j ORDER BY i))))
)
{out}"""


def rows3(alignments: str, config: AlignConfig, keys: tuple[str, ...] = ("k1", "k2", "k3")) -> str:
    """alignments: SQL with the keys and aligned1, aligned2, aligned3 → one row for each score event, columns as the engine names them."""
    first, close = config.costs
    text, every = "NULL::VARCHAR", ", ".join(keys)

    def event(order: int, name: str, where: str, raw: str, at: str, shown: tuple[int, ...] = ()) -> str:
        chars = ", ".join(f"{f'c{s}' if s in shown else text} AS seq{s}_char" for s in (1, 2, 3))
        return f"SELECT {every}, {order} AS o, {name} AS event, k - 1 AS col_idx, {', '.join(f'{at}{s} AS seq{s}_pos' for s in (1, 2, 3))}, mask, prev AS prev_mask, ({raw})::DOUBLE AS raw_penalty, {chars} FROM c WHERE {where}"

    parts = []
    for o, (x, y) in enumerate(((1, 2), (1, 3), (2, 3))):
        parts.append(event(o, f"CASE WHEN c{x} = c{y} THEN 'substitution_match' ELSE 'substitution_mismatch' END", f"c{x} <> '-' AND c{y} <> '-'", substitution(config, f"c{x}", f"c{y}"), "p", (x, y)))
    for s in (1, 2, 3):
        left, right = map(sql_bool, config.free[2 * s - 2 : 2 * s])
        parts.append(event(2 + 2 * s, f"CASE WHEN b{s} = '-' THEN 'gap_extend_seq{s}' ELSE 'gap_open_seq{s}' END", f"c{s} = '-' AND NOT ((p{s} = 0 AND {left}) OR (p{s} = n{s} AND {right}))", f"CASE WHEN b{s} = '-' THEN {config.gap_extend} ELSE {first} END", "p"))
        if close:
            parts.append(event(3 + 2 * s, f"'gap_close_seq{s}'", f"c{s} <> '-' AND b{s} = '-' AND NOT ({left} AND p{s} = 0)", str(close), "p"))
            parts.append(event(20 + s, f"'gap_close_seq{s}'", f"k = size AND c{s} = '-' AND NOT {right}", str(close), "n"))
    chars = ", ".join(f"substr(aligned{s}, k, 1) AS c{s}, CASE WHEN k > 1 THEN substr(aligned{s}, k - 1, 1) ELSE '' END AS b{s}, length(replace(substr(aligned{s}, 1, k - 1), '-', ''))::INT AS p{s}, length(replace(aligned{s}, '-', ''))::INT AS n{s}" for s in (1, 2, 3))
    bits = lambda x: " + ".join(f"CASE WHEN {x}{s} = '-' THEN {1 << s - 1} ELSE 0 END" for s in (1, 2, 3))
    joined = " UNION ALL ".join(parts)
    return f"""
WITH x AS (SELECT {every}, k, length(aligned1)::INT AS size, {chars} FROM (SELECT *, unnest(range(1, length(aligned1) + 1))::INT AS k FROM ({alignments}))),
c AS (SELECT *, ({bits('c')})::INT AS mask, ({bits('b')})::INT AS prev FROM x)
SELECT {every}, (row_number() OVER (PARTITION BY {every} ORDER BY col_idx, o) - 1)::INT AS event_no, event, col_idx, seq1_pos, seq2_pos, seq3_pos, mask, prev_mask,
  raw_penalty, 1.0::DOUBLE AS factor, raw_penalty AS scaled_penalty, seq1_char, seq2_char, seq3_char FROM ({joined})"""


def events3(alignments: str, config: AlignConfig) -> str:
    """alignments: SQL with k1, k2, aligned1, aligned2, aligned3 → k1, k2, event, n, total: score events of each kind."""
    first, close = config.costs
    parts = []
    for x, y in ((1, 2), (1, 3), (2, 3)):
        parts.append(f"SELECT k1, k2, CASE WHEN c{x} = c{y} THEN 'substitution_match' ELSE 'substitution_mismatch' END AS event, {substitution(config, f'c{x}', f'c{y}')} AS cost FROM c WHERE c{x} <> '-' AND c{y} <> '-'")
    for s in (1, 2, 3):
        left, right = map(sql_bool, config.free[2 * s - 2 : 2 * s])
        parts.append(f"SELECT k1, k2, CASE WHEN b{s} = '-' THEN 'gap_extend_seq{s}' ELSE 'gap_open_seq{s}' END, CASE WHEN b{s} = '-' THEN {config.gap_extend} ELSE {first} END FROM c WHERE c{s} = '-' AND NOT ((p{s} = 0 AND {left}) OR (p{s} = n{s} AND {right}))")
        if close:
            parts.append(f"SELECT k1, k2, 'gap_close_seq{s}', {close} FROM c WHERE c{s} <> '-' AND b{s} = '-' AND NOT ({left} AND p{s} = 0)")
            parts.append(f"SELECT k1, k2, 'gap_close_seq{s}', {close} FROM c WHERE k = size AND c{s} = '-' AND NOT {right}")
    chars = ", ".join(f"substr(aligned{s}, k, 1) AS c{s}, CASE WHEN k > 1 THEN substr(aligned{s}, k - 1, 1) ELSE '' END AS b{s}, length(replace(substr(aligned{s}, 1, k - 1), '-', '')) AS p{s}, length(replace(aligned{s}, '-', '')) AS n{s}" for s in (1, 2, 3))
    joined = " UNION ALL ".join(parts)
    return f"""
WITH c AS (SELECT k1, k2, k, length(aligned1) AS size, {chars} FROM (SELECT *, unnest(range(1, length(aligned1) + 1))::INT AS k FROM ({alignments})))
SELECT k1, k2, event, count(*) AS n, sum(cost) AS total FROM ({joined}) GROUP BY ALL"""


def events(alignments: str, config: AlignConfig, digits: int = 9) -> str:
    """alignments: SQL with k1, k2, aligned1, aligned2 → one row for each score event, columns as the engine names them."""
    first, close = config.costs
    l1, r1, l2, r2 = map(sql_bool, config.free)
    f = lambda a, b, c, d: factor(config, (a, b, c, d))
    null, text = "NULL::INT", "NULL::VARCHAR"

    def event(name: str, where: str, raw: str, fac: str, p1: str = "p1", p2: str = "p2", chars: tuple[str, str] = (text, text), order: int = 0) -> str:
        return f"SELECT k1, k2, {order} AS o, {name} AS event, k - 1 AS col_idx, {p1} AS seq1_pos, {p2} AS seq2_pos, {null} AS seq3_pos, mask, prev AS prev_mask, {raw} AS raw_penalty, {fac} AS factor, {chars[0]} AS seq1_char, {chars[1]} AS seq2_char, {text} AS seq3_char FROM c WHERE {where}"

    parts = [
        event("CASE WHEN c1 = c2 THEN 'substitution_match' ELSE 'substitution_mismatch' END", "mask = 0", substitution(config, "c1", "c2"), f("p1", "n - p1 - 1", "p2", "m - p2 - 1"), chars=("c1", "c2"), order=1),
        event("CASE WHEN prev = 1 THEN 'gap_extend_seq1' ELSE 'gap_open_seq1' END", f"mask = 1 AND NOT ((p1 = 0 AND {l1}) OR (p1 = n AND {r1}))", f"CASE WHEN prev = 1 THEN {config.gap_extend} ELSE {first} END", f("p1", "n - p1", "p2", "m - p2 - 1"), order=4),
        event("CASE WHEN prev = 2 THEN 'gap_extend_seq2' ELSE 'gap_open_seq2' END", f"mask = 2 AND NOT ((p2 = 0 AND {l2}) OR (p2 = m AND {r2}))", f"CASE WHEN prev = 2 THEN {config.gap_extend} ELSE {first} END", f("p1", "n - p1 - 1", "p2", "m - p2"), order=4),
        event("'gap_close_seq1'", f"k = size AND mask = 1 AND NOT {r1}", str(close), f("n", "0", "m - 1", "0"), "n", "m - 1", order=5),
        event("'gap_close_seq2'", f"k = size AND mask = 2 AND NOT {r2}", str(close), f("n - 1", "0", "m", "0"), "n - 1", "m", order=5),
    ]
    if close:
        parts += [
            event("'gap_close_seq1'", f"prev = 1 AND mask <> 1 AND NOT ({l1} AND p1 = 0)", str(close), f("p1", "n - p1", "p2 - 1", "m - p2"), order=2),
            event("'gap_close_seq2'", f"prev = 2 AND mask <> 2 AND NOT ({l2} AND p2 = 0)", str(close), f("p1 - 1", "n - p1", "p2", "m - p2"), order=3),
        ]
    joined = " UNION ALL ".join(parts)
    return f"""
WITH x AS ({alignments}),
u AS (SELECT *, unnest(range(1, length(aligned1) + 1))::INT AS k, length(aligned1)::INT AS size, length(replace(aligned1, '-', ''))::INT AS n, length(replace(aligned2, '-', ''))::INT AS m FROM x),
v AS (SELECT *, substr(aligned1, k, 1) AS c1, substr(aligned2, k, 1) AS c2 FROM u),
y AS (SELECT *, CASE WHEN c1 = '-' THEN 1 WHEN c2 = '-' THEN 2 ELSE 0 END AS mask FROM v),
c AS (SELECT *, coalesce(lag(mask) OVER w, 0) AS prev,
  coalesce(sum((c1 <> '-')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS p1,
  coalesce(sum((c2 <> '-')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS p2
  FROM y WINDOW w AS (PARTITION BY k1, k2 ORDER BY k)),
e AS ({joined})
SELECT k1, k2, (row_number() OVER (PARTITION BY k1, k2 ORDER BY col_idx, o) - 1)::INT AS event_no, event, col_idx, seq1_pos, seq2_pos, seq3_pos, mask, prev_mask,
  round(raw_penalty, {digits}) AS raw_penalty, round(factor, {digits}) AS factor, round(raw_penalty * factor, {digits}) AS scaled_penalty, seq1_char, seq2_char, seq3_char FROM e"""
