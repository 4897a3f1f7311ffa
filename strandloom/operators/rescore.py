"""Rescoring and explaining given alignments, as JVM expressions.

Each column has a list of costs with their conditions. Events are those costs as rows; the score is their sum, without
building any event. So an explanation always adds up to the score. Strings are compared as they are: rescoring folds no case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import FLAGS_2D, AlignConfig, Scaler
from ..functions.dna import _col, bound

EVENT = (
    "struct<event:string,col_idx:int,seq1_pos:int,seq2_pos:int,seq3_pos:int,mask:int,prev_mask:int,raw_penalty:double,"
    "factor:double,scaled_penalty:double,seq1_char:string,seq2_char:string,seq3_char:string>"
)


def _event(event, col: Column, pos: Sequence[Column], mask, prev, raw, factor, chars: Sequence[Column | None]) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    third = pos[2] if len(pos) > 2 else F.lit(None).cast("int")
    fields = [event, col["k"], pos[0], pos[1], third, mask, prev, raw, factor, raw * factor, *(text(c) for c in chars)]
    names = [f.split(":")[0] for f in EVENT[7:-1].split(",")]
    return F.struct(*[f.alias(n) for f, n in zip(fields, names, strict=True)]).cast(EVENT)


#: What a factor may belong to in a column of two sequences: a pair of letters, the close of a run before, a gap, the close at the end.
ROLES = ("pair", "close1", "close2", "gap1", "gap2", "last1", "last2")


def _custom(config: AlignConfig) -> bool:
    return len(config.free) == 4 and config.scaler is not None and not isinstance(config.scaler, Scaler)


def _factor(config: AlignConfig, indices: Sequence[Column], col: Column, role: str, free: Sequence[Column] | None) -> Column:
    """The column factor as an expression over (left1, right1, left2, right2); that of a custom callable is in the column already."""
    scaler = config.scaler
    if _custom(config):
        return col["factors"][role]
    if scaler is None or free is None and not any(config.free):
        return F.lit(1.0)
    terms = [1.0 / F.pow((i + 1).cast("double") / scaler.temperature, F.lit(float(scaler.decay))) for i in indices]
    terms = [t for t, on in zip(terms, config.free, strict=True) if on] if free is None else [F.when(on, t).otherwise(0.0) for t, on in zip(terms, free, strict=True)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total if free is None else F.when(free[0] | free[1] | free[2] | free[3], total).otherwise(1.0)


def _factors_udf(config: AlignConfig):
    """For a callable that is no Scaler: array<struct of ROLES>, one for each column of an alignment; 1 where a role has no place."""
    scaler, named = config.scaler, {f"{name}_free": f for name, f in zip(FLAGS_2D, config.free, strict=True)}

    def of(one: str, two: str) -> list[dict[str, float]]:
        n, m = len(one) - one.count("-"), len(two) - two.count("-")
        a = b = before = 0
        out = []
        for x, y in zip(one, two, strict=True):
            mask = (x == "-") + 2 * (y == "-")
            at = {"pair": mask == 0 and (a, n - a - 1, b, m - b - 1)}
            at |= {"close1": before == 1 and mask != 1 and (a, n - a, b - 1, m - b), "close2": before == 2 and mask != 2 and (a - 1, n - a, b, m - b)}
            at |= {"gap1": mask == 1 and (a, n - a, b, m - b - 1), "gap2": mask == 2 and (a, n - a - 1, b, m - b)}
            a, b, before = a + (x != "-"), b + (y != "-"), mask
            at |= {"last1": mask == 1 and (n, 0, m - 1, 0), "last2": mask == 2 and (n - 1, 0, m, 0)}
            out.append({r: float(scaler(*at[r], **named)) if at[r] else 1.0 for r in ROLES})
        return out

    kind = pa.list_(pa.struct([(r, pa.float64()) for r in ROLES]))

    @F.arrow_udf("array<struct<" + ", ".join(f"{r}: double" for r in ROLES) + ">>")
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        rows = zip(first.to_pylist(), second.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None or len(x) != len(y) else of(x, y) for x, y in rows], kind)

    return run


def _substitution(config: AlignConfig, x: Column, y: Column) -> Column:
    table = F.create_map(*[F.lit(v) for a, b, s in config.matrix.rows() for v in (a + b, s)])
    found = F.element_at(table, F.concat(x, y))
    missing = F.lit(0.0) if config.matrix.on_missing == "zero" else F.raise_error(F.concat(F.lit("the score matrix has no entry for "), x, F.lit(", "), y)).cast("double")
    return F.coalesce(found, missing)


PIECE = 64  # letters: strings are cut up once, so that no column looks at more than a piece of its own


def _columns(aligned: Sequence[Column], factors: Column | None = None) -> Column:
    """One struct a column: k, characters c1.., those before b1.. ('' at first), letters used before p1.., mask, prev, factors if given."""
    size = F.length(aligned[0])
    bits = lambda chars: sum((F.when(c == "-", 1 << s).otherwise(0) for s, c in enumerate(chars)), F.lit(0))
    letters = lambda text: F.length(F.replace(text, F.lit("-"), F.lit("")))
    numbers = F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int"))

    def in_pieces(a: Column) -> Column:
        return F.transform(numbers, lambda q: F.substring(a, q * PIECE + 1, F.lit(PIECE)))

    start = F.array(F.lit(0))
    cut_up = F.struct(*[in_pieces(a).alias(f"t{s}") for s, a in enumerate(aligned)], *([factors.alias("factors")] if factors is not None else []))

    def counted(cut: Column) -> Column:
        """The pieces and how many letters each string has used before a piece: running sums."""
        used = [F.aggregate(cut[f"t{s}"], start, lambda acc, piece: F.concat(acc, F.array(F.element_at(acc, -1) + letters(piece)))) for s in range(len(aligned))]
        kept = [cut[f"t{s}"].alias(f"t{s}") for s in range(len(aligned))] + ([cut["factors"].alias("factors")] if factors is not None else [])
        return F.struct(*kept, *[u.alias(f"u{s}") for s, u in enumerate(used)])

    def columns(cut: Column) -> Column:
        def column(k: Column) -> Column:
            q, at = F.floor((k - 1) / PIECE).cast("int"), (k - 1) % PIECE
            piece = [F.element_at(cut[f"t{s}"], q + 1) for s in range(len(aligned))]
            chars = [F.substring(p, at + 1, F.lit(1)) for p in piece]
            before = [F.when(at > 0, F.substring(p, at, F.lit(1))).when(k > 1, F.substring(F.get(cut[f"t{s}"], q - 1), F.lit(PIECE), F.lit(1))).otherwise("") for s, p in enumerate(piece)]
            used = [F.element_at(cut[f"u{s}"], q + 1) + letters(F.substring(p, F.lit(1), at)) for s, p in enumerate(piece)]
            mask, every = bits(chars), (1 << len(aligned)) - 1
            return F.struct(
                (k - 1).alias("k"),
                *[c.alias(f"c{s + 1}") for s, c in enumerate(chars)],
                *[p.alias(f"p{s + 1}") for s, p in enumerate(used)],
                F.when(mask == every, F.raise_error(F.lit("invalid alignment column: nothing but gaps")).cast("int")).otherwise(mask).alias("mask"),
                bits(before).alias("prev"),
                *([F.element_at(cut["factors"], k).alias("factors")] if factors is not None else []),
            )

        return F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), column)

    return F.when(size > 0, bound(bound(cut_up, counted), columns))


def _guarded(aligned: Sequence[Column], value: Column) -> Column:
    """value, or an error if lengths differ; null if any string is null."""
    known = aligned[0].isNotNull()
    equal = F.lit(True)
    for a in aligned[1:]:
        known, equal = known & a.isNotNull(), equal & (F.length(a) == F.length(aligned[0]))
    return F.when(known & F.assert_true(equal, F.lit("aligned strings must have the same length")).isNull(), value)


#: What a column costs: when, event name, position of each sequence, raw cost, factor, characters.
Cost = tuple[Column, Column, Sequence[Column], Column, Column, Sequence[Column | None]]


def _costs_2d(config: AlignConfig, free: Sequence[Column] | None, n: Column, m: Column) -> tuple[Callable[[Column], list[Cost]], Callable[[Column], list[Cost]]]:
    """The costs of a column, and those that the last column adds; n and m are the sequences' lengths."""
    first, close = config.costs
    l1, r1, l2, r2 = free or [F.lit(x) for x in config.free]
    nothing = (None,) * 3

    def closed(seq: int, p1: Column, p2: Column, when: Column, at: Sequence[Column], col: Column, role: str) -> Cost:
        """The close of a run whose last gap column had p1, p2 letters used after it."""
        indices = (p1, n - p1, p2 - 1, m - p2) if seq == 1 else (p1 - 1, n - p1, p2, m - p2)
        return when, F.lit(f"gap_close_seq{seq}"), at, F.lit(close), _factor(config, indices, col, f"{role}{seq}", free), nothing

    def column(col: Column) -> list[Cost]:
        p1, p2, mask, prev = col["p1"], col["p2"], col["mask"], col["prev"]
        at = (p1, p2)
        pair = mask == 0
        name = F.when(col["c1"] == col["c2"], "substitution_match").otherwise("substitution_mismatch")
        raw = F.when(pair, _substitution(config, col["c1"], col["c2"]))
        out: list[Cost] = [(pair, name, at, raw, _factor(config, (p1, n - p1 - 1, p2, m - p2 - 1), col, "pair", free), (col["c1"], col["c2"], None))]
        if close:
            out += [closed(1, p1, p2, (prev == 1) & (mask != 1) & ~(l1 & (p1 == 0)), at, col, "close"), closed(2, p1, p2, (prev == 2) & (mask != 2) & ~(l2 & (p2 == 0)), at, col, "close")]
        for seq, own, size, left, right in ((1, p1, n, l1, r1), (2, p2, m, l2, r2)):
            indices = (p1, n - p1, p2, m - p2 - 1) if seq == 1 else (p1, n - p1 - 1, p2, m - p2)
            more = prev == seq
            kind = F.when(more, f"gap_extend_seq{seq}").otherwise(f"gap_open_seq{seq}")
            cost = F.when(more, F.lit(float(config.gap_extend))).otherwise(F.lit(first))
            spared = ((own == 0) & left) | ((own == size) & right)
            out.append(((mask == seq) & ~spared, kind, at, cost, _factor(config, indices, col, f"gap{seq}", free), nothing))
        return out

    def last(col: Column) -> list[Cost]:
        return [closed(1, n, m, (col["mask"] == 1) & ~r1, (n, m - 1), col, "last"), closed(2, n, m, (col["mask"] == 2) & ~r2, (n - 1, m), col, "last")]

    return column, last


def _costs_3d(config: AlignConfig, free: Sequence[Column] | None, sizes: Sequence[Column]) -> tuple[Callable[[Column], list[Cost]], Callable[[Column], list[Cost]]]:
    first, close = config.costs
    unit, nothing = F.lit(1.0), (None,) * 3
    ends = free or [F.lit(x) for x in config.free]

    def column(col: Column) -> list[Cost]:
        at = [col["p1"], col["p2"], col["p3"]]
        chars = [col["c1"], col["c2"], col["c3"]]
        mask, prev = col["mask"], col["prev"]
        out: list[Cost] = []
        for x, y in ((0, 1), (0, 2), (1, 2)):
            both = (chars[x] != "-") & (chars[y] != "-")
            name = F.when(chars[x] == chars[y], "substitution_match").otherwise("substitution_mismatch")
            out.append((both, name, at, F.when(both, _substitution(config, chars[x], chars[y])), unit, [c if s in (x, y) else None for s, c in enumerate(chars)]))
        for s in range(3):
            left, right = ends[2 * s], ends[2 * s + 1]
            gap, had = mask.bitwiseAND(1 << s) != 0, prev.bitwiseAND(1 << s) != 0
            spared = ((at[s] == 0) & left) | ((at[s] == sizes[s]) & right)
            kind = F.when(had, f"gap_extend_seq{s + 1}").otherwise(f"gap_open_seq{s + 1}")
            cost = F.when(had, F.lit(float(config.gap_extend))).otherwise(F.lit(first))
            out.append((gap & ~spared, kind, at, cost, unit, nothing))
            if close:
                out.append((~gap & had & ~(left & (at[s] == 0)), F.lit(f"gap_close_seq{s + 1}"), at, F.lit(close), unit, nothing))
        return out

    def last(col: Column) -> list[Cost]:
        open_ends = [s for s in range(3) if close and (free or not config.free[2 * s + 1])]
        return [((col["mask"].bitwiseAND(1 << s) != 0) & ~ends[2 * s + 1], F.lit(f"gap_close_seq{s + 1}"), sizes, F.lit(close), unit, nothing) for s in open_ends]

    return column, last


def _prepared(aligned: Sequence[Column], config: AlignConfig, free: Sequence[Column] | None = None):
    sizes = [F.length(F.replace(a, F.lit("-"), F.lit(""))) for a in aligned]
    return _costs_2d(config, free, *sizes) if len(aligned) == 2 else _costs_3d(config, free, sizes)


def _given(aligned: Sequence[Column], config: AlignConfig) -> Column:
    return _columns(aligned, _factors_udf(config)(*aligned) if _custom(config) else None)


def _all_events(aligned: Sequence[Column], config: AlignConfig) -> Column:
    column, last = _prepared(aligned, config)
    none = F.lit(None).cast(EVENT)

    def listed(costs: list[Cost], col: Column) -> Column:
        events = [F.when(when, _event(name, col, at, col["mask"], col["prev"], raw, factor, chars)).otherwise(none) for when, name, at, raw, factor, chars in costs]
        return F.filter(F.array(*events), lambda e: e.isNotNull()) if events else F.array().cast(f"array<{EVENT}>")

    def of(columns: Column) -> Column:
        end = F.element_at(columns, -1)
        return F.concat(F.flatten(F.transform(columns, lambda c: listed(column(c), c))), listed(last(end), end))

    return _guarded(aligned, F.when(F.length(aligned[0]) > 0, bound(_given(aligned, config), of)).otherwise(F.array().cast(f"array<{EVENT}>")))


def _whole_score(aligned: Sequence[Column], config: AlignConfig, free: Sequence[Column] | None = None) -> Column:
    """The sum of all costs, without building events."""
    column, last = _prepared(aligned, config, free)

    def summed(costs: list[Cost]) -> Column:
        out = F.lit(0.0)
        for when, _, _, raw, factor, _ in costs:
            out = out + F.when(when, raw * factor).otherwise(0.0)
        return out

    def of(columns: Column) -> Column:
        return F.aggregate(columns, F.lit(0.0), lambda acc, c: acc + summed(column(c))) + summed(last(F.element_at(columns, -1)))

    return _guarded(aligned, F.when(F.length(aligned[0]) > 0, bound(_given(aligned, config), of)).otherwise(0.0))


def score_events(aligned1, aligned2, config: AlignConfig | None = None) -> Column:
    """array<EVENT> of a two-sequence alignment; empty strings have none."""
    return _all_events([_col(aligned1), _col(aligned2)], config or AlignConfig())


def score_events_3d(aligned1, aligned2, aligned3, config: AlignConfig | None = None) -> Column:
    """array<EVENT> of a three-sequence alignment; factors are 1."""
    return _all_events([_col(a) for a in (aligned1, aligned2, aligned3)], config or AlignConfig(free=(False,) * 6))


def total(events: Column) -> Column:
    return F.aggregate(events, F.lit(0.0), lambda acc, e: acc + e["scaled_penalty"])


def score_alignment(aligned1, aligned2, config: AlignConfig | None = None, free: Sequence[Column] | None = None) -> Column:
    """The score of a given alignment; empty strings score 0. free: boolean columns in place of the configuration's flags."""
    return _whole_score([_col(aligned1), _col(aligned2)], config or AlignConfig(), free)


def score_alignment_3d(aligned1, aligned2, aligned3, config: AlignConfig | None = None, free: Sequence[Column] | None = None) -> Column:
    return _whole_score([_col(a) for a in (aligned1, aligned2, aligned3)], config or AlignConfig(free=(False,) * 6), free)


def explain(df: DataFrame, events: Column, keep: Sequence[str], types: Iterable[str] | None = None) -> DataFrame:
    """One row for each event, with the columns `keep` before it. types: event names to keep; none given keeps all, an empty list none."""
    rows = df.select(*keep, F.posexplode(events).alias("event_no", "e")).select(*keep, "event_no", "e.*")
    if types is None:
        return rows
    types = list(types)
    return rows.filter(F.col("event").isin(types) if types else F.lit(False))
