"""Batched alignment of two sequences: all pairs of equal lengths (n, m) advance one anti-diagonal at a time.

On diagonal d the cells (i, d - i) of every pair are one array [cells, pairs]. A cell holds three scores, by the kind of
its last column (see factor_planes). Scores alone need two diagonals; with traceback, two bits per cell and kind, in one
byte, say which kind came before (the first of equal scores in the order 0, 1, 2). Diagonals follow each other there.
"""

from __future__ import annotations

import numpy as np

from .config import AlignConfig, Scaler, factor_planes

NONE = -np.inf
BUDGET = 3 << 20  # bytes of working arrays at a time: what a core keeps in its cache


class Penalties:
    """Gap costs along a diagonal, as columns: `gap1`, `run1` (first and further column of a gap in sequence 1 that ends at
    the cell), `end1` (the close of such a run, for a column that goes on from the cell), and the same for 2.

    Unscaled costs of sequence 1 depend on i alone and those of sequence 2 on j alone, so a diagonal is a slice; scaled
    ones are gathered from a table of all cells."""

    def __init__(self, config: AlignConfig, n: int, m: int):
        self.plain = config.scaler is None or (isinstance(config.scaler, Scaler) and not any(config.free))
        l1, r1, l2, r2 = config.free
        first, close = config.costs
        i, j = np.arange(n + 1), np.arange(m + 1)
        free1, free2 = (i == 0) & l1 | (i == n) & r1, (j == 0) & l2 | (j == m) & r2
        by_place = {
            "gap1": np.where(free1, 0.0, first),
            "run1": np.where(free1, 0.0, config.gap_extend),
            "end1": np.where((i == 0) & l1, 0.0, close),
            "gap2": np.where(free2, 0.0, first),
            "run2": np.where(free2, 0.0, config.gap_extend),
            "end2": np.where((j == 0) & l2, 0.0, close),
        }
        if self.plain:
            self.factors = None
            self.last = (1.0, 1.0)
            self.table = by_place
        else:
            self.factors = factor_planes(config, n, m)
            self.last = (self.factors[1, n, m], self.factors[2, n, m])
            self.table = {k: (v[:, None] if k[-1] == "1" else v[None, :]) * self.factors[int(k[-1])] for k, v in by_place.items()}

    def along(self, name: str, d: int, lo: int, hi: int, up: int = 0, left: int = 0) -> np.ndarray:
        """At the cells (i - up, d - i - left) for i from lo to hi."""
        own = self.table[name]
        if not self.plain:
            rows = np.arange(lo, hi + 1)
            return own[rows - up, d - left - rows][:, None]
        if name[-1] == "1":
            return own[lo - up : hi - up + 1, None]
        return own[d - left - hi : d - left - lo + 1][::-1, None]


def align_block(a: np.ndarray, b: np.ndarray, config: AlignConfig, dense: np.ndarray, traceback: bool):
    """a uint8[pairs, n], b uint8[pairs, m] → scores, and with traceback the kinds of the columns from the last to the first."""
    count, n = a.shape
    m = b.shape[1]
    pen = Penalties(config, n, m)
    letters, codes = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    ca, cb = codes[: a.size].reshape(a.shape).T, codes[a.size :].reshape(b.shape).T  # [n, pairs]
    table = dense[np.ix_(letters, letters)]
    if n and m and np.isnan(table).any():
        used = np.zeros(table.shape, bool)
        present = [[np.isin(np.arange(len(letters)), np.unique(c[:, k])) for c in (ca, cb)] for k in range(count)]
        for x, y in present:
            used |= x[:, None] & y[None, :]
        if (missing := np.argwhere(used & np.isnan(table))).size:
            x, y = (chr(letters[k]) for k in missing[0])
            raise ValueError(f"the score matrix has no entry for {x!r}, {y!r}")
    table = np.nan_to_num(table)
    flat, size = table.ravel(), len(letters)
    ca = np.ascontiguousarray(ca) * size
    reversed_b = np.ascontiguousarray(cb[::-1])
    shape = (3, n + 2, count)  # row i + 1 is cell i; row 0 stays empty
    before, last, now = (np.full(shape, NONE) for _ in range(3))
    d = np.arange(n + m + 1)
    low = np.maximum(d - m, 0)  # the first cell of each diagonal
    begin = np.concatenate([[0], np.cumsum(np.minimum(d, n) - low + 1)])
    back = np.zeros((begin[-1], count), np.uint8) if traceback else None
    last[0, 1] = 0.0

    def best(c0, c1, c2, kind, d, lo, target):
        np.maximum(c0, c1, out=target)
        if back is not None:
            came, third = np.greater(c1, c0).view(np.uint8), np.greater(c2, target).view(np.uint8)
            third <<= 1
            np.maximum(came, third, out=came)
            came <<= 2 * kind
            at = begin[d] + lo - low[d]
            back[at : at + len(target)] |= came
        np.maximum(target, c2, out=target)

    for d in range(1, n + m + 1):
        now[:] = NONE
        lo, hi = max(1, d - m), min(n, d - 1)
        if lo <= hi:  # two letters, from (i - 1, j - 1)
            sub = flat.take(ca[lo - 1 : hi] + reversed_b[m - d + lo : m - d + hi + 1])
            if not pen.plain:
                rows = np.arange(lo, hi + 1)
                sub *= pen.factors[0][rows, d - rows][:, None]
            p = before[:, lo : hi + 1]
            best(p[0] + sub, (p[1] + sub) + pen.along("end1", d, lo, hi, 1, 1), (p[2] + sub) + pen.along("end2", d, lo, hi, 1, 1), 0, d, lo, now[0, lo + 1 : hi + 2])
        lo, hi = max(0, d - m), min(n, d - 1)
        if lo <= hi:  # a gap in the first sequence, from (i, j - 1)
            p = last[:, lo + 1 : hi + 2]
            gap = pen.along("gap1", d, lo, hi)
            best(p[0] + gap, p[1] + pen.along("run1", d, lo, hi), p[2] + (gap + pen.along("end2", d, lo, hi, 0, 1)), 1, d, lo, now[1, lo + 1 : hi + 2])
        lo, hi = max(1, d - m), min(n, d)
        if lo <= hi:  # a gap in the second sequence, from (i - 1, j)
            p = last[:, lo : hi + 1]
            gap = pen.along("gap2", d, lo, hi)
            best(p[0] + gap, p[1] + (gap + pen.along("end1", d, lo, hi, 1, 0)), p[2] + pen.along("run2", d, lo, hi), 2, d, lo, now[2, lo + 1 : hi + 2])
        before, last, now = last, now, before
    close = config.costs[1]
    ends = last[:, n + 1].copy()
    if not config.free[1]:
        ends[1] += close * pen.last[0]
    if not config.free[3]:
        ends[2] += close * pen.last[1]
    state = np.argmax(ends, axis=0)
    scores = ends[state, np.arange(count)]
    if back is None:
        return scores, None
    steps = np.full((n + m, count), 3, np.uint8)  # 3: past the start
    i, j, every = np.full(count, n), np.full(count, m), np.arange(count)
    for k in range(n + m):
        alive = (i > 0) | (j > 0)
        if not alive.any():
            break
        steps[k, alive] = state[alive]
        came = back[begin[i + j] + i - low[i + j], every] >> (2 * state).astype(np.uint8) & 3
        i = i - (alive & (state != 1))
        j = j - (alive & (state != 2))
        state = np.where(alive, came, state)
    return scores, steps


def forward_kinds(steps: np.ndarray, past: int) -> tuple[np.ndarray, np.ndarray]:
    """Column kinds from the first to the last, all pairs in a row, and where each pair begins."""
    used = (steps != past).sum(axis=0)
    begin = np.cumsum(used) - used
    owner = np.repeat(np.arange(steps.shape[1]), used)
    return steps[used[owner] - 1 - (np.arange(len(owner)) - begin[owner]), owner], np.append(begin, len(owner))


def gapped_rows(letters: np.ndarray, has_letter: np.ndarray) -> np.ndarray:
    """The bytes of one aligned row of all pairs: its letters in order where a column has one, else gaps."""
    out = np.full(len(has_letter), ord("-"), np.uint8)
    out[has_letter] = letters.ravel()  # every pair uses all its letters, so they follow each other
    return out


def render_block(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bytes of both aligned rows, all pairs in a row, and where each pair begins."""
    kinds, begin = forward_kinds(steps, 3)
    return [gapped_rows(x, kinds != gap) for x, gap in ((a, 1), (b, 2))], begin


def pairs_at_once(n: int, m: int, traceback: bool) -> int:
    """Pairs in a block: its diagonals stay in cache, its pointers (a byte for each cell of the lattice) within 64 MB unless one pair has more."""
    most = BUDGET // (8 * 17 * (min(n, m) + 2))
    return max(1, min(most, (64 << 20) // ((n + 1) * (m + 1))) if traceback else most)
