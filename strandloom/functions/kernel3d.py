"""Batched alignment of three sequences: all triples of equal lengths advance one plane i + j + k = d at a time.

A column's kind says which sequences have a gap in it (bit s for sequence s; 7 would be all of them). A plane is an
array [kinds, i, j, triples]; a column of a kind with g gaps comes from the plane 3 - g before. Substitutions are summed
over the pairs of letters present. No column is scaled.
"""

from __future__ import annotations

import numpy as np

from .config import AlignConfig
from .kernel2d import forward_kinds, gapped_rows

NONE = -np.inf
BUDGET = 128 << 20


def _penalties(config: AlignConfig, lengths: tuple[int, int, int]) -> list[list[np.ndarray]]:
    """For each sequence and column kind, [previous kind, letters used after the column]: what the sequence's gap costs there."""
    first, close = config.costs
    out = []
    for s, size in enumerate(lengths):
        left, right = config.free[2 * s], config.free[2 * s + 1]
        x = np.arange(size + 1)
        free = (x == 0) & left | (x == size) & right
        opened, further = np.where(free, 0.0, first), np.where(free, 0.0, config.gap_extend)
        closed, nothing = np.where((x == 1) & left, 0.0, close), np.zeros(size + 1)
        gapped = [further if prev >> s & 1 else opened for prev in range(7)]
        lettered = [closed if prev >> s & 1 else nothing for prev in range(7)]
        out.append([np.stack(gapped if kind >> s & 1 else lettered) for kind in range(7)])
    return out


def align_block(seqs: tuple[np.ndarray, np.ndarray, np.ndarray], config: AlignConfig, dense: np.ndarray, traceback: bool):
    """seqs uint8[triples, length] each → scores, and with traceback the kinds of the columns from the last to the first."""
    count = seqs[0].shape[0]
    n, m, l = lengths = tuple(s.shape[1] for s in seqs)
    cost = _penalties(config, lengths)
    pairs = {}
    for x, y in ((0, 1), (0, 2), (1, 2)):
        table = dense[seqs[x][:, :, None], seqs[y][:, None, :]]  # [triples, x, y]
        if np.isnan(table).any():
            k, p, q = np.argwhere(np.isnan(table))[0]
            raise ValueError(f"the score matrix has no entry for {chr(seqs[x][k, p])!r}, {chr(seqs[y][k, q])!r}")
        pairs[x, y] = np.ascontiguousarray(np.moveaxis(table, 0, -1))  # [x, y, triples]
    planes = [np.full((7, n + 2, m + 2, count), NONE) for _ in range(4)]  # planes[d % 4], shifted by one in i and j
    planes[0][0, 1, 1] = 0.0
    back = np.zeros((7, n + 1, m + 1, l + 1, count), np.uint8) if traceback else None
    for d in range(1, n + m + l + 1):
        here = planes[d % 4]
        here[:] = NONE
        i0, i1 = max(0, d - m - l), min(n, d)
        i = np.arange(i0, i1 + 1)[:, None]
        j0, j1 = max(0, d - i1 - l), min(m, d - i0)
        j = np.arange(j0, j1 + 1)[None, :]
        k = d - i - j
        inside = (k >= 0) & (k <= l)
        kc = np.clip(k, 0, l)
        used = (np.broadcast_to(i, k.shape), np.broadcast_to(j, k.shape), kc)
        for kind in range(7):
            step = [not kind >> s & 1 for s in range(3)]
            possible = inside.copy()
            for s in range(3):
                if step[s]:
                    possible &= used[s] > 0
            if not possible.any():
                continue
            source = planes[(d - sum(step)) % 4][:, i0 - step[0] + 1 : i1 - step[0] + 2, j0 - step[1] + 1 : j1 - step[1] + 2]
            sub = None
            for x, y in ((0, 1), (0, 2), (1, 2)):
                if step[x] and step[y]:
                    part = pairs[x, y][np.maximum(used[x] - 1, 0), np.maximum(used[y] - 1, 0)]
                    sub = part if sub is None else sub + part
            pen = cost[0][kind][:, i0 : i1 + 1, None] + cost[1][kind][:, None, j0 : j1 + 1] + cost[2][kind][:, kc]
            values = (source if sub is None else source + sub) + pen[..., None]
            if back is None:
                best = np.maximum.reduce(values, axis=0)
            else:
                best, came = values[0], np.zeros(values.shape[1:], np.uint8)
                for prev in range(1, 7):  # the first of equal ones stays
                    better = values[prev] > best
                    np.maximum(best, values[prev], out=best)
                    np.maximum(came, better.view(np.uint8) * np.uint8(prev), out=came)
            best[~possible] = NONE
            here[kind, i0 + 1 : i1 + 2, j0 + 1 : j1 + 2] = best
            if back is not None:
                rows, cols = np.nonzero(possible)
                back[kind][rows + i0, cols + j0, kc[rows, cols]] = came[rows, cols]
    ends = planes[(n + m + l) % 4][:, n + 1, m + 1].copy()
    close = config.costs[1]
    for kind in range(7):
        for s in range(3):
            if kind >> s & 1 and not config.free[2 * s + 1]:
                ends[kind] += close
    state = np.argmax(ends, axis=0)
    scores = ends[state, np.arange(count)]
    if back is None:
        return scores, None
    total = n + m + l
    steps = np.full((total, count), 7, np.uint8)
    at = [np.full(count, x) for x in lengths]
    every = np.arange(count)
    for t in range(total):
        alive = (at[0] > 0) | (at[1] > 0) | (at[2] > 0)
        if not alive.any():
            break
        steps[t, alive] = state[alive]
        came = back[state, at[0], at[1], at[2], every]
        at = [x - (alive & ((state >> s & 1) == 0)) for s, x in enumerate(at)]
        state = np.where(alive, came, state)
    return scores, steps


def render_block(seqs: tuple[np.ndarray, ...], steps: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bytes of the aligned rows, all triples in a row, and where each begins."""
    kinds, begin = forward_kinds(steps, 7)
    return [gapped_rows(x, (kinds >> s & 1) == 0) for s, x in enumerate(seqs)], begin


def triples_at_once(n: int, m: int, l: int, traceback: bool) -> int:
    each = (7 * (n + 1) * (m + 1) * (l + 1) if traceback else 0) + 8 * 7 * 5 * (n + 2) * (m + 2)
    return max(1, BUDGET // each)
