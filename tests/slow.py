"""Plain per-path scoring, for differential tests: every alignment is a list of columns, its score follows the rules directly."""

from functools import lru_cache
from itertools import product


def scaled(config, left1, right1, left2, right2):
    if config.scaler is None:
        return 1.0
    names = ("seq1_left_free", "seq1_right_free", "seq2_left_free", "seq2_right_free")
    return config.scaler(left1, right1, left2, right2, **dict(zip(names, config.free)))


def column_factor(config, kind, i, j, n, m):
    return scaled(config, i if kind == 1 else i - 1, n - i, j if kind == 2 else j - 1, m - j)


def path_score(config, a, b, kinds):
    """kinds: 0 both letters, 1 a gap in the first row, 2 in the second."""
    n, m = len(a), len(b)
    first, close = config.costs
    l1, r1, l2, r2 = config.free
    i = j = 0
    before = 0
    total = 0.0
    spot = None
    for kind in kinds:
        ni, nj = i + (kind != 1), j + (kind != 2)
        if kind == 0:
            total += config.matrix.scores[a[i]][b[j]] * column_factor(config, 0, ni, nj, n, m)
        elif kind == 1:
            if not ((i == 0 and l1) or (i == n and r1)):
                total += (config.gap_extend if before == 1 else first) * column_factor(config, 1, ni, nj, n, m)
        elif not ((j == 0 and l2) or (j == m and r2)):
            total += (config.gap_extend if before == 2 else first) * column_factor(config, 2, ni, nj, n, m)
        if before == 1 and kind != 1 and not (l1 and i == 0):
            total += close * column_factor(config, 1, *spot, n, m)
        if before == 2 and kind != 2 and not (l2 and j == 0):
            total += close * column_factor(config, 2, *spot, n, m)
        i, j, before, spot = ni, nj, kind, (ni, nj)
    if before == 1 and not r1 or before == 2 and not r2:
        total += close * column_factor(config, before, n, m, n, m)
    return total


@lru_cache(maxsize=None)
def paths(n, m):
    if n == m == 0:
        return ((),)
    out = []
    for kind, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0))):
        if n >= di and m >= dj:
            out += [(*rest, kind) for rest in paths(n - di, m - dj)]
    return tuple(out)


def best(config, a, b):
    return max(path_score(config, a, b, p) for p in paths(len(a), len(b)))


def path_score3(config, seqs, kinds):
    sizes = [len(s) for s in seqs]
    first, close = config.costs
    at, before, total = [0, 0, 0], 0, 0.0
    for kind in kinds:
        letters = [None if kind >> s & 1 else seqs[s][at[s]] for s in range(3)]
        for x, y in ((0, 1), (0, 2), (1, 2)):
            if letters[x] and letters[y]:
                total += config.matrix.scores[letters[x]][letters[y]]
        for s in range(3):
            left, right = config.free[2 * s : 2 * s + 2]
            if letters[s] is None:
                if not ((at[s] == 0 and left) or (at[s] == sizes[s] and right)):
                    total += config.gap_extend if before >> s & 1 else first
            elif before >> s & 1 and not (left and at[s] == 0):
                total += close
        at = [x + (letters[s] is not None) for s, x in enumerate(at)]
        before = kind
    return total + sum(close for s in range(3) if before >> s & 1 and not config.free[2 * s + 1])


@lru_cache(maxsize=None)
def paths3(n, m, l):
    if n == m == l == 0:
        return ((),)
    out = []
    for kind in range(7):
        step = [1 - (kind >> s & 1) for s in range(3)]
        if n >= step[0] and m >= step[1] and l >= step[2]:
            out += [(*rest, kind) for rest in paths3(n - step[0], m - step[1], l - step[2])]
    return tuple(out)


def best3(config, seqs):
    return max(path_score3(config, seqs, p) for p in paths3(*map(len, seqs)))


FLAGS = list(product((False, True), repeat=4))
