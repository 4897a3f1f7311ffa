"""Suffix sorting by linear grouping construction.

Phase 1 keeps suffixes in ordered groups, at first by symbol. Groups are taken from the highest down. Each member's
previous-smaller pointer is the nearest position before it that lies in a lower group; what it points to has a prefix
that this member's prefix extends, so the suffixes pointed to move up within their groups, those with more extensions
higher. At the end a group holds exactly the suffixes that share their longest Lyndon prefix, in order.
Phase 2 walks the suffix array from the front: the suffix before the one just placed, and what its pointers lead to,
take the next free place of their group. No recursion and no renaming.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The suffix array of symbols and an end mark below all of them (left out of the result)."""
    n = len(symbols)
    if n == 0:
        return []
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    # Groups are numbered as they arise and linked in order; `lower` and `higher` are their neighbours.
    members: list[set[int]] = [set(by_symbol[s]) for s in sorted(by_symbol)]
    count = len(members)
    lower = list(range(-1, count - 1))
    higher = [*range(1, count), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    done = bytearray(n)
    previous = [-1] * n
    top = count - 1
    while top >= 0:
        own = members[top]
        for s in own:
            done[s] = 1
        children: Counter[int] = Counter()
        for s in sorted(own) if len(own) > 1 else own:
            j = s - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                children[j] += 1
        if children:
            moves: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, k in children.items():
                moves[(-k, group[p])].append(p)
            for key in sorted(moves) if len(moves) > 1 else moves:  # most children first; each lands just above its old group
                old, moved = key[1], moves[key]
                rest = members[old]
                if len(moved) == len(rest):
                    continue  # the whole of what is left of its group: it stays where it is
                new = count
                count += 1
                rest.difference_update(moved)
                members.append(set(moved))
                above = higher[old]
                lower.append(old)
                higher.append(above)
                higher[old] = new
                if above >= 0:
                    lower[above] = new
                for p in moved:
                    group[p] = new
        top = lower[top]
    free = [0] * count
    g = next(x for x in range(count) if lower[x] < 0)
    at = 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = higher[g]
    out = [0] * n
    placed = bytearray(n)
    at, j = -1, n - 1  # the end mark comes first; before it stands the last suffix
    while True:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = previous[j]
        at += 1
        if at == n:
            return out
        j = out[at] - 1


def common_prefixes(symbols: Sequence[int], order: Sequence[int]) -> list[int]:
    """For each place of the suffix array, how many symbols its suffix shares with the one before it."""
    n = len(order)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out = [0] * n
    h = 0
    for i in range(n):
        k = rank[i]
        if k == 0:
            h = 0
            continue
        j = order[k - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        out[k] = h
        if h:
            h -= 1
    return out
