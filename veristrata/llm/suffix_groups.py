"""Suffix arrays by Lyndon grouping, in linear time and without recursion or renaming.

Suffixes start grouped by their first symbol. Groups are taken in descending order; each member finds its previous
smaller suffix, whose group's common prefix it extends. Parents leave their group for new ones right above it, by how
many members of the taken group follow them in a row. In the end every group holds the suffixes with one longest
Lyndon prefix, in order; the second phase then emits each group's order: a suffix, once placed, places those whose next
smaller suffix it is, at the fronts of their groups.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in order; the end counts as smaller than any symbol."""
    n = len(symbols)
    members: list[list[int]] = []  # with some that have left
    below: list[int] = []  # the next lower group
    group = [0] * n
    first: dict[int, int] = {}
    for s in sorted(set(symbols)):
        first[s] = len(members)
        below.append(len(members) - 1)
        members.append([])
    for i, s in enumerate(symbols):
        group[i] = first[s]
        members[first[s]].append(i)
    size = [len(m) for m in members]
    above = {g - 1: g for g in range(1, len(members))}
    smaller = [-1] * n
    taken = bytearray(n)
    order = []
    g = len(members) - 1
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]
        if own:
            if len(own) > 1:
                own.sort()
            order.append(g)
            for i in own:
                taken[i] = 1
            follow: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and taken[p]:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    follow[p] = follow.get(p, 0) + 1
            if follow:
                moved: dict[tuple[int, int], list[int]] = {}
                for p, times in follow.items():
                    moved.setdefault((group[p], times), []).append(p)
                # right above the old group: more members in a row, higher group
                for old, times in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                    parents = moved[old, times]
                    if len(parents) == size[old]:
                        continue
                    new = len(members)
                    up = above.get(old)
                    members.append(parents)
                    size[old] -= len(parents)
                    size.append(len(parents))
                    below.append(old)
                    above[old] = new
                    if up is not None:
                        below[up] = new
                        above[new] = up
                    for p in parents:
                        group[p] = new
        g = below[g]
    order.reverse()
    start = [0] * len(members)
    at = 0
    for g in order:
        start[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = bytearray(n)

    def place(p: int) -> None:
        while p >= 0 and not placed[p]:
            g = group[p]
            out[start[g]] = p
            start[g] += 1
            placed[p] = 1
            p = smaller[p]

    place(n - 1)
    for i in range(n):
        place(out[i] - 1)
    return out


def neighbours(symbols: list[int], order: list[int]) -> list[int]:
    """For order[r] and order[r + 1], their common symbols (the last entry is 0)."""
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out = [0] * n
    h = 0
    for i in range(n):
        r = rank[i] + 1
        if r == n:
            h = 0
            continue
        j = order[r]
        most = n - max(i, j)
        while h < most and symbols[i + h] == symbols[j + h]:
            h += 1
        out[r - 1] = h
        h -= h > 0
    return out
