"""Suffix arrays by grouping, in linear time and without renaming.

Suffixes are grouped by their longest prefix that is a Lyndon word, and the groups are found in descending order: when a
group is taken, each of its suffixes points to the previous suffix that is in a smaller group, whose prefix the group's
prefix then extends; suffixes that are pointed to are moved to new groups just above their own, the more often the
higher. In the order of the groups, the suffixes are then emitted: each next suffix settles those before it whose prefix
ends where it begins.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in order. Its last symbol has to be less than all others."""
    n = len(text)
    previous, group, ascending = _lyndon_groups(text)
    slot, at = [0] * (max(group, default=0) + 1), 0
    for g, size in ascending:
        slot[g] = at
        at += size
    order, placed = [0] * n, bytearray(n)
    if n:
        order[0] = n - 1
        placed[n - 1] = 1
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[slot[g]] = i
            slot[g] += 1
            placed[i] = 1
            i = previous[i]
    return order


def _lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """For each suffix the previous smaller one (-1: none) and its group, and the groups with their sizes, least first."""
    n = len(text)
    rank = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [rank[c] for c in text]
    members: list[list[int]] = [[] for _ in rank]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below, above = list(range(-1, len(rank) - 1)), list(range(1, len(rank) + 1))
    if above:
        above[-1] = -1
    previous, taken = [-1] * n, bytearray(n)
    descending: list[tuple[int, int]] = []

    def new_group(old: int, moved: list[int]) -> int:
        """A group of ``moved``, members of ``old``, just above it."""
        g = len(members)
        members.append(moved)
        size.append(len(moved))
        size[old] -= len(moved)
        up = above[old]
        above.append(up)
        below.append(old)
        above[old] = g
        if up >= 0:
            below[up] = g
        for i in moved:
            group[i] = g
        return g

    current = len(rank) - 1
    while current >= 0:
        if not size[current]:
            current = below[current]
            continue
        own = members[current]
        if size[current] < len(own):
            own = [i for i in own if group[i] == current]
        descending.append((current, len(own)))
        if len(own) == 1:
            (i,) = own
            taken[i] = 1
            p = i - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0 and size[group[p]] > 1:
                new_group(group[p], [p])
            current = below[current]
            continue
        for i in own:
            taken[i] = 1
        counts: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, c in counts.items():
            moves.setdefault((group[p], c), []).append(p)
        # the least count first, just above the old group; larger counts above that
        last: dict[int, int] = {}
        for (g, c) in sorted(moves):
            moved = moves[g, c]
            if g not in last and len(moved) == size[g]:
                continue  # all of the group: it stays
            last[g] = new_group(last.get(g, g), moved) if g not in last else _above(new_group, last[g], g, moved, size)
        current = below[current]
    return previous, group, descending[::-1]


def _above(new_group, place: int, old: int, moved: list[int], size: list[int]) -> int:
    """A group of members of ``old`` just above the group ``place``."""
    g = new_group(place, moved)
    size[place] += len(moved)
    size[old] -= len(moved)
    return g
