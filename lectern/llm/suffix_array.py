"""Linear grouping construction of suffix arrays of integer sequences.

Phase 1 sorts suffixes into groups by the Lyndon prefix that starts them. Groups are processed in descending order; each
member's pointer goes to the previous position whose group is smaller, and the positions pointed at are split off their
groups, first by how many members point at them, in descending order, to stand right behind their old group. Phase 2
walks the order from its least suffix and follows pointers, so that each group's order is emitted as its members are met.
No suffix is renamed again and none is compared.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the sequence's suffixes in ascending order; a suffix that is a prefix of another comes before it."""
    n = len(text) + 1  # with an end below all symbols
    if n == 1:
        return []
    order = [n - 1, *sorted(range(n - 1), key=text.__getitem__)]
    group, size, place = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        place[i] = at
        if at and (at == 1 or text[i] != text[order[at - 1]]):
            start = at
        group[i] = start
        size[start] += 1
    pointer = _grouped(order, group, size, place)
    return _emitted(n, group, pointer)[1:]


def _grouped(order: list[int], group: list[int], size: list[int], place: list[int]) -> list[int]:
    pointer = [-1] * len(order)
    end = len(order) - 1
    while end >= 0:
        start = group[order[end]]
        pointed: dict[int, int] = {}
        for i in sorted(order[start : end + 1]) if end > start else (order[end],):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = start - 1
        if not pointed:
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
        for c in sorted(by_count, reverse=True):
            for g, members in by_count[c].items():
                whole, part = size[g], len(members)
                if part == whole:
                    continue
                last = g + whole - 1
                for j in members:
                    at, other = place[j], order[last]
                    order[at], place[other] = other, at
                    order[last], place[j] = j, last
                    last -= 1
                new = last + 1
                for j in members:
                    group[j] = new
                size[g], size[new] = whole - part, part
    return pointer


def _emitted(n: int, group: list[int], pointer: list[int]) -> list[int]:
    out, filled, placed = [-1] * n, [0] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = True
            j = pointer[j]
    return out
