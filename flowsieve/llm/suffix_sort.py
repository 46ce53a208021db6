"""Linear suffix sorting by grouping.

First phase: suffixes are put into groups by their first symbol, and the groups are processed from
the greatest to the least. Every suffix of a group points to the nearest place before it whose group
is smaller. A place that l suffixes point to begins with the context of its own group followed by
that of the processed group l times, so it leaves its group for a new one right behind; more repeats
go further back. In the end a group's context is the Lyndon prefix of its suffixes.

Second phase: the groups are in order; walking up the suffix array, the place before each suffix, and
from there along the pointers, is the next of its group, until one is met that is placed already.

No names are given to substrings and nothing is sorted again on a shorter text.
"""

from __future__ import annotations

from collections import defaultdict


def suffix_array(symbols: list[int]) -> list[int]:
    """Places of the suffixes of a list of non-negative numbers, in order; the end is smaller than any symbol."""
    n = len(symbols) + 1
    if n == 1:
        return []
    # Groups by first symbol; the empty suffix is the least. A group is named by its first place.
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for place, symbol in enumerate(symbols):
        by_symbol[symbol].append(place)
    order, group, size, slot = [n - 1], [0] * n, [0] * (n + 1), [0] * n
    size[0] = 1
    for symbol in sorted(by_symbol):
        members, start = by_symbol[symbol], len(order)
        for k, place in enumerate(members):
            group[place], slot[place] = start, start + k
        size[start] = len(members)
        order += members

    before = [-1] * n
    last = n - 1
    while last > 0:
        first = group[order[last]]
        members = order[first : last + 1]
        if last > first:
            members.sort()
        times: dict[int, int] = {}
        for place in members:
            p = place - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[place] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        last = first - 1
        if not times:
            continue
        most = max(times.values())
        if most == 1:
            levels = [list(times)]
        else:
            by_times: dict[int, list[int]] = defaultdict(list)
            for p, repeats in times.items():
                by_times[repeats].append(p)
            levels = [by_times[repeats] for repeats in sorted(by_times, reverse=True)]
        for leaving in levels:
            for p in leaving:  # to the end of its group, which becomes shorter
                start = group[p]
                size[start] -= 1
                end = start + size[start]
                here, other = slot[p], order[end]
                order[here], order[end] = other, p
                slot[other], slot[p] = here, end
            for p in leaving:  # all that left one group are one new group
                start = group[p] + size[group[p]]
                group[p] = times[p] = start
            for p in leaving:
                size[times[p]] += 1
    del slot

    out, placed = [-1] * n, [False] * n
    free = list(range(n + 1))
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            start = group[p]
            out[free[start]] = p
            free[start] += 1
            placed[p] = True
            p = before[p]
    return out[1:]
