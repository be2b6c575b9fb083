"""Suffix sorting by linear grouping (after Baier, 2016).

Phase one groups suffixes by their longest Lyndon prefix.  Groups are processed in descending order; the suffixes of
a group hand their prefix to the nearest suffix before them that is in a lower group (found over previous-smaller
pointers), whose own prefix grows by it, and which moves to a new group just above its old one.  Phase two emits each
group's order: suffixes are read off in ascending order, and each places the suffixes whose Lyndon prefix ends where
it starts into the next free places of their groups.  Nothing is renamed or sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int] | bytes) -> list[int]:
    """Starts of all suffixes in ascending order (a proper prefix sorts before what it is a prefix of)."""
    n = len(text) + 1  # with an end mark below every symbol
    symbols = np.zeros(n, dtype=np.int64)
    symbols[:-1] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else np.asarray(text, dtype=np.int64)
    symbols[:-1] += 1
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(symbols[order]) != 0])
    starts = np.repeat(first, np.diff(np.r_[first, n]))
    slot = order.tolist()  # suffixes, arranged by group
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    at = place.tolist()  # where a suffix is in slot
    group = np.empty(n, dtype=np.int64)
    group[order] = starts
    group = group.tolist()  # first place of a suffix's group
    size = np.zeros(n, dtype=np.int64)
    size[first] = np.diff(np.r_[first, n])
    size = size.tolist()
    before = [-1] * n  # nearest earlier suffix of a lower group

    high = n - 1
    while high > 0:
        x = slot[high]
        low = group[x]
        if low == high:  # a group of one, the common case
            p = x - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            before[x] = p
            if p >= 0 and size[g := group[p]] > 1:
                size[g] = k = size[g] - 1
                end, i = g + k, at[p]
                y = slot[end]
                slot[i], slot[end] = y, p
                at[y], at[p] = i, end
                group[p], size[end] = end, 1
        else:
            members = slot[low : high + 1]
            for x in members:
                p = x - 1
                while p >= 0 and group[p] > low:
                    p = before[p]
                before[x] = p
            # members that stand right before each other repeat the prefix; it is handed on that many times
            lower: dict[int, int] = {}
            for x in members:
                path, p = [], x
                while p >= 0 and group[p] == low and p not in lower:
                    path.append(p)
                    p = before[p]
                if p >= 0 and group[p] == low:
                    p = lower[p]
                for y in path:
                    lower[y] = p
            times: dict[int, int] = {}
            for x, p in lower.items():
                before[x] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            ranks: dict[int, list[int]] = {}
            for p, k in times.items():
                ranks.setdefault(k, []).append(p)
            for k in sorted(ranks, reverse=True):
                moved = ranks[k]
                for p in moved:
                    g = group[p]
                    size[g] = m = size[g] - 1
                    end, i = g + m, at[p]
                    y = slot[end]
                    slot[i], slot[end] = y, p
                    at[y], at[p] = i, end
                for p in moved:  # those that left one group together form the new group
                    g = group[p]
                    if m := size[g]:
                        group[p] = g + m
                left = {g: 0 for g in (group[p] for p in moved)}
                for p in moved:
                    left[group[p]] += 1
                for g, m in left.items():
                    size[g] = m
        high = low - 1

    out, free, done = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return out[1:]
