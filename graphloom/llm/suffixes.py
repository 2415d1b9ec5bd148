"""Suffix arrays of many small texts at once, by grouping suffixes by their longest Lyndon prefix.

First part: suffixes are grouped by their first letter. The groups of a text are
then visited in descending order. For each suffix i of the visited group, the
nearest position to the left that is in a smaller group, its previous smaller
one, gets the group's prefix appended to its own, and so moves to a new group
just above its old one; a position reached by more suffixes of the group goes
higher. At the end each group holds the suffixes with one Lyndon prefix, and
groups are in order. Nothing is ever renamed.

Second part: suffixes are emitted in ascending order. When suffix p is emitted,
each suffix whose Lyndon prefix ends just before p takes the next free place
of its own group.

Both parts work on all texts side by side, a group (or a suffix) of each in a
round, so that a round is a few array operations over all texts.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then those of starts[1], ..."""
    total = int(sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    return np.repeat(starts - firsts, sizes) + np.arange(total)


def suffix_arrays(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text letters[bounds[b] : bounds[b + 1]] its suffixes in ascending order, in the same places.

    The last letter of a text must be smaller than all its others.
    """
    groups, prefix = lyndon_groups(letters, bounds)
    return emit(groups, prefix, bounds)


def lyndon_groups(letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, length) of each suffix: the first place of its group, and the length of its longest Lyndon prefix."""
    n = len(letters)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((np.arange(n), letters, text))  # places to suffixes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ordered, owner = letters[order], text[order]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    size = np.zeros(n + 1, np.int64)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, size[first])
    length = np.ones(n, np.int64)
    before = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    low = bounds[:-1].astype(np.int64)
    top = bounds[1:].astype(np.int64).copy()  # the visited group of a text ends here
    live = np.flatnonzero(top > low)
    while len(live):
        end = top[live]
        start = group[order[end - 1]]
        top[live] = start
        members = order[_ranges(start, end - start)]
        floor = np.repeat(low[live], end - start)
        visited = group[members]
        grown = length[members]
        live = live[start > low[live]]
        # the previous smaller positions, jumping over what is known to be no smaller
        at = members - 1
        before[members] = at
        wait = np.arange(len(members))
        while len(wait):
            p = at[wait]
            wait = wait[(p >= floor[wait]) & (group[np.maximum(p, 0)] >= visited[wait])]
            if len(wait):
                at[wait] = before[at[wait]]
                before[members[wait]] = at[wait]
        reached = at >= floor
        if not reached.any():
            continue
        at, grown = at[reached], grown[reached]
        sort = np.argsort(at, kind="stable")
        at, grown = at[sort], grown[sort]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        times = np.diff(np.append(head, len(at)))
        who, grown = at[head], grown[head]
        # those that move go to the end of their group, those reached more often last
        old = group[who]
        sort = np.lexsort((times, old))
        who, times, grown, old = who[sort], times[sort], grown[sort], old[sort]
        heads = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        many = np.diff(np.append(heads, len(who)))
        affected = old[heads]
        zone_start = affected + size[affected] - many
        zone = _ranges(zone_start, many)
        moved[who] = True
        there = order[zone]
        stay = there[~moved[there]]
        free = place[who]
        free = free[free < np.repeat(zone_start, many)]
        moved[who] = False
        if len(stay):
            order[free] = stay
            place[stay] = free
        order[zone] = who
        place[who] = zone
        size[affected] -= many
        split = np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
        firsts = np.flatnonzero(split)
        sizes = np.diff(np.append(firsts, len(who)))
        size[zone[firsts]] = sizes
        group[who] = np.repeat(zone[firsts], sizes)
        length[who] += times * grown
    return group, length


def emit(group: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes of each text in ascending order, from their groups and Lyndon prefixes."""
    n = len(group)
    ends_at = np.arange(n) + length  # the suffix after the Lyndon prefix
    by_end = np.argsort(ends_at, kind="stable")
    start = np.searchsorted(ends_at[by_end], np.arange(n + 1))
    free = np.arange(n)  # the next free place of the group that starts here
    out = np.full(n, -1, np.int64)
    low, sizes = bounds[:-1].astype(np.int64), np.diff(bounds)
    full = np.flatnonzero(sizes > 0)
    # the last letter is the smallest suffix of its text
    out[low[full]] = low[full] + sizes[full] - 1
    by_size = full[np.argsort(-sizes[full], kind="stable")]
    ordered = -sizes[by_size]
    for r in range(int(sizes.max(initial=0))):
        here = by_size[: np.searchsorted(ordered, -r)]
        p = out[low[here] + r]
        count = start[p + 1] - start[p]
        j = by_end[_ranges(start[p], count)]
        # a suffix that ends where another text begins belongs to that one's neighbour, and is skipped
        if r == 0 or len(j):
            own = np.repeat(low[here], count)
            j = j[j >= own]
            g = group[j]
            out[free[g]] = j
            free[g] += 1
    return out
