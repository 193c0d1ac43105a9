"""Suffix sorting by prefix doubling over many short sequences at once."""

from __future__ import annotations

import numpy as np


def sort_suffixes(
    order: np.ndarray, same: np.ndarray, ends: np.ndarray, past_end: np.ndarray | None = None
) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Rank of every suffix, and the ranks by prefixes of 1, 2, 4 ... symbols while suffixes were still tied.

    order: positions sorted by first symbol; same: whether each but the first has the symbol of the one
    before it in that order; ends: where the sequence of each position ends; past_end: negative numbers that
    order suffixes which end at the same depth (by default such suffixes must differ in length).
    A rank is the place in the suffix array of the first suffix of the group.
    """
    n = len(order)
    rank = np.empty(n, np.int64)
    group = np.zeros(n, np.int64)
    group[1:] = np.where(same, 0, np.arange(1, n))
    rank[order] = np.maximum.accumulate(group)
    tied = np.zeros(n, bool)
    tied[1:] |= same
    tied[:-1] |= same
    active = order[tied]
    levels, width = [(1, rank.copy())], 1
    while len(active):
        after = active + width
        beyond = -1 if past_end is None else past_end[active]
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)], beyond)
        first = rank[active]
        order = np.lexsort((second, first))
        active, first, second = active[order], first[order], second[order]
        places = np.arange(len(active))
        new_group = np.append(True, first[1:] != first[:-1])
        start = np.maximum.accumulate(np.where(new_group, places, 0))
        new = new_group.copy()
        new[1:] |= second[1:] != second[:-1]
        head = np.maximum.accumulate(np.where(new, places, 0))
        rank[active] = first + head - start
        active = active[~(new & np.append(new[1:], True))]
        width *= 2
        if len(active):
            levels.append((width, rank.copy()))
    return rank, levels
