"""Truncated suffix sorting and threshold-bounded LCP intervals on a Burrows-Wheeler transform, in NumPy."""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sorting key; doubled until no less than the threshold.
_PACK = 7


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts, sorted by at least their first depth symbols (0 to 256); beyond that in any order."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(_PACK, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(_PACK):
        key = (key << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)  # of a suffix: the place of the first suffix that equals it so far
    rank[order] = first
    rank[n] = -1
    done = _PACK
    live = order[~(head & np.append(head[1:], True))]  # suffixes that are not alone yet, in order
    while done < depth and len(live):
        old = rank[live]
        key = (old << 32) | (rank[np.minimum(live + done, n)] + 1)
        by = np.argsort(key)
        live, key, old = live[by], key[by], old[by]
        place = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        head = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(head, place, 0))
        rank[live] = old + first - group
        live = live[~(head & np.append(head[1:], True))]
        done *= 2
    return np.argsort(rank[:n], kind="stable")


def common_prefixes(symbols: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """lcp[q]: the length that suffixes order[q - 1] and order[q] share, as far as it is below the threshold; else threshold.

    Breadth first: the boundaries with value v are found from those with value v - 1 by extending their intervals by one
    symbol backwards on the transform. The interval right of a boundary is scanned for the first place of each symbol; the
    image of that place under the last-to-first map is a boundary of the next value, unless one is there already. Each
    value's queue is handled at once; the search ends at the threshold or with an empty queue.
    """
    n = len(order)
    transform = symbols[order - 1].copy()
    transform[order == 0] = 0
    back = np.argsort(transform, kind="stable")  # last-to-first map, inverted
    forth = np.empty(n, np.int64)
    forth[back] = np.arange(n)
    initial = transform[back]
    starts = np.append(True, initial[1:] != initial[:-1])
    previous = np.empty(n, np.int64)  # the place before with the same symbol; -1: none
    previous[back] = np.where(starts, -1, np.append(0, back[:-1]))
    lcp = np.full(n, threshold, np.int32)
    fresh = np.flatnonzero(starts)
    lcp[fresh] = 0
    bounds = np.append(fresh, n)
    for value in range(threshold - 1):
        if not len(fresh):
            break
        size = bounds[np.searchsorted(bounds, fresh, "right")] - fresh
        total = int(size.sum())
        ends = np.cumsum(size)
        at = np.arange(total) + np.repeat(fresh - (ends - size), size)
        seen = previous[at]
        hit = forth[at[(seen < np.repeat(fresh, size)) & (seen >= 0)]]
        fresh = np.unique(hit[lcp[hit] == threshold])
        lcp[fresh] = value + 1
        bounds = np.sort(np.concatenate([bounds, fresh]), kind="stable")
    return lcp


def equal_windows(pieces: np.ndarray, offsets: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Class of each window: the strings of the given length at the first windows[i] places of piece i, piece by piece.
    Equal strings get equal classes; pieces[offsets[i]:offsets[i + 1]] are the bytes of piece i."""
    count = len(offsets) - 1
    size = np.diff(offsets)
    symbols = np.zeros(int(offsets[-1]) + count, np.uint16)  # a 0 ends each piece
    shift = np.repeat(np.arange(count), size)
    symbols[np.arange(int(offsets[-1])) + shift] = pieces.astype(np.uint16) + 1
    starts = offsets[:-1] + np.arange(count)
    order = suffix_order(symbols, length)
    group = np.empty(len(symbols), np.int64)
    group[order] = np.cumsum(common_prefixes(symbols, order, length) < length)
    ends = np.cumsum(windows)
    return group[np.arange(int(ends[-1])) + np.repeat(starts - (ends - windows), windows)]
