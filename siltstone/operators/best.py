"""The best of each of many slots (a query, or a query in a collection) among scored rows, in NumPy: what tasks keep of what they scored."""

from __future__ import annotations

import numpy as np

#: Ranks go by scores to 9 digits, which the caller rounds: rows that near to the last one kept stay too.
NEAR = 2e-9
#: A null id; as in an ascending sort, it comes first.
NULL_ID = np.iinfo(np.int64).min


def order(score: np.ndarray) -> np.ndarray:
    """What scores are sorted by: NaN is the greatest, as in Spark."""
    return np.where(np.isnan(score), np.inf, score)


def best(slot: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows that can be among the k best of their slot by (score to 9 digits, smaller id): the k best, and those within NEAR of the last.
    Of equal scores only the k smallest ids stay, so groups of copies do not add up."""
    by = order(score)
    at = np.lexsort((ident, -by, slot))
    s, v = slot[at], by[at]
    n = len(at)
    if not n:
        return at
    number = np.arange(n)
    first = lambda new: np.maximum.accumulate(np.where(np.r_[True, new], number, 0))
    opens = first(s[1:] != s[:-1])
    equal = number - first((s[1:] != s[:-1]) | (v[1:] != v[:-1]))
    last = np.minimum(opens + k - 1, n - 1)
    inside = s[last] == s
    least = np.where(inside, v[last], -np.inf)
    return at[((number - opens < k) | (v >= least - NEAR)) & (equal < k)]
