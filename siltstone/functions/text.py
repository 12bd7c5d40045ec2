"""Text expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words of the common search-engine list (fixed values).
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: str | Column) -> Column:
    """Without white space at either end; null as empty."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^\s+|\s+$", "")


def none_if_blank(x: str | Column) -> Column:
    t = trimmed(x)
    return F.when(t != "", t)


def split_words(x: str | Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), r"\s+"), lambda w: w != "")


def lines(x: str | Column) -> Column:
    return F.split(F.coalesce(col(x), F.lit("")), "\n")


def tokens(x: str | Column) -> Column:
    """Lower-case Unicode words without stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def holds_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def title_case(x: str | Column) -> Column:
    """Each run of letters with its first letter in upper case, the rest in lower; what is no letter ends a run."""
    runs = F.regexp_extract_all(col(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def let(x: Column, use) -> Column:
    """use(x) with x evaluated once per row, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def count_of(x: Column, part: str) -> Column:
    """Occurrences of part that do not overlap."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("long")


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of lower-case white-space token sets; 0 if one is empty."""
    x, y = F.array_distinct(split_words(F.lower(a))), F.array_distinct(split_words(F.lower(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
