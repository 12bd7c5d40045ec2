"""MinHash near-dedup with tensored banding: pairs of keys from two small hash collections form the tables.

A document's set is its distinct 5-word shingles (64-bit hashes; words are lower-cased in A-Z and separated by ASCII white
space). Two collections of ``SIDE`` keys, each key over ``ROWS`` minhashes, need 2 * SIDE * ROWS minhash functions; every pair of
a key of the first with one of the second is a table, so SIDE ** 2 tables come from 48 functions instead of 576. A pair of
sets with Jaccard similarity 0.75 shares no table with a chance of about 1e-4, one of 0.85 with about 1e-7.

Steps, none of which brings the rows of a group together:
1. one pass over the texts gives each set's size, 128-bit fingerprint, keys and a 1024-bit parity sketch;
2. documents of equal sets are one class, represented by the smallest doc_id;
3. only classes that share a key of the first collection form table keys;
4. each member of a table is paired with the table's smallest member; pairs whose sizes or sketches rule a link out go
   (the number of bits that differ never exceeds the number of differing shingles, so no link is lost), the others are
   confirmed on the full sets, and confirmed links give components;
5. in tables that still hold several components, the members outside the table's largest component are paired with the members of other
   components, under the same exact filters, and these pairs are confirmed too. Members of one component need no further confirmation.

Pairs meet in a table, and sets in a confirmation, in parts: the work of a table or of a document with many partners is split by
its size, which is counted first.

Defined cases: null, empty and white-space texts have an empty set and are linked with nothing; one to four words are a single
shingle; rows with a null doc_id are linked with nothing and kept; rows that repeat a doc_id all get the component of
any of them; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, as_bytes, mix64, slices, thrifty
from siltstone.llm.components import components

WORDS = 5
SIDE, ROWS = 12, 2
#: A link: SIMILAR[0] * union <= SIMILAR[1] * intersection.
SIMILAR = (75, 100)
SKETCH = 16  # 64-bit words
#: Partners of a document, and comparisons in a cell, that one task takes.
PARTNERS, COMPARED = 64, 4_000_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256).astype(np.uint64)
_PLACE = _rng.integers(1, 2**63, WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_XOR, _MUL = _rng.integers(1, 2**63, (2, 2 * SIDE * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        base = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _powers[:] = [np.multiply.accumulate(base), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets) of the texts data[offsets[i]:offsets[i + 1]]: sorted distinct 64-bit hashes of each."""
    n = len(offsets) - 1
    empty = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    if not len(data):
        return empty
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return empty
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    w = mix64((total[ends + 1] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)  # words before each text
    full = np.zeros(max(len(w) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        full += w[j : j + len(full)] * _PLACE[j]
    full = mix64(full, 1)
    out, sizes = [], np.zeros(n + 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), 1):
        if b - a >= WORDS:
            one = np.sort(full[a : b - WORDS + 1])
            if len(one) > 1:
                one = one[np.append(True, one[1:] != one[:-1])]
        elif b > a:
            one = mix64(np.array([int((w[a:b] * _PLACE[: b - a]).sum())], np.uint64), 2 + b - a)
        else:
            continue
        out.append(one)
        sizes[i] = len(one)
    return np.concatenate(out), np.cumsum(sizes)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each non-empty set: two fingerprints, keys of either collection (int64), parity sketch (int64)."""
    starts = offsets[:-1]
    low = np.empty((len(starts), 2 * SIDE * ROWS), np.uint64)
    for k in range(2 * SIDE * ROWS):
        low[:, k] = np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], starts)
    low = low.reshape(len(starts), 2, SIDE, ROWS)
    keys = np.zeros((len(starts), 2, SIDE), np.uint64)
    for r in range(ROWS):
        keys = mix64(keys ^ low[..., r], 11 + r)
    keys = keys.view(np.int64)
    prints = [np.add.reduceat(mix64(sets, s), starts).view(np.int64) for s in (21, 22)]
    bits = 64 * SKETCH
    row = np.repeat(np.arange(len(starts)), np.diff(offsets))
    odd = np.bincount(row * bits + (sets >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=len(starts) * bits) & 1
    sketch = np.packbits(odd.astype(np.uint8).reshape(len(starts), bits), axis=1).view(np.int64)
    return prints[0], prints[1], keys[:, 0], keys[:, 1], sketch


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def sign(documents: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, a, b, bits) of every row; all but the first two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for x, y in slices(offsets, 2 << 20):
                sets, at = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                size = np.diff(at)
                some = np.flatnonzero(size)
                ids = batch.column(0).slice(x, y - x)
                parts = [signatures(sets, np.append(at[:-1][some], at[-1]))] if len(some) else []
                place = np.full(y - x, -1)
                place[some] = np.arange(len(some))
                take = pa.array(place, mask=place < 0)
                columns = [ids, pa.array(size.astype(np.int64))]
                for i, kind in enumerate((pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)):
                    if parts:
                        got = parts[0][i]
                        columns.append((_lists(got) if got.ndim == 2 else pa.array(got)).take(take))
                    else:
                        columns.append(pa.nulls(y - x, kind))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "a", "b", "bits"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(thrifty(run), "doc_id long, n long, f1 long, f2 long, a array<long>, b array<long>, bits array<long>")


def _possible(x: str, y: str) -> Column:
    """Whether sizes and sketches leave a link open: |x - y| + |y - x| = |x| + |y| - 2 * intersection."""
    s, t = SIMILAR
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    differ = sum(F.bit_count(F.col(f"bits{x}")[i].bitwiseXOR(F.col(f"bits{y}")[i])) for i in range(SKETCH))
    # intersection >= (n + m) * s / (s + t), so the sets differ in at most (n + m) * (t - s) / (t + s) shingles.
    return (F.least(n, m) * t >= F.greatest(n, m) * s) & (differ * (s + t) <= (n + m) * (t - s))


def confirm(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (x, y) whose full sets are similar enough. Of a pair, the document with more partners is the hub, whose set goes to
    as many parts as it has ``PARTNERS`` partners; the other's set is sent to one of them."""
    work = Scratch(documents.sparkSession, "confirm")
    ends = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).groupBy("id").agg(F.count("*").alias("partners"))
    ends = work.table(ends, "ends")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ends.select("id").hint("shuffle_merge"), "id").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for x, y in slices(offsets, 2 << 20):
                sets, at = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                got = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), got], names=["id", "set"])

    sets = work.table(texts.mapInArrow(thrifty(run), "id long, set array<long>"), "sets")
    busy = ends.where(F.col("partners") > PARTNERS)
    both = pairs.join(busy.toDF("x", "px"), "x", "left").join(busy.toDF("y", "py"), "y", "left")
    turn = F.coalesce("px", F.lit(0)) > F.coalesce("py", F.lit(0))
    parts = F.ceil(F.greatest(F.coalesce("px", F.lit(1)), F.coalesce("py", F.lit(1))) / PARTNERS).cast("long")
    both = both.select("x", "y", F.when(turn, F.col("y")).otherwise(F.col("x")).alias("spoke"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("hub"), parts.alias("parts"))
    both = work.table(both.select("*", F.pmod(F.xxhash64("spoke"), "parts").alias("part")), "met")
    hubs = both.select("hub", "parts").distinct().join(sets.select(F.col("id").alias("hub"), F.col("set").alias("sy")), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "sy")
    left = both.select("x", "y", "spoke", "hub", "part").join(sets.select(F.col("id").alias("spoke"), F.col("set").alias("sx")), "spoke")
    out = left.join(hubs, ["hub", "part"]).withColumn("common", F.size(F.array_intersect("sx", "sy")))
    s, t = SIMILAR
    return out.where(F.col("common") * t >= (F.size("sx") + F.size("sy") - F.col("common")) * s).select("x", "y").distinct()


def across(members: DataFrame) -> DataFrame:
    """members (cell, doc, part, n, bits): the distinct possible pairs (x > y) of documents of a cell in different parts. Only members outside the
    largest part meet all others, so a cell costs its size times what stands apart; it is dealt to tasks by that product."""
    sizes = members.groupBy("cell", "part").agg(F.count("*").alias("m"))
    cells = sizes.groupBy("cell").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all"))
    deal = F.ceil((F.col("all") - F.col("top.m")) * F.col("all") / COMPARED).cast("long")
    cells = cells.select("cell", F.col("top.part").alias("main"), deal.alias("deal")).where("deal > 0")
    dealt = members.join(cells, "cell")
    few = dealt.where("part <> main").select("cell", F.pmod(F.xxhash64("doc"), "deal").alias("at"), F.col("doc").alias("a"), F.col("part").alias("pa"), F.col("main"), F.col("n").alias("na"), F.col("bits").alias("bitsa"))
    all_ = dealt.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)).alias("at"), F.col("doc").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("bits").alias("bitsb"))
    met = few.join(all_, ["cell", "at"]).where((F.col("pa") != F.col("pb")) & ((F.col("pb") == F.col("main")) | (F.col("a") > F.col("b"))) & _possible("a", "b"))
    return met.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text)."""
    work = Scratch(documents.sparkSession, "minhash")
    signed = work.table(sign(documents), "signed")
    some = signed.where(F.col("f1").isNotNull() & F.col("doc_id").isNotNull())
    classes = work.table(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc")), "classes")
    ones = some.join(classes.select(F.col("doc").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    ones = work.table(ones.select(F.col("doc_id").alias("doc"), "n", "a", "b", "bits"), "classes")

    first = ones.select("doc", F.posexplode("a").alias("i", "key"))
    shared = first.groupBy("i", "key").agg(F.count("*").alias("c")).where("c > 1").select("i", "key")
    live = first.join(shared, ["i", "key"], "left_semi")
    cells = live.join(ones.select("doc", "b"), "doc").select("doc", F.col("i"), "key", F.posexplode("b").alias("j", "other"))
    cells = cells.select("doc", F.xxhash64("i", "j", "key", "other").alias("cell"))
    least = cells.groupBy("cell").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    cells = work.table(cells.join(least.select("cell", "low"), "cell").select("cell", "doc", "low"), "cells")

    about = ones.select("doc", "n", "bits")

    def open_pairs(pairs: DataFrame) -> DataFrame:
        out = pairs.join(about.toDF("x", "nx", "bitsx"), "x").join(about.toDF("y", "ny", "bitsy"), "y")
        return out.where(_possible("x", "y")).select("x", "y")

    pairs = work.table(open_pairs(cells.where("doc > low").select(F.col("doc").alias("x"), F.col("low").alias("y")).distinct()), "pairs")
    links = work.table(confirm(documents, pairs), "links")
    found = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), work)

    # Cells that hold several components: every pair across components is decided as well.
    placed = cells.join(found.withColumnRenamed("id", "doc"), "doc", "left").select("cell", "doc", F.coalesce("component", "doc").alias("part"))
    placed = work.table(placed, "placed")
    mixed = placed.groupBy("cell").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("cell")
    members = work.table(placed.join(mixed, "cell", "left_semi").join(about, "doc"), "mixed")
    apart = work.table(across(members).join(pairs, ["x", "y"], "left_anti"), "across")
    if not apart.isEmpty():
        more = work.table(confirm(documents, apart), "more")
        if not more.isEmpty():
            found = components(links.unionByName(more).select(F.col("x").alias("u"), F.col("y").alias("v")), work)

    label = classes.join(found.withColumnRenamed("id", "doc"), "doc", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "doc").alias("component"))
    out = signed.select("doc_id", "n", "f1", "f2").join(label, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
