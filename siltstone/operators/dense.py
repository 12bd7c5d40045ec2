"""Dense search by cosine similarity, exact: top k first, threshold and payload after.

The query set is a table; queries are dealt into blocks, points into parts, and each part meets each block in a task of its own, where NumPy computes scores (Spark's expressions, where
ids are no whole numbers). For a top k (``nearest``), only what can be among the best leaves a task."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import let, trimmed
from siltstone.operators.best import NULL_ID, best
from siltstone.sources.tables import cut

MOST_QUERIES, MOST_POINTS = 5_000, 50_000
#: Points of a part that a task scans, scores that it holds at a time, and points and queries of a task that gives all pairs.
PART, CELLS, SIDE = 20_000, 1 << 21, 1_400
#: Scores in double precision that ranks to 9 digits may take for one another; points that meet queries at a time, of which the first bound what later ones must reach.
LOOSE, TILE = 1e-8, 4_096
#: Scores that are summed at a time where all are given, and digits that rounding can need.
NEAR, DECIMALS = 1 << 14, Context(prec=400)


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def _whole(points: DataFrame, queries: DataFrame) -> bool:
    """Whether ids are whole numbers, which NumPy sorts as Spark does."""
    kinds = (T.LongType, T.IntegerType, T.ShortType)
    return isinstance(points.schema["id"].dataType, kinds) and isinstance(queries.schema["query_id"].dataType, kinds)


def _meet(points: DataFrame, queries: DataFrame, task, part: int, block: int) -> DataFrame:
    """task(points, queries) for each part of about part points and each block of about block queries, in a task of its own: (query_id, id, score)."""
    n, m = points.count(), queries.count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(-(-n // part), min(cores, -(-n // 500)), 1), max(-(-m // block), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    p = points.select(F.col("id").cast("long").alias("id"), doubles("vector").alias("v")).where("v IS NOT NULL").withColumn("part", deal(parts)).withColumn("block", each(blocks))
    q = queries.select(F.col("query_id").cast("long").alias("id"), doubles("vector").alias("v")).where("v IS NOT NULL").withColumn("block", deal(blocks)).withColumn("part", each(parts))
    found = p.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(task, "query_id long, id long, score double")
    kind = lambda df, c: F.col(c).cast(df.schema[c].dataType).alias(c)
    return found.select(kind(queries, "query_id"), kind(points, "id"), "score")


def scores(points: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """points (id, vector), queries (query_id, vector) -> (query_id, id, score, rounded to digits if given) of all pairs; vectors without length or of another size are out. For the best of them see ``nearest``."""
    if _whole(points, queries):
        return _meet(points, queries, lambda a, b: _all(a, b, digits), SIDE, SIDE)
    if digits is not None:
        return scores(points, queries).withColumn("score", F.round("score", digits))
    p = points.select("id", doubles("vector").alias("v")).withColumn("vn", norm(F.col("v"))).where("vn > 0")
    q = queries.select("query_id", doubles("vector").alias("q")).withColumn("qn", norm(F.col("q"))).where("qn > 0")
    asked = q.count()
    if asked <= MOST_QUERIES:
        pairs = p.crossJoin(F.broadcast(q))
    else:
        blocks, parts = -(-asked // MOST_QUERIES), -(-points.count() // MOST_POINTS)
        deal = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        pairs = p.withColumn("part", deal("id", parts)).withColumn("block", each(blocks)).join(q.withColumn("block", deal("query_id", blocks)).withColumn("part", each(parts)), ["block", "part"])
    return pairs.where(F.size("v") == F.size("q")).select("query_id", "id", (dot(F.col("v"), F.col("q")) / (F.col("vn") * F.col("qn"))).alias("score"))


def top(scored: DataFrame, k: int | Column, by: str = "query_id") -> DataFrame:
    """With rank: the k best of each query; equal scores (to 9 digits) by id. k may be a column."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """top(scores(points, queries), k), without a row for each pair: a task gets a part of the points and a block of the queries, finds by products of matrices
    what can be among the k best of each query, and computes the scores of that in order. Pairs are many by nature (queries by points); rows that leave a task are not."""
    if not _whole(points, queries):
        return top(scores(points, queries), k)
    return top(_meet(points, queries, lambda a, b: _met(a, b, k), PART, MOST_QUERIES), k)


def _rows(query: np.ndarray, ident: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query, mask=query == NULL_ID), "id": pa.array(ident, mask=ident == NULL_ID), "score": pa.array(score)})


def _by_size(rows: pa.Table) -> dict[int, tuple]:
    """size -> (ids, vectors, lengths) of the vectors without nulls that have a length; NaN counts as one, as in Spark."""
    out = {}
    v = rows["v"].combine_chunks()
    ids = rows["id"].combine_chunks().fill_null(NULL_ID).to_numpy()
    size = v.value_lengths().to_numpy()
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        flat = v.take(pa.array(at)).flatten()
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1)
        x = flat.fill_null(0.0).to_numpy().reshape(-1, n)
        total = np.zeros(len(x))
        for d in range(n):
            total += x[:, d] * x[:, d]
        length = np.sqrt(total)
        good = whole & ~(length <= 0)
        out[n] = ids[at][good], np.ascontiguousarray(x[good]), length[good]
    return out


def _met(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """What can be among the k best of each query: a product in single precision of vectors of length 1, with the error that it can have, finds it, and only that is scored in order.
    The best of the first points bound what later ones must reach, so most scores are compared once and never sorted."""
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    asked = _by_size(queries)
    with np.errstate(all="ignore"):
        for n, (ids, x, length) in _by_size(points).items():
            if n not in asked or not len(ids):
                continue
            names, y, asking = asked[n]
            p, q = (x / length[:, None]).astype(np.float32), (y / asking[:, None]).astype(np.float32)
            # What is not finite, or too short or long to divide well, is always scored.
            odd = lambda v, size: ~(np.isfinite(v).all(axis=1) & (size > 1e-140) & (size < 1e140))
            aside, strange = odd(p, length), odd(q, asking)
            p[aside], q[strange] = 0, 0
            loose = np.flatnonzero(aside)
            margin = np.float32(2 * (n + 8) * 2.0**-23 + LOOSE)
            step = max(1, CELLS // len(ids))
            for a in range(0, len(names), step):
                b = min(a + step, len(names))
                least = np.full(b - a, -np.inf, np.float32)
                found = []
                for c in range(0, len(ids), TILE):
                    close = q[a:b] @ p[c : c + TILE].T
                    if loose.size:
                        close[:, aside[c : c + TILE]] = -np.inf
                    if close.shape[1] > k and c == 0:
                        least = np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k] - margin
                        least[strange[a:b]] = -np.inf
                    i, j = np.divmod(np.flatnonzero(close >= least[:, None]), close.shape[1])
                    found.append((i, j + c, close[i, j]))
                    if sum(len(f[0]) for f in found) > 2 * (b - a) * k + CELLS // 8:
                        found, least = _closer(found, least, strange[a:b], k, margin)
                i, j, _ = (np.concatenate(f) for f in zip(*found))
                if loose.size:
                    usual = ~np.isin(j, loose)
                    i, j = np.r_[i[usual], np.repeat(np.arange(b - a), loose.size)], np.r_[j[usual], np.tile(loose, b - a)]
                # Some queries at a time: what a task holds is bounded also where very many points are alike.
                some = np.argsort(i, kind="stable")
                i, j = i[some], j[some]
                for c in range(0, max(len(i), 1), CELLS):
                    u, w = i[c : c + CELLS], j[c : c + CELLS]
                    total = np.zeros(len(u))
                    for d in range(n):
                        total += x[w, d] * y[a + u, d]
                    score = total / (length[w] * asking[a + u])
                    chosen = best(a + u, score, ids[w], k)
                    kept.append((names[a + u][chosen], ids[w][chosen], score[chosen]))
    query, ident, score = (np.concatenate(c) for c in zip(*kept))
    return _rows(query, ident, score)


def _closer(found: list, least: np.ndarray, strange: np.ndarray, k: int, margin: np.float32) -> tuple[list, np.ndarray]:
    """Candidates (query, point, coarse score) that still can be among the k best, and what later ones must reach."""
    i, j, close = (np.concatenate(f) for f in zip(*found))
    at = np.lexsort((-close, i))
    i, j, close = i[at], j[at], close[at]
    first = np.searchsorted(i, np.arange(len(least)))
    last = first + k - 1
    full = np.flatnonzero((last < len(i)) & ~strange)
    full = full[i[last[full]] == full]
    least = least.copy()
    least[full] = np.maximum(least[full], close[last[full]] - margin)
    good = close >= least[i]
    return [(i[good], j[good], close[good])], least


def _all(points: pa.Table, queries: pa.Table, digits: int | None = None) -> pa.Table:
    """A score for each pair, its sum in order of the components; a few queries at a time, so that what is summed stays near."""
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    asked = _by_size(queries)
    with np.errstate(all="ignore"):
        for n, (ids, x, length) in _by_size(points).items():
            if n in asked:
                names, y, asking = asked[n]
                across = np.ascontiguousarray(x.T)
                step = max(1, NEAR // max(len(ids), 1))
                for u in range(0, len(names), step):
                    w = y[u : u + step]
                    total, one = np.zeros((len(w), len(ids))), np.empty((len(w), len(ids)))
                    for d in range(n):
                        total += np.multiply(across[d], w[:, d, None], out=one)
                    total /= length * asking[u : u + step, None]
                    score = total.ravel()
                    kept.append((np.repeat(names[u : u + step], len(ids)), np.tile(ids, len(w)), score if digits is None else rounded(score, digits)))
    return _rows(*(np.concatenate(c) for c in zip(*kept)))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x as Spark rounds it: half up in its shortest decimal form. What is near a half, or too large to tell, is rounded in decimals."""
    with np.errstate(all="ignore"):
        size = np.abs(x) * 10.0**digits
        whole = np.floor(size + 0.5)
        out = np.copysign(whole / 10.0**digits, x) + 0.0  # no negative zero
        unsure = np.flatnonzero((np.abs(size - np.floor(size) - 0.5) < 1e-4) | (size > 1e10))
    for i in unsure[np.isfinite(x[unsure])].tolist():
        d = Decimal(repr(float(x[i])))
        out[i] = float(d if d.as_tuple().exponent >= -digits else d.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, DECIMALS)) + 0.0
    out[~np.isfinite(x)] = x[~np.isfinite(x)]
    return out


def with_payload(hits: DataFrame, payload: DataFrame) -> DataFrame:
    """Late materialisation: payload (id, ...) joined to the few hits; hits without payload stay."""
    return hits.join(payload, "id", "left")


def replay(journal: DataFrame) -> DataFrame:
    """journal (seq, op, id, vector): the state after all entries; the last entry of an id decides."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return journal.withColumn("nth", last).where("nth = 1 AND op = 'add'").drop("nth")


def quantised(points: DataFrame, bits: int = 4) -> DataFrame:
    """points (id, vector) -> (id, low, step, codes): each component in the nearest of 2**bits even steps between its vector's extremes, a byte each."""
    if not 1 <= bits <= 7:
        raise ValueError("bits: 1 to 7")
    most = (1 << bits) - 1
    p = points.select("id", doubles("vector").alias("v")).where("size(v) > 0")
    bounds = lambda x: let(F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high")), lambda b: F.struct(b["low"].alias("low"), ((b["high"] - b["low"]) / most).alias("step")))
    code = lambda x, b: F.when(b["step"] > 0, F.floor((x - b["low"]) / b["step"] + 0.5)).otherwise(0).cast("tinyint")
    # Bounds are taken once for a vector: as columns of an earlier step Spark would take them again for each component.
    found = let(F.col("v"), lambda v: let(bounds(v), lambda b: F.struct(b["low"].alias("low"), b["step"].alias("step"), F.transform(v, lambda x: code(x, b)).alias("codes"))))
    return p.select("id", found.alias("q")).select("id", "q.low", "q.step", "q.codes")


def approximate(index: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The k (1 to 200) best of index, as quantised gives it, for each query by cosine to the restored vectors; the threshold comes after the top k."""
    restored = let(F.struct("low", "step", "codes"), lambda q: F.transform(q["codes"], lambda c: q["low"] + c * q["step"]))
    hits = nearest(cut(index.select("id", restored.alias("vector"))), queries, min(max(k, 1), 200))
    return hits if least is None else hits.where(F.col("score") >= least)


def writable(points: DataFrame) -> DataFrame:
    """Points that an index takes: with an id and a vector that is not empty; the others are skipped."""
    return points.where(F.col("id").isNotNull() & (F.size("vector") > 0))


def cached(texts: DataFrame, cache: DataFrame, now: float, ttl: float = 600.0) -> DataFrame:
    """texts (id, text) with key (SHA-256 of the trimmed text) and vector: the newest of cache (key, vector, stored_at) that is not older than ttl; null: to be embedded."""
    fresh = cache.where(F.lit(now) - F.col("stored_at") <= ttl).groupBy("key").agg(F.max_by("vector", "stored_at").alias("vector"))
    return texts.withColumn("key", F.sha2(trimmed("text"), 256)).join(fresh, "key", "left")
