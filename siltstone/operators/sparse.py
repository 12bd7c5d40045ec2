"""BM25 over a collection: postings, statistics and search of many queries at once.

score = sum over query terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * length / mean length)),
k1 = 1.5, b = 0.75; repeated query terms count once for each time. Everything is keyed by (collection, ...), so one plan serves one or many
collections. Queries are the small side: postings are cut down to their terms before anything is shuffled by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import tokens
from siltstone.operators.best import NEAR, NULL_ID, best
from siltstone.sources.tables import cut, spread

K1, B = 1.5, 0.75
#: Weights of query terms that tasks are handed, and scores (documents by queries) that a task holds at a time.
MOST_WEIGHTS, CELLS = 1_000_000, 1 << 19


def lengths(docs: DataFrame) -> DataFrame:
    """docs (collection, id, text) -> (collection, id, terms, length); texts without terms stay, with length 0."""
    return docs.select("collection", "id", tokens("text").alias("terms")).withColumn("length", F.size("terms").cast("long"))


def postings(sized: DataFrame) -> DataFrame:
    """(collection, id, length, term, tf)."""
    return sized.select("collection", "id", "length", F.explode("terms").alias("term")).groupBy("collection", "id", "length", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) -> (query_id, term, times)."""
    return queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def index(docs: DataFrame, terms: DataFrame | None = None, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of docs (collection, id, text), read and cut into words once. terms (term): the only ones whose postings are kept,
    broadcast if small. Every document also leaves one row without a term, from which the statistics come."""
    sized = lengths(spread(docs))
    counts = sized.select("collection", "id", "length", F.explode(F.array_append("terms", F.lit(None).cast("string"))).alias("term"))
    if terms is not None:
        kept = counts.join((F.broadcast(terms) if small else terms).withColumn("wanted", F.lit(True)), "term", "left").where("wanted OR term IS NULL").drop("wanted")
    else:
        kept = counts
    rows = cut(kept.groupBy("collection", "id", "length", "term").agg(F.count("*").alias("tf")))
    return rows.where("term IS NOT NULL"), rows.where("term IS NULL").groupBy("collection").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def search(docs: DataFrame, queries: DataFrame, k: int, most_query_terms: int = 100_000) -> DataFrame:
    """(query_id, collection, id, score, rank): the k best documents of each query in each collection, scores above 0."""
    wanted = query_terms(queries)
    small = wanted.limit(most_query_terms + 1).count() <= most_query_terms
    hint = F.broadcast if small else (lambda x: x)
    found, stats = index(docs, wanted.select("term").distinct(), small)
    return ranked(found, stats, hint(wanted), k)


def ranked(found: DataFrame, stats: DataFrame, wanted: DataFrame, k: int, most_weights: int = MOST_WEIGHTS) -> DataFrame:
    """Search over postings found (collection, id, length, term, tf) of all terms of wanted (query_id, term, times), with statistics (collection, n, mean).

    A document meets nearly all queries by their common words, so there are far more scored rows than postings. They are never built as rows: each task gets
    documents with their postings, scores some of them at a time against all queries and keeps the k best of each query. What a query's term weighs is
    counted, and handed to the tasks up to most_weights; beyond (and for ids that are no whole numbers) scored rows are joined and grouped."""
    df = found.groupBy("collection", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(stats, "collection").join(wanted, "term").select("collection", "term", "mean", "query_id", (F.col("times") * idf).alias("weight"))
    weights = cut(weights)
    whole = isinstance(found.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType))
    rank = F.row_number().over(Window.partitionBy("query_id", "collection").orderBy(F.round("score", 9).desc(), "id"))
    if whole and weights.count() <= most_weights:
        totals = _scanned(found, weights, k)
    else:
        part = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        totals = found.join(weights, ["collection", "term"]).groupBy("query_id", "collection", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return totals.withColumn("rank", rank).where(F.col("rank") <= k)


def _scanned(found: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(query_id, collection, id, score): of each part of the documents, what can be among the k best."""
    spark = found.sparkSession
    rows = weights.orderBy("collection", "term", "query_id").toArrow()  # as many as were counted
    asked = sorted({q for q in rows["query_id"].to_pylist() if q is not None})
    column = {q: i for i, q in enumerate(asked)}
    starts, terms, named = [], [], []
    for i, key in enumerate(zip(rows["collection"].to_pylist(), rows["term"].to_pylist())):
        if not terms or terms[-1] != key:
            starts.append(i)
            terms.append(key)
            if not named or named[-1][0] != key[0]:
                named.append((key[0], rows["mean"][i].as_py()))
    place = {c: i for i, (c, _) in enumerate(named)}
    plan = spark.sparkContext.broadcast(
        (np.array(starts + [len(rows)]), np.array([column[q] for q in rows["query_id"].to_pylist()], dtype=np.int64), rows["weight"].to_numpy(), np.array([m for _, m in named]), len(asked))
    )
    numbers = spark.createDataFrame([(c, t, i, place[c]) for i, (c, t) in enumerate(terms)], f"collection {found.schema['collection'].dataType.simpleString()}, term string, at int, place int")
    posts = found.join(F.broadcast(numbers), ["collection", "term"]).groupBy("place", "id", "length").agg(F.array_sort(F.collect_list(F.struct("at", F.col("tf").cast("long").alias("tf")))).alias("p"))
    posts = posts.select("place", F.col("id").cast("long").alias("id"), F.col("length").cast("long").alias("length"), F.col("p.at").alias("at"), F.col("p.tf").alias("tf"))

    def scan(batches):
        starts, columns, weight, mean, n = plan.value
        keep = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        least = np.full(len(mean) * n, 0.0)
        for batch in batches:
            ids = batch["id"].fill_null(NULL_ID).to_numpy()
            length, where = batch["length"].to_numpy(), batch["place"].to_numpy()
            ends = np.r_[0, np.cumsum(batch["at"].value_lengths().to_numpy())]
            at, tf = batch["at"].flatten().to_numpy(), batch["tf"].flatten().to_numpy()
            step = max(1, CELLS // max(n, 1))
            for a in range(0, len(ids), step):
                b = min(a + step, len(ids))
                doc = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                t, f = at[ends[a] : ends[b]], tf[ends[a] : ends[b]].astype(np.float64)
                under = f + K1 * (1 - B + B * length[a:b][doc] / mean[where[a:b]][doc])
                many = starts[t + 1] - starts[t]
                which = np.repeat(starts[t] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                cell = np.repeat(doc, many) * n + columns[which]
                total = np.bincount(cell, weight[which] * np.repeat(f, many) / np.repeat(under, many), (b - a) * n)
                slot = (where[a:b].astype(np.int64)[:, None] * n + np.arange(n)).ravel()
                good = np.flatnonzero((total > 0) & (total >= least[slot] - NEAR))
                keep = [np.r_[x, y] for x, y in zip(keep, (slot[good], total[good], np.repeat(ids[a:b], n)[good]))]
                chosen = best(*keep, k)
                keep = [x[chosen] for x in keep]
                # The k-th of each slot bounds what comes later; slots of fewer rows stay open.
                first = np.flatnonzero(np.r_[True, keep[0][1:] != keep[0][:-1]]) if len(keep[0]) else np.empty(0, int)
                full = first[np.diff(np.r_[first, len(keep[0])]) >= k]
                least[keep[0][full]] = keep[1][full + k - 1]
        ident = pa.array(keep[2], mask=keep[2] == NULL_ID)
        yield pa.RecordBatch.from_arrays([pa.array(keep[0]), ident, pa.array(keep[1])], names=["slot", "id", "score"])

    out = posts.mapInArrow(scan, "slot long, id long, score double")
    slots = spark.createDataFrame([(i, q) for q, i in column.items()], f"column long, query_id {weights.schema['query_id'].dataType.simpleString()}")
    names = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(named)], f"place long, collection {found.schema['collection'].dataType.simpleString()}")
    n = max(len(asked), 1)
    told = out.withColumns({"column": F.pmod("slot", F.lit(n)), "place": F.floor(F.col("slot") / n)})
    return told.join(F.broadcast(slots), "column").join(F.broadcast(names), "place").select("query_id", "collection", F.col("id").cast(found.schema["id"].dataType).alias("id"), "score")
