"""Weighted reciprocal rank fusion, with slots reserved for hits of the sparse leg alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def fuse(legs: list[tuple[DataFrame, float]], limit: int, by: str = "query_id") -> DataFrame:
    """legs: (rows with by, id, rank from 1; weight). (by, id, fused, rank): weights of 0 or less leave a leg out; equal
    sums keep the order of first sight (leg, then rank)."""
    rows = None
    for number, (leg, weight) in enumerate(legs):
        if weight > 0:
            part = leg.select(by, "id", (F.lit(weight) / (K + F.col("rank"))).alias("share"), F.lit(number).alias("leg"), F.col("rank").alias("at"))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("every leg has a weight of 0")
    out = rows.groupBy(by, "id").agg(F.sum("share").alias("fused"), F.min(F.struct("leg", "at")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round("fused", 12).desc(), "seen.leg", "seen.at"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit).select(by, "id", "fused", "rank")


def reserve(fused: DataFrame, sparse_only: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """Both (by, id, rank). A quarter of the slots (one at least, no more than there are) is kept for sparse-only ids; all of
    them follow the main slots, and what is left is filled from the fused list."""
    kept = F.least(F.coalesce("n_only", F.lit(0)), F.lit(max(1, limit // 4)))
    counts = sparse_only.groupBy(by).agg(F.count("*").alias("n_only"))
    first = fused.join(counts, by, "left").select(by, "id", F.when(F.col("rank") <= limit - kept, 0).otherwise(2).alias("bucket"), F.col("rank").alias("at"))
    rows = first.unionByName(sparse_only.select(by, "id", F.lit(1).alias("bucket"), F.col("rank").alias("at")))
    best = rows.groupBy(by, "id").agg(F.min(F.struct("bucket", "at")).alias("place"))
    slot = F.row_number().over(Window.partitionBy(by).orderBy("place.bucket", "place.at"))
    return best.withColumn("slot", slot).where(F.col("slot") <= limit).select(by, "id", "slot")


def recency_boost(score: Column, epoch: Column, now: float, weight: float = 0.1) -> Column:
    """score plus up to weight for what changed within a year of now; epochs above 1e12 are milliseconds."""
    seconds = F.when(epoch > 1e12, epoch / 1000.0).otherwise(epoch)
    days = F.greatest(F.lit(0.0), (F.lit(now) - seconds) / 86400.0)
    return F.when(epoch.isNull(), score).otherwise(score + weight * F.greatest(F.lit(0.0), 1.0 - days / 365.0))


def rerank(hits: DataFrame, judged: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """hits (by, id, rank, ...) in the order of judged (by, id, verdict); without a verdict a hit keeps its order, behind."""
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.col("verdict").desc_nulls_last(), "rank"))
    return hits.join(judged, [by, "id"], "left").withColumn("reranked", order).where(F.col("reranked") <= k)
