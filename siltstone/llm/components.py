"""Connected components of a link table by alternating large-star and small-star steps, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """links: (u, v), any order, any repeats. Returns a scratch table (id, component) of every linked id: the smallest id
    reachable. Hot ids only ever sit on the side of a join that Spark can split; each round is written, so lineage stays short."""
    links = links.where(F.col("u") != F.col("v"))
    edges = work.table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every greater neighbour of u is linked to the smallest of u and its neighbours.
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: every smaller neighbour of u, and u itself, is linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = work.table(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        work.drop(edges)
        edges = after
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if seen == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = state
