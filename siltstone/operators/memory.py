"""Graph memory that grows: schemas, facts and passages keep their numbers from build to build.

A build merges mentions into what is stored. A key that is known keeps its number; new ones get the next numbers, without gaps, in the order of their first mention, told by sorted
ranges and their sizes. Each build writes only what is new: keys with numbers, counts, and links of facts and passages, all under one manifest, so readers see a build as a whole or not at all;
of two builds at once the second is worked out again on top of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ordered import numbered
from siltstone.sources.tables import cut
from siltstone.sources.versioned import Stale, Versioned

LAYERS = ("schema", "fact", "passage")


class GraphMemory:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = Versioned(spark, folder)
        self.spark = spark

    def keys(self, layer: str, version: int | None = None) -> DataFrame | None:
        """(idx, key) of a layer, facts with schema_idx, the schema of their first mention."""
        rows = self.table.tagged(f"{layer}-keys", version)
        return None if rows is None else rows.drop("_at")

    def merge(self, mentions: DataFrame) -> int:
        """mentions (seq, schema, fact, passage), seq unique among them. Rows with a null key are left out."""
        rows = cut(mentions.select("seq", *LAYERS).where(" AND ".join(f"{c} IS NOT NULL" for c in LAYERS)))
        while True:
            now = self.table.manifest()
            try:
                return self._build(rows, now)
            except Stale:
                continue

    def _new(self, rows: DataFrame, layer: str, version: int, first: int, *also: Column) -> DataFrame:
        """Keys that are not known, numbered from first on in the order of their first mention."""
        found = rows.groupBy(F.col(layer).alias("key")).agg(F.min("seq").alias("first"), *also)
        known = self.keys(layer, version) if version else None
        new = cut(found if known is None else found.join(known.select("key"), "key", "left_anti"))
        out = numbered(new, [], [F.col("first").asc()]).withColumn("idx", F.col("nth") - 1 + first)
        return out.drop("nth", "first")

    def _build(self, rows: DataFrame, now: dict) -> int:
        version, following = now["version"], now["notes"].get("next", {})
        at, names, counts = now["notes"].get("entries", 0) + 1, [], {}

        def keep(df: DataFrame, kind: str) -> DataFrame:
            name = self.table.write(df, kind)
            names.append({"name": name, "kind": kind, "at": at})
            return self.table.read(name)

        every = {}
        for layer in LAYERS:
            first = following.get(layer, 0)
            also = [F.min_by("schema", "seq").alias("schema")] if layer == "fact" else []
            new = self._new(rows, layer, version, first, *also)
            if layer == "fact":
                new = new.join(every["schema"].select(F.col("key").alias("schema"), F.col("idx").alias("schema_idx")), "schema").select("idx", "key", "schema_idx")
            else:
                new = new.select("idx", "key")
            new = keep(new, f"{layer}-keys")
            counts[layer] = first + new.count()
            known = self.keys(layer, version) if version else None
            every[layer] = new if known is None else known.unionByName(new)
        number = lambda layer: every[layer].select(F.col("key").alias(layer), F.col("idx").alias(f"{layer}_idx"))
        keep(rows.groupBy("schema").agg(F.count("*").alias("n")).join(number("schema"), "schema").select("schema_idx", "n"), "schema-counts")
        keep(rows.groupBy("fact").agg(F.count("*").alias("n")).join(number("fact"), "fact").select("fact_idx", "n"), "fact-counts")
        links = rows.select("fact", "passage").distinct().join(number("fact"), "fact").join(number("passage"), "passage").select("fact_idx", "passage_idx")
        known = self.table.tagged("links", version) if version else None
        keep(links if known is None else links.join(known, ["fact_idx", "passage_idx"], "left_anti"), "links")
        return self.table.commit(version, [*now["segments"], *names], now["notes"] | {"entries": at, "next": counts})

    def _counts(self, kind: str, by: str, version: int | None) -> DataFrame:
        return self.table.tagged(kind, version).groupBy(by).agg(F.sum("n").alias("n"))

    def schemas(self, version: int | None = None) -> DataFrame:
        """(idx, key, frequency)."""
        return self.keys("schema", version).join(self._counts("schema-counts", "schema_idx", version), F.col("idx") == F.col("schema_idx")).select("idx", "key", F.col("n").alias("frequency"))

    def facts(self, version: int | None = None) -> DataFrame:
        """(idx, key, schema_idx, mentions, passages)."""
        linked = self.links(version).groupBy("fact_idx").agg(F.count("*").alias("passages"))
        rows = self.keys("fact", version).join(self._counts("fact-counts", "fact_idx", version), F.col("idx") == F.col("fact_idx")).drop("fact_idx")
        return rows.join(linked, F.col("idx") == F.col("fact_idx")).select("idx", "key", "schema_idx", F.col("n").alias("mentions"), "passages")

    def links(self, version: int | None = None) -> DataFrame:
        """(fact_idx, passage_idx), each once."""
        return self.table.tagged("links", version).drop("_at")
