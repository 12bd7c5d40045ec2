"""A stored BM25 index: postings in folders by hash of their term, added to and taken from in segments, searched without reading a text again.

A segment holds the postings of the documents it adds (folders ``bucket=...``), an entry for each document that it adds or removes, and what it changes in the sums that scores need (documents and
words of each collection): added documents count up, the versions that they replace count down, so the statistics of any number of segments are a sum of a few rows.
A search reads the folders of its terms in all segments. A posting counts if no later segment has an entry of its document. Results
equal ``sparse.search`` over the documents as they are now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import sparse
from siltstone.sources.tables import spread
from siltstone.sources.versioned import Versioned

#: Folders of a segment's postings. A search names those of its terms, no more than there are.
BUCKETS = 256


class SparseStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.table = Versioned(spark, folder)
        self.spark = spark
        self.buckets = buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame) -> int:
        """docs (collection, id, text) in place of earlier versions of theirs; of rows that repeat (collection, id) the greatest text counts. Null ids are skipped."""
        docs = spread(docs.where("id IS NOT NULL").groupBy("collection", "id").agg(F.max("text").alias("text")))
        sized = self.table.read(self.table.write(sparse.lengths(docs), "terms"))
        posts = sparse.postings(sized).withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket", "term").sortWithinPartitions("bucket", "term")
        postings = self.table.write(posts, "postings", "bucket")
        return self._enter(sized.select("collection", "id", "length"), postings)

    def remove(self, keys: DataFrame) -> int:
        """Without the documents of keys (collection, id); unknown ones change nothing."""
        gone = keys.where("id IS NOT NULL").select("collection", "id").distinct().withColumn("length", F.lit(None).cast("long"))
        return self._enter(gone, None)

    def _enter(self, rows: DataFrame, postings: str | None) -> int:
        """rows (collection, id, length; null: removed) as the next entry."""
        entries = self.table.write(rows, "entries")
        rows = self.table.read(entries)

        def segments(now: dict, at: int) -> list[dict]:
            change = rows.where("length IS NOT NULL").select("collection", F.lit(1).alias("one"), "length")
            before = self.documents(now["version"])
            if before is not None:
                # The rows' own side is small; documents that it replaces or removes are looked up among all.
                same = F.col("b.id").eqNullSafe(F.col("r.id")) & F.col("b.collection").eqNullSafe(F.col("r.collection"))
                replaced = before.alias("b").join(rows.alias("r"), same, "left_semi")
                change = change.unionByName(replaced.select("collection", F.lit(-1).alias("one"), (-F.col("length")).alias("length")))
            sums = change.groupBy("collection").agg(F.sum("one").cast("long").alias("n"), F.sum("length").cast("long").alias("total"))
            new = [{"name": entries, "kind": "entries"}, {"name": self.table.write(sums, "sums"), "kind": "sums"}]
            return new + ([{"name": postings, "kind": "postings"}] if postings else [])

        return self.table.append(segments)

    def _latest(self, version: int | None) -> DataFrame | None:
        rows = self.table.tagged("entries", version)
        return None if rows is None else rows.groupBy("collection", "id").agg(F.max_by(F.struct("length", "_at"), "_at").alias("e")).select("collection", "id", "e.*")

    def documents(self, version: int | None = None) -> DataFrame | None:
        """(collection, id, length) of the documents that are there."""
        rows = self._latest(version)
        return None if rows is None else rows.where("length IS NOT NULL").drop("_at")

    def statistics(self, version: int | None = None) -> DataFrame:
        """(collection, n, mean): sums of the segments' sums."""
        rows = self.table.tagged("sums", version).groupBy("collection").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return rows.where("n > 0").select("collection", "n", (F.col("total").cast("double") / F.col("n")).alias("mean"))

    def postings(self, terms: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """(collection, id, length, term, tf) that count now; of the folders of terms (term) alone, if given."""
        manifest = self.table.manifest(version)
        where = None
        if terms is not None:
            named = sorted(r["bucket"] for r in terms.select(self._bucket(F.col("term")).alias("bucket")).distinct().collect())  # no more than there are folders
            where = F.col("bucket").isin(named)
        rows = self.table.tagged("postings", manifest["version"], where).drop("bucket")
        first = min((s["at"] for s in manifest["segments"] if s["kind"] == "entries"), default=0)
        later = self.table.tagged("entries", manifest["version"]).where(F.col("_at") > first).groupBy("collection", "id").agg(F.max("_at").alias("_last"))
        same = F.col("p.id").eqNullSafe(F.col("l.id")) & F.col("p.collection").eqNullSafe(F.col("l.collection")) & (F.col("l._last") > F.col("p._at"))
        return rows.alias("p").join(later.alias("l"), same, "left_anti").select("collection", "id", "length", "term", "tf")

    def search(self, queries: DataFrame, k: int, version: int | None = None) -> DataFrame:
        """(query_id, collection, id, score, rank) of the k best documents of each query (query_id, text) in each collection."""
        version = self.table.version() if version is None else version
        if not any(s["kind"] == "postings" for s in self.table.manifest(version)["segments"]):
            return self.spark.createDataFrame([], "query_id long, collection string, id long, score double, rank int")
        wanted = sparse.query_terms(queries)
        terms = wanted.select("term").distinct()
        found = self.postings(terms, version).join(terms, "term", "left_semi")
        return sparse.ranked(found, self.statistics(version), wanted, k)

    def compact(self) -> int:
        """One segment of what counts now. Stale if an entry comes meanwhile; the table stays as it is then."""
        now = self.table.manifest()
        if not any(s["kind"] == "postings" for s in now["segments"]):
            return now["version"]
        posts = self.postings(version=now["version"]).withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket", "term").sortWithinPartitions("bucket", "term")
        live = self._latest(now["version"]).where("length IS NOT NULL").select("collection", "id", "length")
        sums = live.groupBy("collection").agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("total"))
        at = now["notes"]["entries"] + 1
        new = [{"name": self.table.write(posts, "postings", "bucket"), "kind": "postings", "at": at}, {"name": self.table.write(live, "entries"), "kind": "entries", "at": at}, {"name": self.table.write(sums, "sums"), "kind": "sums", "at": at}]
        return self.table.commit(now["version"], new, now["notes"] | {"entries": at})
