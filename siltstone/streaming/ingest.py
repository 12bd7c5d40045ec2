"""Incremental ingest: a stream of delivered files into a versioned table of chunks, that can be stopped anywhere and started again.

A delivery is a folder of files below the inbox; what comes after the delivery's name is a file's path, so a file that changed comes again in a later
delivery. Each micro-batch chunks the newest delivery of each of its files, numbers the chunks through the file, and writes two segments: the chunks, and a row for each
file. The batch exists from the moment its manifest does. A batch that is repeated, because its run ended between writing and committing, writes its segments anew; one that
had been committed is left alone. The newest batch of a file decides, so chunks of earlier deliveries are gone from the table at once, and a
file that has become blank, or is forgotten, has none. Files of no bytes at all are invisible to Spark's readers: deliver a blank line, or forget the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import title_case, trimmed
from siltstone.operators import chunking
from siltstone.operators import text as op
from siltstone.sources.tables import RECORD
from siltstone.sources.versioned import Stale, Versioned

#: What a file is called; a folder with such a name is one file in parts, as Spark writes it.
NAME = r"^(.*?\.(?:txt|md|jsonl))(?:/.*)?$"


def logical_path(physical: Column, inbox: str) -> tuple[Column, Column]:
    """(delivery, path) of a file's physical path: the first folder below the inbox, and the rest."""
    tail = "/".join(re.escape(x) for x in inbox.rstrip("/").split("/")[-2:] if x)
    below = F.regexp_extract(physical, rf"/{tail}/(.*)$", 1)
    return F.regexp_extract(below, r"^([^/]*)/", 1), F.regexp_extract(F.regexp_extract(below, r"^[^/]*/(.*)$", 1), NAME, 1)


def deliveries(spark: SparkSession, inbox: str, per_trigger: int = 1000) -> DataFrame:
    """The stream of an inbox: text files whole, JSONL corpora line by line."""
    def files(pattern: str, whole: bool) -> DataFrame:
        reader = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).option("wholetext", whole)
        return reader.load(inbox).select("value", *[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")])

    return files("*.{txt,md}", True).unionByName(files("*.{json,jsonl}", False))


def parts(batch: DataFrame, inbox: str) -> DataFrame:
    """(path, kind, part, text, title, prefix, delivery, size) of a batch of deliveries; of a file that came more than once the last delivery, by name. Records that are malformed or have no
    text are parts without text. Parts of a file are in the order of its physical files, their blocks and the lines of these."""
    delivery, path = logical_path(F.col("file_path"), inbox)
    rows = batch.withColumns({"delivery": delivery, "path": path, "part": F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("place"))})
    rows = rows.withColumn("kind", op.file_type(F.col("path"))).where("kind IN ('text', 'corpus_jsonl')")
    rows = rows.join(rows.groupBy("path").agg(F.max("delivery").alias("delivery")), ["path", "delivery"], "left_semi")
    is_record = F.col("kind") == "corpus_jsonl"
    record = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.withColumn("r", F.when(is_record, record))
    stem = title_case(F.replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))
    named = [F.when(trimmed(f"r.{c}") != "", F.col(f"r.{c}")) for c in ("citation", "title", "path")]
    prefix = F.when(is_record, op.chunk_prefix(F.col("r.chunk_prefix"), F.col("r.citation"), F.col("r.court"), F.col("r.year"), F.col("r.topics")))
    text = F.when(is_record, F.when(F.col("r._corrupt_record").isNull(), F.col("r.text"))).otherwise(F.col("value"))
    blank = F.lit("")
    return rows.select("path", "kind", "part", F.coalesce(text, blank).alias("text"), F.coalesce(*named, stem).alias("title"), F.coalesce(prefix, blank).alias("prefix"), "delivery", F.col("file_size").alias("size"))


class ChunkTable:
    """The chunks of all files ingested so far, and the state of each file."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = Versioned(spark, folder)
        self.spark = spark

    def ingest(self, rows: DataFrame, source: str, number: int, cut: Callable[[DataFrame], DataFrame] = chunking.chunks) -> bool:
        """rows (as parts gives them) as batch number of a source whose numbers rise; False if that batch has been committed."""
        if number <= self._last(source):
            return False
        name = f"{source}-{number:08d}"
        chunks = self.table.write(chunking.ingest(rows.select("path", "kind", "part", "text", "title", "prefix"), cut).drop("part"), f"chunks-{name}", bare=True)
        counts = self.table.read(chunks).groupBy("path").agg(F.count("*").alias("n_chunks"))
        files = rows.groupBy("path").agg(F.max("delivery").alias("delivery"), F.max("size").alias("size"), F.count("*").alias("n_parts"))
        files = files.join(counts, "path", "left").select("path", "delivery", "size", "n_parts", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))
        return self._commit(source, number, chunks, self.table.write(files, f"files-{name}", bare=True))

    def forget(self, paths: DataFrame, source: str = "forget", number: int | None = None) -> bool:
        """Without the chunks of these paths (path)."""
        number = self._last(source) + 1 if number is None else number
        if number <= self._last(source):
            return False
        zero = F.lit(0).cast("long")
        gone = paths.select("path", F.lit(None).cast("string").alias("delivery"), zero.alias("size"), zero.alias("n_parts"), zero.alias("n_chunks")).distinct()
        return self._commit(source, number, None, self.table.write(gone, f"files-{source}-{number:08d}", bare=True))

    def _last(self, source: str) -> int:
        return self.table.manifest()["notes"].get("batches", {}).get(source, -1)

    def _commit(self, source: str, number: int, chunks: str | None, files: str) -> bool:
        while True:
            now = self.table.manifest()
            batches, at = now["notes"].get("batches", {}), now["notes"].get("entries", 0) + 1
            if number <= batches.get(source, -1):
                return False
            new = [{"name": files, "kind": "files", "at": at}] + ([{"name": chunks, "kind": "chunks", "at": at}] if chunks else [])
            try:
                self.table.commit(now["version"], [*now["segments"], *new], {"entries": at, "batches": batches | {source: number}})
                return True
            except Stale:
                continue

    def files(self, version: int | None = None) -> DataFrame | None:
        """The state of each file: its last delivery, size, parts and chunks."""
        rows = self.table.tagged("files", version)
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in ("path", "_at")]
        return rows.groupBy("path").agg(F.max_by(F.struct(*rest, "_at"), "_at").alias("f")).select("path", *[F.col(f"f.{c}").alias(c) for c in (*rest, "_at")])

    def chunks(self, version: int | None = None) -> DataFrame | None:
        """path, chunk_idx, title, chunk, point_id of the newest batch of each file. Only the small rows of files are grouped."""
        rows = self.table.tagged("chunks", version)
        return None if rows is None else rows.join(self.files(version).select("path", "_at"), ["path", "_at"], "left_semi").drop("_at")

    def compact(self) -> int:
        """One segment of each kind, of what is current."""
        now = self.table.manifest()
        if not now["segments"]:
            return now["version"]
        files, rows = self.files(now["version"]), self.table.tagged("chunks", now["version"])
        new = [{"name": self.table.write(files, "files"), "kind": "files", "at": 0}]
        if rows is not None:
            new.append({"name": self.table.write(rows.join(files.select("path", "_at"), ["path", "_at"], "left_semi"), "chunks"), "kind": "chunks", "at": 0})
        return self.table.commit(now["version"], new, now["notes"])


def stream_ingest(spark: SparkSession, inbox: str, folder: str, checkpoint: str, cut: Callable[[DataFrame], DataFrame] = chunking.chunks, per_trigger: int = 1000):
    """The streaming query that ingests what the inbox holds and has not been ingested; its checkpoint and the table's manifests say what has."""
    table = ChunkTable(spark, folder)

    def take(batch: DataFrame, number: int) -> None:
        table.ingest(parts(batch, inbox), "stream", number, cut)

    return deliveries(spark, inbox, per_trigger).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
