"""Windows over event tables, as batch columns and as Structured Streaming queries that give the same rows.

Streams read Parquet folders, are bounded by a watermark, and end with ``availableNow``; sinks are idempotent (``foreachBatch``
upserts by key), so a restarted query does not write twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _seconds(ts: str = "ts"):
    return F.col(ts).cast("timestamp").cast("double")


def sliding_counts(events: DataFrame, seconds: int, locked_from: int) -> DataFrame:
    """Events of a user within the last seconds, and whether that locks the user out."""
    w = Window.partitionBy("user_id").orderBy(_seconds()).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count("*").over(w)).select("user_id", "event_id", "n", (F.col("n") >= locked_from).alias("locked"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """A gap of more than so many seconds starts a new session of the user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(_seconds() - F.lag(_seconds()).over(w) <= gap, 0).otherwise(1)
    rows = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    span = (F.max(_seconds()) - F.min(_seconds())).cast("long")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), span.alias("seconds"))


def tumbling(events: DataFrame, length: str) -> DataFrame:
    got = events.groupBy(F.window(F.col("ts").cast("timestamp"), length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with an event-time column."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(stream: DataFrame, length: str, late: str, out: str, checkpoint: str):
    """Closed windows are appended to out; what comes later than the watermark allows is dropped."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last by order, then by the other columns; pre-aggregated, so a hot key is no burden."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("w")).select(key, "w.*")


def stream_upsert(stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str):
    """Last write wins: the last rows of each batch go to a folder of out named by the batch. A batch writes no more than its own rows, and
    once repeated it replaces its own folder, so it changes nothing; ``latest`` gives the table."""
    def write(batch: DataFrame, number: int) -> None:
        _last(batch, key, order).write.mode("overwrite").parquet(f"{out}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, key: str, order: list[str]) -> DataFrame:
    """The table that the batches at out add up to, whichever of them are there."""
    return _last(spark.read.parquet(out).drop("v"), key, order)


def compact(spark: SparkSession, out: str, into: str, key: str, order: list[str]) -> None:
    """The table of out as the first batch of another folder, for a stream to go on with; out stays as it is."""
    latest(spark, out, key, order).write.mode("overwrite").parquet(f"{into}/v=-1")
