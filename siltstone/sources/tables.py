"""Readers: tables of a directory, JSONL corpora, whole text files and key-value files; one writer routed by type."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import title_case, trimmed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its files give fewer: for work that costs more than moving the rows. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share; a temporary folder only for local masters."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cuts_folder(spark: SparkSession) -> str:
    """Where this application's lineage cuts lie."""
    return f"{shared_folder(spark)}/siltstone/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete this application's lineage cuts: to be called once the results that came through them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cuts_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written as Parquet below the shared folder, without the plan behind it: later steps read the columns that they need, and joins know its size."""
    path = f"{cuts_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in cuts:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str, **frames: DataFrame) -> DataFrame:
    """SQL over tables named in braces."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names}, **frames)


#: Columns of a corpus record.
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "citation", "court", "title", "path", "source_url", "text", "chunk_prefix")]
    + [T.StructField("year", T.IntegerType()), T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("_corrupt_record", T.StringType())]
)


def corpus_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL corpus; blank, malformed and textless lines are skipped."""
    rows = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (trimmed("text") != "")).drop("_corrupt_record")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text) of whole files; the title is the stem in words."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select("path", title_case(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"), "text")


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of every file below path whose type can be ingested, in order of path."""
    from siltstone.operators.text import file_type

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(file_type(F.col("path")) != "unknown").distinct().orderBy("path")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=VALUE lines; comments are skipped and the last of equal keys wins."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = rows.select(F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1).alias("key"), F.regexp_extract("value", r"=\s*(.*?)\s*$", 1).alias("v"), "line")
    return parts.where("key <> ''").groupBy("key").agg(F.max_by("v", "line").alias("value"))


def append_records(records: DataFrame, path: str) -> None:
    """JSON records, one folder for each record_type."""
    records.write.mode("append").partitionBy("record_type").json(path)


def save_tables(folder: str, **frames: DataFrame) -> None:
    """Each frame in place of the table of its name below folder; none may be read from there."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
