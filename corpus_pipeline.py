"""A corpus from documents: toxic ones go, one of each group of near copies stays, personal data becomes surrogates,
sources are interleaved to equal weights, and texts become token ids (with the text they decode to) and their place in the mix.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again for the next. All but the
last return the columns of documents. Rows with a null doc_id pass every stage; a stage of an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import bpe, minhash, mixing, pii, toxicity
from siltstone.llm.common import Scratch, table, unused
from siltstone.llm.queries import pii_key, tokenizer_path


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of sf_dir, does not call toxic."""
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text."""
    out = pii.pseudonymize(docs, pii_key(spark), spans=unused(docs, "pii"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files, by name, and rows follow the schedule."""
    return mixing.mix(docs).orderBy("mix_place").select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """docs, read from files, with place: the number of the row in the order of file names and of rows within a file.
    A scan may return rows in any order, so the place comes from where a row stands, not from when it is read."""
    at = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = at.groupBy("_file").agg(F.count("*").alias("_rows"))  # a row for each file
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long")  # beyond 99,999 the names are longer
    before = F.coalesce(F.sum("_rows").over(Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("_file").alias("_of"), before.alias("_before"))
    return at.join(F.broadcast(files), F.col("_file") == F.col("_of")).select(*docs.columns, (F.col("_before") + F.col("_row")).alias("place"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """place (from 0, in the order of the files of docs), doc_id, source, n_tokens, ids (little-endian 32-bit) and the text that they decode to."""
    out = bpe.encode(placed(docs).select("place", "doc_id", "source", "text"), tokenizer_path(), decoded="decoded")
    return out.select("place", "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", keep_clean), ("near_dedup", keep_one), ("pii", hide_private), ("mixing", interleave), ("bpe", tokenize)]

#: Classifier, surrogates and BPE have no SQL form: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
