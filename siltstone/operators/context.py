"""From hits to a prompt: duplicates, budget, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import split_words
from siltstone.operators.containment import contained, marked, marks
from siltstone.operators.containment import drop_contained as drop_contained
from siltstone.operators.text import CONSTRAINT
from siltstone.sources.tables import cut, spread

#: What stands between texts and before them (fixed values).
SEPARATOR = "\n\n---\n\n"
PREFIX = "The following context was retrieved from the local knowledge base. Use it to inform your response where relevant. Do not mention the knowledge base unless the user asks.\n\n"


def text_key(text: Column) -> Column:
    """SHA-256 of the text with single spaces."""
    return F.sha2(F.array_join(split_words(text), " "), 256)


def _nth(hits: DataFrame, by: list[str], length: Column, key: Column) -> DataFrame:
    """hits (by, id, ...) with _nth: their number, from 1, among those of their key: the longest first, then the smallest id."""
    best = F.row_number().over(Window.partitionBy(*by, "_key").orderBy(length.desc(), "id"))
    return hits.withColumn("_key", key).withColumn("_nth", best)


def dedupe(hits: DataFrame, by: list[str]) -> DataFrame:
    """The longest of each group of equal texts (up to white space), then the smallest id."""
    return _nth(hits, by, F.length("text"), text_key(F.col("text"))).where("_nth = 1").drop("_key", "_nth")


def dedupe_contained(hits: DataFrame, by: list[str]) -> DataFrame:
    """drop_contained of dedupe of hits (by, id, text), whose texts are written once: what is shuffled for dedupe are keys, lengths and ids."""
    rows = cut(hits.withColumn("_row", F.monotonically_increasing_id()))
    keyed = rows.select(*by, "id", "_row", F.length("text").alias("_n"), F.unhex(text_key(F.col("text"))).alias("_text"))
    again = cut(marks(_nth(keyed, by, F.col("_n"), F.col("_text")).where("_nth > 1").select("_row")))
    gone = contained(marked(spread(rows), again, False), by)
    return marked(rows, again, False).join(gone, "_row", "left_anti").select(*hits.columns)


def fit(hits: Column, budget: Column, separator: int = 8) -> Column:
    """hits: array of struct(text, id, ...), best first. The greedy choice within budget characters: whole texts; else their
    constraint lines; else what is left of the budget. Array of struct(id, text)."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.array().cast("array<struct<id:bigint,text:string>>").alias("kept"))

    def step(s: Column, h: Column) -> Column:
        left = budget - s["used"]
        chosen = F.filter(F.split(h["text"], "\n"), lambda x: x.rlike(CONSTRAINT))
        short = F.when((F.length(h["text"]) > left) & (F.size(chosen) > 0), F.array_join(chosen, "\n")).otherwise(h["text"])
        piece = F.when(F.length(short) > left, F.substring(short, F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).otherwise(short)
        blank = F.regexp_replace(piece, r"\s+", "") == ""
        over = F.length(piece) > left
        return (
            F.when(s["full"] | blank, s)
            .when(over, F.struct(s["used"].alias("used"), F.lit(True).alias("full"), s["kept"].alias("kept")))
            .otherwise(
                F.struct(
                    (s["used"] + F.length(piece) + separator).cast("long").alias("used"), F.lit(False).alias("full"),
                    F.array_append(s["kept"], F.struct(h["id"].cast("long").alias("id"), piece.alias("text"))).alias("kept"),
                )
            )
        )

    return F.when(budget <= 0, F.array().cast("array<struct<id:bigint,text:string>>")).otherwise(F.aggregate(hits, start, step, lambda s: s["kept"]))


def inject_budget(context_tokens: Column, existing: Column, reserve: int = 512, ratio: float = 0.25, fallback: int = 8000) -> Column:
    """Characters that may be injected beside a conversation."""
    whole = F.when(context_tokens.isNull(), F.lit(fallback)).otherwise((context_tokens * ratio).cast("int") * 4)
    return F.greatest(F.lit(0), whole - existing - reserve * 4).cast("long")


def assemble(rows: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """One context for each group: its texts in order, between separators, after the prefix."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.concat(F.lit(PREFIX), F.array_join(F.transform(ordered, lambda x: x["t"]), SEPARATOR)).alias("context"))
