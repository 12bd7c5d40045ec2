"""Cutting texts by strategy, and the whole way from a file's text to chunk rows, as column expressions.

Words (white-space tokens) are counted. ``token`` cuts windows of words; ``sentence`` packs whole sentences; ``recursive`` packs paragraphs, and the
lines, sentences or windows of what is too long, then gives each chunk the last words of the one before. ``semantic`` packs sentences too, but not across valleys of the similarity of neighbours;
sentence vectors are an input column, and without them, or with another number of them than sentences, it goes on to ``sentence``, as with a missing model. ``code`` packs top-level blocks, told by indentation and
brackets; blocks that are too long are cut at blank lines, lines, and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import let, split_words, trimmed
from siltstone.operators import text as op

SIZE, OVERLAP, LEAST = 512, 64, 64
_SENTENCE = r"(?<=[.!?。！？])\s+"


def _full(pieces: Column) -> Column:
    return F.filter(pieces, lambda x: trimmed(x) != "")


def word_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of words, one every size - overlap words."""

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap if size > overlap else size))
        return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    return let(split_words(text), windows)  # one list for all windows: in the lambda, the expression would be evaluated for each


def _split(pieces: Column, size: int, *ways: Callable[[Column], Column]) -> Column:
    """Pieces of at most size words: longer ones are cut by the first way, their parts by the next, at last into windows."""
    if not ways:
        return F.flatten(F.transform(pieces, lambda x: F.when(F.size(split_words(x)) > size, word_windows(x, size)).otherwise(F.array(x))))
    return F.flatten(F.transform(pieces, lambda x: F.when(F.size(split_words(x)) > size, _split(_full(ways[0](x)), size, *ways[1:])).otherwise(F.array(x))))


def pack(pieces: Column, size: int, glue: str) -> Column:
    """Neighbours joined as long as both fit into size words; no piece is longer. The fold holds one chunk and appends it once."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def joined(s: Column, x: Column, n: Column) -> Column:
        return (
            F.when(s["held"] == "", F.struct(s["out"].alias("out"), x.alias("held"), n.alias("n")))
            .when(s["n"] + n <= size, F.struct(s["out"].alias("out"), F.concat(s["held"], F.lit(glue), x).alias("held"), (s["n"] + n).alias("n")))
            .otherwise(F.struct(F.array_append(s["out"], s["held"]).alias("out"), x.alias("held"), n.alias("n")))
        )

    def step(s: Column, x: Column) -> Column:
        return let(F.size(split_words(x)), lambda n: joined(s, x, n))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.array_append(s["out"], s["held"])))


def sentences(text: Column, size: int) -> Column:
    return pack(_split(_full(F.split(text, _SENTENCE)), size), size, " ")


def recursive(text: Column, size: int, overlap: int) -> Column:
    parts = _split(_full(F.split(text, r"\n\s*\n")), size, lambda x: F.split(x, "\n"), lambda x: F.split(x, _SENTENCE))
    chunks = pack(F.transform(parts, trimmed), size, "\n\n")
    if not overlap:
        return chunks
    # Each chunk after the first begins with the last words of the one before.
    tail = lambda x: let(split_words(x), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - overlap + 1, F.lit(1)), F.lit(overlap)), " "))
    return let(chunks, lambda c: F.transform(c, lambda x, i: F.when(i > 0, F.concat(tail(F.get(c, i - 1)), F.lit("\n\n"), x)).otherwise(x)))


def sentence_list(text: Column) -> Column:
    """The sentences that ``semantic`` wants a vector of each of, in order."""
    return _full(F.split(text, _SENTENCE))


def similarities(vectors: Column) -> Column:
    """Cosines of neighbours, one fewer than vectors; null where a vector is null, zero or of another length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda a, b: F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(vectors) > 1, F.transform(F.sequence(F.lit(1), F.size(vectors) - 1), lambda i: cosine(F.get(vectors, i - 1), F.get(vectors, i)))).otherwise(F.array().cast("array<double>"))


def valleys(alike: Column, depth: float = 1.0) -> Column:
    """alike: similarities of neighbours. The numbers (from 1) of those that are no higher than the ones beside them and more than depth standard deviations below the mean (told to 9 digits):
    a segment starts there."""
    none = F.array().cast("array<int>")

    def found(a: Column) -> Column:
        known = F.filter(a, lambda x: x.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
        least = let(mean, lambda m: F.round(m - depth * F.sqrt(F.aggregate(known, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(known)), 9))
        side = lambda i: F.coalesce(F.get(a, i), F.lit(2.0))
        low = lambda i, m: (F.round(F.get(a, i - 1), 9) < m) & (side(i - 2) >= F.get(a, i - 1)) & (side(i) >= F.get(a, i - 1))
        return F.when(F.size(known) > 0, let(least, lambda m: F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.coalesce(low(i, m), F.lit(False))))).otherwise(none)

    return let(alike, found)


def segments(sentences_: Column, starts: Column) -> Column:
    """sentences in runs that begin at 0 and at starts."""
    none = F.array(F.lit(0))
    runs = lambda told, s: F.zip_with(F.concat(none, s), F.concat(s, F.array(F.size(told))), lambda a, b: F.slice(told, a + 1, b - a))
    return let(sentences_, lambda told: let(starts, lambda s: runs(told, s)))


def semantic(sentences_: Column, vectors: Column, size: int) -> Column:
    """Chunks of at most size words that do not reach across valleys."""
    cut = segments(sentences_, valleys(similarities(vectors)))
    return F.flatten(F.transform(cut, lambda part: pack(_split(part, size), size, " ")))


#: What goes on with a block although it is not indented, and what belongs to the block behind it.
_GOES_ON = re.compile(r"[)\]}]|(?:else|elif|except|finally|catch|end)\b|[`]{3}\s*$")
_LEADS = re.compile(r"@|#|//|/\*|\*|--")
_QUOTED = re.compile(r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|(?:#|//).*""")


def top_level(text: str) -> list[str]:
    """The blocks of a program: each begins at a line that is not indented, outside brackets (those of strings and comments do not count), unless it goes on with the block before or
    stands behind lines that lead to it (comments, decorators)."""
    out: list[list[str]] = []
    depth, leads = 0, False
    for line in text.split("\n"):
        blank = not line.strip()
        if not out or not (blank or line[0] in " \t" or depth > 0 or leads or _GOES_ON.match(line)):
            out.append([])
        out[-1].append(line)
        if not blank:
            leads = line[0] not in " \t" and bool(_LEADS.match(line)) and depth <= 0
            bare = _QUOTED.sub("", line)
            depth = max(0, depth + sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}")))
    return [b for lines in out if (b := "\n".join(lines).strip("\n")).strip()]


def code_blocks(text: Column) -> Column:
    """The top-level blocks of each text; null of null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: top_level(t) if t is not None else None)

    return F.pandas_udf(run, "array<string>")(text)


def code(blocks: Column, size: int) -> Column:
    """Chunks of at most size words of whole blocks (as code_blocks gives them); longer ones at blank lines, lines, and windows."""
    return pack(_split(blocks, size, lambda x: F.split(x, r"\n\s*\n"), lambda x: F.split(x, "\n")), size, "\n\n")


def chunks(df: DataFrame, kind: str = "kind", path: str = "path", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, vectors: str | None = None) -> DataFrame:
    """df with strategy (as chosen) and chunks (array): each strategy, or the next of its chain that gives any chunk; small neighbours are merged. vectors: the column of
    sentence vectors, if there is one. The text is trimmed and its strategy decided once, in projections of their own; only the chosen branch is evaluated. Code alone goes through Python, text by text."""
    rows = df.withColumn("_text", trimmed(text)).withColumn("strategy", op.chunk_strategy(F.col(kind), F.col(path), F.col("_text"), trim=False))
    t, s = F.col("_text"), F.col("strategy")
    empty = F.array().cast("array<string>")
    cleaned = op.drop_boilerplate(t)
    rows = rows.withColumn("_blocks", code_blocks(F.when(s == "code", t)))
    told = F.col(vectors) if vectors else F.lit(None).cast("array<array<double>>")
    cut = (
        F.when(t == "", empty)
        .when((s == "semantic") & (F.size(told) == F.size(sentence_list(t))), semantic(sentence_list(t), told, size))
        .when(s == "code", code(F.col("_blocks"), size))
        .when(s == "token", F.when(cleaned == "", recursive(t, size, overlap)).otherwise(word_windows(cleaned, size, overlap)))
        .when(s.isin("sentence", "semantic"), sentences(t, size))
        .otherwise(recursive(t, size, overlap))
    )
    return rows.withColumn("_cut", cut).withColumn("chunks", op.merge_small(F.col("_cut"), least, size)).drop("_text", "_cut", "_blocks")


def ingest(files: DataFrame, cut: Callable[[DataFrame], DataFrame] = chunks) -> DataFrame:
    """files (path, kind, part, text, title, prefix): one row for each chunk (path, part, chunk_idx, title, chunk, point_id). cut gives rows their chunks (array).

    Parts are pages of a pdf, articles of an archive or records of a corpus. A page that is not blank begins with the last paragraph of the page before
    that is not blank; chunks of a record begin with its prefix; chunk numbers run through the file."""
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.where(trimmed("text") != "")
    carry = F.when(F.col("kind") == "pdf", F.last(F.when(F.col("kind") == "pdf", op.last_paragraph("text")), ignorenulls=True).over(before))
    rows = cut(rows.withColumn("text", F.concat_ws("\n\n", carry, F.col("text"))))
    # Before an inner explode, Spark filters rows by the size of their chunks, and computes all chunks once more for that.
    pieces = rows.select("path", "part", "title", "prefix", F.posexplode_outer("chunks").alias("at", "piece")).where("piece IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("path").orderBy("part", "at")) - 1
    chunk = F.when(F.col("prefix") != "", F.concat("prefix", F.lit("\n\n"), "piece")).otherwise(F.col("piece"))
    out = pieces.select("path", "part", "title", number.cast("long").alias("chunk_idx"), chunk.alias("chunk"))
    return out.withColumn("point_id", op.point_id(F.col("path"), F.col("chunk_idx"), F.col("chunk")))
