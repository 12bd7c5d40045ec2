"""Exact top-k search by a vector-approximation file.

Vectors are integers, floor(256 * x) by component, held as doubles of 1/256 so that every finite x has its integer. The approximation of a vector is its
cell: each component's range is cut into ``2 ** BITS`` equal parts. The scan reads cells only, block of queries by block of rows, and gets bounds of every
score (inner product) from the cell's edges, widened by what rounding may take; rows whose upper bound is below the k-th best lower bound are out. Exact
vectors are then read in the order of their upper bounds, in two steps: first the best ``FIRST`` (k + 1, if that is more) of each query, then, all at
once, those whose bound still reaches the k-th exact score, after which the result is certain.

Equal integer vectors are one class and only the k + 1 smallest ids of a class can be in a result, so a vector with very
many copies costs no more than any other.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; shorter vectors
count as if filled with zeros; of rows that repeat a vec_id the least vector counts; ties go to the smaller vec_id; fewer than
k other rows give fewer results; no rows give none; extra columns play no part. Scores are exact whatever their size: those beyond a long rank by their value and
are given as the least or greatest long.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, as_bytes

BITS = 6
FIRST = 16
#: Rows and queries of a block of the scan.
ROWS, QUERIES = 8192, 1024


def usable(vector: Column) -> Column:
    """Not null, no component null or non-finite."""
    v = vector.cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector: Column) -> Column:
    """floor(256 * x) / 256 of each component; from 2 ** 44 on a double is a whole number of 1/256 already."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * 256).cast("double") / 256 + 0.0).otherwise(x))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    data, _ = as_bytes(column)
    return data.view(kind).reshape(len(column), width)


def cell_edges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, least, most) of each component: least[c] and most[c] bound the values in cell c."""
    parts = 1 << BITS
    with np.errstate(over="ignore"):
        step = np.maximum((high / parts - low / parts) * (1 + 2**-40), 1 / 256)
        edge = (low / parts + np.arange(parts + 1)[:, None] * (step / parts)) * parts  # the range itself may be beyond a double
        pad = step * 2**-20 + np.maximum(np.abs(low), np.abs(high)) * 2**-48
        # Whole numbers of 1/256 lie between the edges; beyond what doubles tell apart, the edges are widened.
        near = np.maximum(np.abs(low), np.abs(high)) < 1 << 24
        least = np.where(near, np.ceil(edge[:-1] * 256 - 0.001) / 256, edge[:-1] - pad)
        most = np.where(near, (np.ceil(edge[1:] * 256 + 0.001) - 1) / 256, edge[1:] + pad)
    return step, np.clip(least, low, high), np.clip(most, low, high)


def _key(score: int) -> str:
    """Text that sorts as scores do: those within a long by 16 hexadecimal digits, greater and smaller ones beside them."""
    if -(1 << 63) <= score < 1 << 63:
        return f"1{score + (1 << 63):016X}"
    digits = f"{abs(score):X}"
    digits = f"{len(digits):08X}{digits}"
    return "2" + digits if score > 0 else "0" + "".join("FEDCBA9876543210"[int(c, 16)] for c in digits) + "~"


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (q, ids, qv, cv) -> (q, ids, score, key): the exact inner product, held within a long, and the key that it sorts by."""
    n = pairs.select("q", "ids", "qv", "cv")
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), (x * 256).cast("long"))
    zero = F.lit(0).cast("long")
    term = lambda a, b: F.when(a.isNull() | b.isNull(), zero).otherwise(F.try_multiply(whole(a), whole(b)))
    n = n.withColumn("score", F.aggregate(F.zip_with("qv", "cv", term), zero, lambda s, x: F.try_add(s, x)))
    key = F.concat(F.lit("1"), F.lpad(F.hex(F.col("score").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    out = n.withColumn("key", key)

    def exact(batches):
        """Rows whose product does not fit."""
        for batch in batches:
            scores, keys = [], []
            for s, k, a, b in zip(*(batch.column(c).to_pylist() for c in ("score", "key", "qv", "cv")), strict=True):
                if s is None:
                    value = sum(int(Fraction(x) * 256) * int(Fraction(y) * 256) for x, y in zip(a, b, strict=False))
                    s, k = min(max(value, -(1 << 63)), (1 << 63) - 1), _key(value)
                scores.append(s)
                keys.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(scores, pa.int64()), pa.array(keys, pa.string())], names=["q", "ids", "score", "key"])

    huge = out.where(F.col("score").isNull()).mapInArrow(exact, "q long, ids array<long>, score long, key string")
    return out.where(F.col("score").isNotNull()).select("q", "ids", "score", "key").unionByName(huge)


def search(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """vectors: (vec_id, embedding); queries: which rows ask. (query_id, rank, vec_id, score) of each query's k best other rows."""
    spark = vectors.sparkSession
    work = Scratch(spark, "vafile")
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = work.table(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "rows")
    by_id = Window.partitionBy("v").orderBy("vec_id")
    some = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    classes = work.table(some.groupBy("v").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asking = work.table(rows.where("asks").select("v").distinct().join(classes, "v").select(F.col("class").alias("q"), F.col("v").alias("qv")), "asking")

    shape = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    asked = asking.count()
    width, empty = shape["width"], "query_id long, rank int, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], empty)
    # Two numbers for each component reach the driver.
    edges = classes.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low, high = np.zeros(width), np.zeros(width)  # 0 stands in for what shorter vectors lack
    for e in edges:
        low[e["d"]], high[e["d"]] = min(e["low"], 0), max(e["high"], 0)
    step, cell_least, cell_most = cell_edges(low, high)

    fill = lambda v: F.concat(v, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))

    def cells(batches):
        for batch in batches:
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, width)
            code = np.clip(np.floor(v / step - low / step), 0, (1 << BITS) - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in code], pa.binary())], names=["class", "cell"])

    def exact(batches):
        for batch in batches:
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["class", "cell"])

    parts, blocks = -(-shape["n"] // ROWS), -(-asked // QUERIES)
    file = classes.select("class", fill(F.col("v")).alias("v")).mapInArrow(cells, "class long, cell binary")
    file = work.table(file, "cells").withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    ask = asking.select(F.col("q").alias("class"), fill(F.col("qv")).alias("v")).mapInArrow(exact, "class long, cell binary")
    ask = work.table(ask, "ask").withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    most = k + 1

    def scan(asks: pa.Table, rows: pa.Table) -> pa.Table:
        """The rows of a block whose upper bound reaches the block's k-th best lower bound, for each query."""
        kept = []
        if asks.num_rows and rows.num_rows:
            q = _matrix(asks.column("cell"), width, np.float64)
            ids, a = rows.column("class").to_numpy(), _matrix(rows.column("cell"), width, np.uint8)
            least, most_ = cell_least[a, np.arange(width)], cell_most[a, np.arange(width)]
            size = np.maximum(np.abs(least), np.abs(most_)).T
            plus, minus = np.maximum(q, 0), np.minimum(q, 0)
            for x in range(0, len(q), 64):
                with np.errstate(over="ignore", invalid="ignore"):
                    slack = np.abs(q[x : x + 64]) @ size * ((width + 8) * 2**-52)  # what rounding may take from a sum
                    up = plus[x : x + 64] @ most_.T + minus[x : x + 64] @ least.T + slack
                    down = plus[x : x + 64] @ least.T + minus[x : x + 64] @ most_.T - slack
                up, down = np.where(np.isnan(up), np.inf, up), np.where(np.isnan(down), -np.inf, down)
                bar = np.partition(down, -most, axis=1)[:, -most] if down.shape[1] > most else np.full(len(up), -np.inf)
                i, j = np.nonzero(up >= bar[:, None])
                kept.append((asks.column("class").to_numpy()[x + i], ids[j], down[i, j], up[i, j]))
        cols = [np.concatenate(c) for c in zip(*kept, strict=True)] if kept else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table({"q": cols[0], "class": cols[1], "least": cols[2], "most": cols[3]})

    found = ask.groupBy("block", "part").cogroup(file.groupBy("block", "part")).applyInArrow(scan, "q long, class long, least double, most double")
    bar = F.element_at(F.sort_array(F.col("best"), asc=False), -1)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("least"), "class"))
    found = work.table(found, "scanned")
    bars = found.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("q").agg(F.collect_list("least").alias("best")).select("q", F.when(F.size("best") == most, bar).otherwise(F.lit(float("-inf"))).alias("bar"))
    left = found.join(bars, "q").where("most >= bar")
    left = work.table(left.select("q", "class", "most"), "candidates")

    def read(candidates: DataFrame) -> DataFrame:
        return scored(candidates.join(asking, "q").join(classes.withColumnRenamed("v", "cv"), "class"))

    # A query with fewer than most candidates has none after the first. Filters on row numbers cut each task's rows before they are shuffled.
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("most"), "class"))
    first = work.table(left.withColumn("at", order).where(F.col("at") <= max(FIRST, most)).select("q", "class"), "first")
    early = work.table(read(first), "early")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("key")))
    certain = early.withColumn("nth", nth).where(F.col("nth") == most).select("q", F.col("score").alias("kth"))
    # A double bound that reaches the k-th score, or is nearer to it than doubles tell apart.
    reaches = F.col("most") * 65536 >= F.col("kth").cast("double") * (1 - F.signum(F.col("kth").cast("double")) * 2.0**-50)
    late = left.join(first, ["q", "class"], "left_anti").join(certain, "q").where(reaches).drop("kth")
    found = early.unionByName(read(late)).select("q", "score", "key", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("key"), "vec_id"))
    top = found.withColumn("nth", best).where(F.col("nth") <= most).drop("nth")
    ids = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(classes.select("v", F.col("class").alias("q")), "v").select("query_id", "q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    out = ids.join(top, "q").where(F.col("query_id") != F.col("vec_id")).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
