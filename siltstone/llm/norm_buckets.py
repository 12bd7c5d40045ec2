"""Hard negatives by norm-bucketed search.

Vectors are integers, floor(256 * x) by component; a score is their inner product. Candidates are sorted by norm, greatest first, and every
``BUCKET`` rows of that order are a bucket, dealt to tasks in turn, so that each task meets all norms from the greatest down. By the Cauchy-Schwarz inequality no row of a bucket
scores more than (norm of the anchor) * (greatest norm of the bucket). A bucket is left out for every window (an anchor, or an anchor with one of its
positives) whose lower limit or whose running k-th score in the task is above that bound, and a task's norm-ordered rows end for all windows at once
when each of them has passed. What is left is multiplied as matrices. Vectors of one length are never pruned; then the search is
the product of the anchors with all rows, in blocks.

Anchors go to the tasks in blocks of at most ``ANCHORS`` (a bounded broadcast for each pass over the candidates, which stay where they are written);
only k rows for each window and task are shuffled.

Defined cases: rows whose label, vec_id or vector is null, or whose vector holds a null or non-finite component, take no part; shorter vectors count as if filled with zeros; of
rows that repeat a vec_id the least (vector, label) counts; ties go to the smaller vec_id; an anchor without another row of its label has no positives and gives no
rows, and so does a positive whose window holds no row (a negative score has an empty one); extra columns play no part. Scores are exact
whatever their size: where a double could round, products are taken in whole numbers; scores beyond a long rank by their value and are given as the least or greatest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch
from siltstone.llm.vafile import integers, usable

#: Rows of a bucket, anchors of a pass, anchors multiplied at once, and rows of a file of candidates.
BUCKET, ANCHORS, AT_ONCE, ROWS = 2048, 8192, 256, 1 << 18
#: Whole numbers up to here are exact in a double.
EXACT = float(1 << 53)
LONG = 1 << 63


def whole(v: np.ndarray) -> np.ndarray:
    """Doubles that hold multiples of 1 / 256 as Python integers 256 times as large."""
    return np.array([[int(Fraction(float(x)) * 256) for x in row] for row in v], object).reshape(v.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b (multiples of 1 / 256), times 256 * 256: doubles, or Python integers where doubles could round."""
    with np.errstate(over="ignore"):
        bound = np.abs(a).max(initial=0) * 256 * (np.abs(b).max(initial=0) * 256) * max(1, a.shape[1])
    if bound < EXACT:
        return (a * 256) @ (b * 256).T
    return whole(a) @ whole(b).T


def _exact(scores: np.ndarray) -> np.ndarray:
    """Scores as Python integers; infinite limits stay."""
    return scores if scores.dtype == object else np.array([int(x) if np.isfinite(x) else x for x in scores.tolist()], object)


class Best:
    """The running k best (score, vec_id) of each window, best first, and its k-th score."""

    def __init__(self, windows: int, k: int, low: np.ndarray) -> None:
        self.k = k
        self.bar = low.copy()  # what a score has to reach now
        self.window, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, low.dtype), np.zeros(0, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if object in (score.dtype, self.score.dtype):  # scores beyond what doubles tell apart have come up
            self.score, self.bar, score = _exact(self.score), _exact(self.bar), _exact(score)
        window, score, id_ = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, window)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (window[i], -score[i], id_[i])), np.int64)
        window, score, id_ = window[order], score[order], id_[order]
        nth = np.arange(len(window)) - np.searchsorted(window, window)
        self.window, self.score, self.id = window[nth < self.k], score[nth < self.k], id_[nth < self.k]
        full = nth == self.k - 1
        self.bar[window[full]] = np.maximum(self.bar[window[full]], score[full])


def scan(anchors: dict, k: int, same_label: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows (norm, label, vec_id, v) in falling order of norm. anchors: id, label and v of each anchor; anchor, low and high of each window, windows of an
    anchor together. Rows of the window's label (or of another label) within [low, high] compete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, of, low, high = anchors["v"], anchors["of"], anchors["low"], anchors["high"]
        length = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2**-40)
        best = Best(len(of), k, low)
        first = np.searchsorted(of, np.arange(len(a) + 1))
        for norm, label, ids, v in buckets(batches, a.shape[1]):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = np.nan_to_num(length * norm * 65536, nan=np.inf, posinf=np.inf)[of]
            alive = np.array(best.bar <= bound, bool)
            if not alive.any():
                break  # norms only fall
            meets = np.zeros(len(a), bool)
            meets[of[alive]] = True
            meets = np.flatnonzero(meets)
            if same_label:
                meets = meets[np.isin(anchors["label"][meets], label)]
            for x in range(0, len(meets), AT_ONCE):
                part = meets[x : x + AT_ONCE]
                score = products(a[part], v)
                fits = (anchors["label"][part][:, None] == label[None, :]) == same_label
                fits &= anchors["id"][part][:, None] != ids[None, :]
                for nth in range(int((first[part + 1] - first[part]).max(initial=0))):
                    has = np.flatnonzero(first[part + 1] - first[part] > nth)
                    w = first[part[has]] + nth
                    s, ok = score[has], fits[has]
                    ok = ok & np.array((s >= best.bar[w][:, None]) & (s <= high[w][:, None]), bool)
                    if s.dtype != object and s.shape[1] > k:  # only the k best of a row, and their ties, can stay
                        kth = np.partition(np.where(ok, s, -np.inf), -k, axis=1)[:, -k]
                        ok &= s >= kth[:, None]
                    i, j = np.nonzero(ok)
                    if len(i):
                        best.add(w[i], s[i, j], ids[j])
        for x in range(0, len(best.window), 8192):
            w, s = best.window[x : x + 8192], [int(v) for v in best.score[x : x + 8192]]
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(best.id[x : x + 8192]), pa.array([min(max(v, -LONG), LONG - 1) for v in s], pa.int64()), pa.array([ordered(v) for v in s], pa.string())], names=["w", "vec_id", "score", "key"])

    return run


def ordered(score: int) -> str:
    """Text that sorts as whole numbers do: sign, number of digits, digits; those of negative numbers complemented."""
    digits = f"{abs(score):x}"
    text = f"{len(digits):04x}{digits}"
    return "1" + text if score >= 0 else "0" + "".join("fedcba9876543210"[int(c, 16)] for c in text) + "~"


def number(key: str) -> int:
    """The number that ``ordered`` made the text of."""
    return int(key[5:], 16) if key[0] == "1" else -int("".join("fedcba9876543210"[int(c, 16)] for c in key[5:-1]), 16)


def buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(greatest norm, labels, ids, vectors) of up to BUCKET rows in the order they come in."""
    for batch in batches:
        norm, label, ids = (batch.column(i).to_numpy() for i in range(3))
        column = batch.column(3)
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        v = np.zeros((len(ids), width))
        row = np.repeat(np.arange(len(ids)), size)
        v[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
        for x in range(0, len(ids), BUCKET):
            yield norm[x], label[x : x + BUCKET], ids[x : x + BUCKET], v[x : x + BUCKET]


def by_norm(rows: DataFrame, n: int, work: Scratch) -> DataFrame:
    """n rows (label, vec_id, v) with their norm, written so that each file holds every m-th bucket of the order by norm, greatest first."""
    spark = rows.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    ordered_ = rows.withColumn("norm", F.sqrt(squares)).repartitionByRange(max(1, n // ROWS, spark.sparkContext.defaultParallelism), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS)
    # Rows of a range partition are numbered in order; BUCKET of them make a bucket. Ranges need no common numbering to be dealt evenly.
    dealt = ordered_.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), 11))
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions(F.desc("norm"), "vec_id")
    return work.table(dealt.select("norm", "label", "vec_id", "v"), "by_norm")


def search(candidates: DataFrame, asked: DataFrame, width: int, k: int, same_label: bool, work: Scratch) -> DataFrame:
    """asked: (block, w, vec_id, label, v, low, high), one row for each window; low and high null or keys of numbers. (w, vec_id, score, key, rank) of the k best candidates of each window."""
    found = []
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        windows = asked.where(F.col("block") == block).orderBy("vec_id", "w").collect()  # at most a block of anchors, with a few windows each
        ids, of, anchors = [], [], []
        for r in windows:
            if not ids or ids[-1] != r["vec_id"]:
                ids.append(r["vec_id"])
                anchors.append(r)
            of.append(len(ids) - 1)
        v = np.zeros((len(ids), width))
        for i, r in enumerate(anchors):
            v[i, : len(r["v"])] = r["v"]
        lows, highs = ([number(r[c]) if r[c] is not None else None for r in windows] for c in ("low", "high"))
        small = all(x is None or abs(x) < EXACT for x in lows + highs)
        limit = lambda xs, other: np.array([other if x is None else x for x in xs], np.float64 if small else object)
        given = {"v": v, "id": np.array(ids), "label": np.array([r["label"] for r in anchors]), "of": np.array(of), "low": limit(lows, -np.inf), "high": limit(highs, np.inf)}
        names = work.spark.createDataFrame(pa.table({"n": pa.array(range(len(windows)), pa.int64()), "w": pa.array([r["w"] for r in windows], pa.int64())}))
        hits = candidates.mapInArrow(scan(given, k, same_label), "n long, vec_id long, score long, key string")
        found.append(work.table(hits.join(F.broadcast(names), "n").drop("n"), "hits"))
    if not found:
        return work.spark.createDataFrame([], "w long, vec_id long, score long, key string, rank int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("key"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """vectors: (vec_id, label, embedding); anchors: which rows ask. For each anchor and each of its best rows of the same label, the best rows of other labels
    whose score is between low and high hundredths of the positive's: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    if not 0 < low <= high:
        raise ValueError("0 < low <= high")
    spark = vectors.sparkSession
    work = Scratch(spark, "norm-buckets")
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding")).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("least"), F.max("asks").alias("asks")).select("vec_id", "least.label", "least.v", "asks")
    rows = work.table(rows, "rows")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("asks")).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not shape["asks"]:
        return spark.createDataFrame([], empty)
    width, blocks = shape["width"], -(-shape["asks"] // ANCHORS)
    candidates = by_norm(rows.drop("asks"), shape["n"], work)
    none = F.lit(None).cast("string")
    asking = rows.where("asks").select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "label", "v")
    first = search(candidates, asking.select("block", F.col("vec_id").alias("w"), "vec_id", "label", "v", none.alias("low"), none.alias("high")), width, positives, True, work)
    first = work.table(first.select(F.col("w").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("key").alias("positive_key")), "positives")

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least and greatest score of each window: whole numbers at or within the hundredths."""
        for batch in batches:
            scores = [number(x) for x in batch.column(batch.schema.get_field_index("positive_key")).to_pylist()]
            new = [pa.array([ordered(-(-low * s // 100)) for s in scores], pa.string()), pa.array([ordered(high * s // 100) for s in scores], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + new, names=["anchor_id", "positive_id", "positive_score", "low", "high"])

    pairs = first.mapInArrow(limits, "anchor_id long, positive_id long, positive_score long, low string, high string")
    pairs = work.table(pairs.withColumn("w", F.monotonically_increasing_id()), "windows")
    asked = pairs.join(asking.withColumnRenamed("vec_id", "anchor_id"), "anchor_id").select("block", "w", F.col("anchor_id").alias("vec_id"), "label", "v", "low", "high")
    found = search(candidates, asked, width, negatives, False, work)
    out = pairs.join(found.select("w", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), "w")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
