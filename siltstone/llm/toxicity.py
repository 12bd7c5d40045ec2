"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A document's features are the n-grams of its distinct lower-case words (runs of letters, padded by a space on either
side), each counted once per distinct word that holds it and hashed to ``2**BITS`` slots. A feature g is scaled by
r_g = log of its smoothed document count among toxic against clean documents; the ratio counts as 0 where the two counts
are within ``LEAST_SD`` standard deviations of what chance gives.
Logistic regression with an L2 penalty then learns the weights of the scaled features. As the model is linear and
features are per word, a document's score is a sum over its distinct words, which workers look up in a bounded memo.

The fit takes a bounded sample of labelled rows (``FIT_TOXIC`` and ``FIT_CLEAN`` rows, by hash of doc_id). Where a row is read, its
text becomes counts of slots, at most ``2**BITS`` of them however long it is; one task gets these counts, never texts, and fits.
Scoring covers every whole text, in one pass without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias alone; rows with null labels are not
used to fit; without labelled rows of both classes every score is the share of toxic ones (0 without any). Repeated
labels and repeated rows of one document count once, labels that differ each. Other columns pass through; columns named like new ones go.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import thrifty

BITS = 18
SIZES = (3, 4, 5)
FIT_TOXIC, FIT_CLEAN = 2_500, 6_000
LEAST_SD = 5.0
SMOOTH = 10.0
PENALTY = 1e-3
STEPS = 300
#: Words that a worker remembers, and the longest of them.
MEMO, LONGEST = 500_000, 64

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def grams(word: str) -> list[int]:
    """Hashed n-grams of a word; each once."""
    padded = f" {word} "
    return [*{zlib.crc32(padded[i : i + n].encode()) & ((1 << BITS) - 1) for n in SIZES for i in range(len(padded) - n + 1)}]


Counts = tuple[np.ndarray, np.ndarray]


def features(texts: Iterable[str | None]) -> Iterator[Counts]:
    """Of each text its slots, ascending, and in how many distinct words each occurs."""
    memo: dict[str, np.ndarray] = {}
    for text in texts:
        found = []
        for w in words(text or ""):
            if (g := memo.get(w)) is None:
                g = np.array(grams(w), np.int32)
                if len(memo) < MEMO // 2 and len(w) <= LONGEST:
                    memo[w] = g
            found.append(g)
        slots, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        yield slots.astype(np.int32), times.astype(np.float32)


def fit(rows: list[Counts], labels: list[int]) -> tuple[np.ndarray, float]:
    """(weight of each slot, bias)."""
    y = np.array(labels, np.float64)
    weights = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    counts = np.zeros((2, 1 << BITS))
    for (slots, _), label in zip(rows, labels, strict=True):
        counts[int(label), slots] += 1
    clean, toxic = counts
    share = toxic.sum() / max(counts.sum(), 1)
    # Smoothing in proportion to the class's mass: a feature that was never seen has the ratio 0.
    ratio = np.log((toxic + SMOOTH * share) / (clean + SMOOTH * (1 - share)) * (1 - share) / share)
    expected = (toxic + clean) * y.mean()
    ratio[np.abs(toxic - expected) < LEAST_SD * np.sqrt(expected * (1 - y.mean()) + 0.1)] = 0
    kept = [(s[k], t[k] * ratio[s[k]]) for s, t in rows for k in [ratio[s] != 0]]
    used, column = np.unique(np.concatenate([s for s, _ in kept]), return_inverse=True)
    if not len(used):
        return weights, float(np.log(y.mean() / (1 - y.mean())))
    value = np.concatenate([v for _, v in kept]).astype(np.float64)
    row = np.repeat(np.arange(len(kept)), [len(s) for s, _ in kept])
    # Each class weighs the same in total times its square-rooted share: rare toxic rows still count.
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    balance /= balance.mean()
    w, b = np.zeros(len(used)), 0.0
    scale = np.sqrt(np.bincount(column, value * value, len(used)) / len(y) + 1e-3)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * w[column], len(y)) + b
        err = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(column, value * err[row], len(used)) / scale + PENALTY * w * scale, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1] / scale, b - move[-1]
    weights[used] = (w * ratio[used]).astype(np.float32)
    return weights, float(b)


def held_out(doc_id: str | Column) -> Column:
    """Rows that no fit may use: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> DataFrame:
    """The labelled rows to fit on: text and label, at most toxic + clean rows, never a held-out one. Of rows that repeat a doc_id the least text counts, of repeated labels each one once."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out("doc_id") & F.col("label").isin(0, 1)).distinct()
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, toxic), (0, clean))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # its size is bounded by the two limits
    found = documents.select("doc_id", "text").join(ids, "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")  # no id gives more than one row of a label


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on (text, label) rows of bounded number, in one task that gets their counts; the driver gets the weights alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                slots, times = zip(*((s.tobytes(), t.tobytes()) for s, t in features(part.column(0).to_pylist())), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.binary()), pa.array(times, pa.binary()), part.column(1)], names=["slots", "times", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        got.sort(key=lambda r: (r[2], r[0], r[1]))  # the same fit whatever the order of rows
        weights, bias = fit([(np.frombuffer(s, np.int32), np.frombuffer(t, np.float32)) for s, t, _ in got], [r[2] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    counts = rows.mapInArrow(thrifty(count), "slots binary, times binary, label int")
    got = counts.repartition(1).mapInArrow(thrifty(run), "weights binary, bias double").first()
    if got is None:  # no row, no task
        return fit([], [])
    return np.frombuffer(got["weights"], np.float32), got["bias"]


class _Scores(dict):
    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        w = self.weights
        out = sum([w[g] for g in grams(word)])
        if len(word) <= LONGEST:
            self[word] = out
        return out


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """df with score (probability of label 1) and predicted (1 from 0.5 on)."""
    df = df.drop(*(c for c in ("score", "predicted") if c != text))
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the input
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        memo = _Scores(weights)
        for batch in batches:
            texts, z = batch.column(batch.schema.get_field_index(text)), np.full(batch.num_rows, bias)
            for a in range(0, batch.num_rows, 256):
                for i, t in enumerate(texts.slice(a, 256).to_pylist(), a):
                    if t:
                        z[i] += sum(map(memo.__getitem__, sorted(words(t))))  # sorted: the same sum on every worker
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return df.mapInArrow(thrifty(run), schema)
