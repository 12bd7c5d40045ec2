"""A stored vector index that skips rows: coarse cells, product-quantised residuals, exact scores of the best.

Vectors are brought to length 1, so that inner products are cosines. Centroids of cells, and for each of ``parts`` sections of a vector 256 codes for what is left after its centroid, are fitted by k-means on
at most ``SAMPLE`` vectors (those of least hash of their id; fitting, and nothing else, sees a sample). Every vector is put into the cell of its nearest centroid, a folder
of the table, with one byte for each section beside it. A search names for each query its ``probes`` nearest cells, reads ids and codes of these folders, where they lie, keeps
for each query the ``wide`` * k best by the sum of its table entries, and scores them by their own vectors. What is approximate is which rows are
seen; scores are exact.

Entries work as in a journal: the last one of an id decides. Dimensions are checked when vectors are added; null and zero vectors and null ids are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.dense import dot, doubles, norm
from siltstone.sources.tables import cut
from siltstone.sources.versioned import Versioned

SAMPLE = 20_000
#: Queries of one pass over the cells: what goes to each task is bounded by them.
QUERIES = 1024
CODES = 256


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x (copies of rows, if there are fewer), from rows at even steps of the order by hash that x is in; an empty cell takes the row that is farthest from its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        filled = n > 0
        centres[filled] = sums[filled] / n[filled, None]
        empty = np.flatnonzero(~filled)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]] if len(empty) <= len(x) else centres[empty]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the nearest centre of each row."""
    out, far, own = np.zeros(len(x), np.int64), np.zeros(len(x)), (centres**2).sum(axis=1)
    for a in range(0, len(x), 4096):
        d = own - 2 * (x[a : a + 4096] @ centres.T)
        out[a : a + 4096] = d.argmin(axis=1)
        far[a : a + 4096] = d.min(axis=1) + (x[a : a + 4096] ** 2).sum(axis=1)
    return out, far


class CellIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = Versioned(spark, folder)
        self.spark = spark

    def create(self, points: DataFrame, cells: int = 256, parts: int = 8) -> int:
        """Fit to points (id, vector) and add them all."""
        points = self._usable(points)
        width = points.agg(F.max(F.size("v")).alias("w")).first()["w"]
        if width is None or width % parts:
            raise ValueError("there have to be vectors, of a dimension that the parts divide")
        self._check(points, width)
        sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").coalesce(1)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate([matrix(b.column(0)) for b in batches])
            centres = k_means(x, cells)
            left = x - centres[nearest(x, centres)[0]]
            step = width // parts
            codes = [k_means(np.ascontiguousarray(left[:, p * step : (p + 1) * step]), CODES) for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(parts)], pa.int32()), pa.array([c.astype("<f8").tobytes() for c in (centres, *codes)], pa.binary())], names=["part", "centres"])

        model = self.table.write(sample.mapInArrow(fit, "part int, centres binary"), "model")
        self.table.append(lambda now, at: [{"name": model, "kind": "model", "width": width, "cells": cells, "parts": parts}])
        return self._add(points)

    def _usable(self, points: DataFrame) -> DataFrame:
        rows = points.select("id", doubles("vector").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0)).withColumn("n", norm(F.col("v"))).where("n > 0")
        return rows.groupBy("id").agg(F.max(F.struct("v", "n")).alias("r")).select("id", F.transform("r.v", lambda x: x / F.col("r.n")).alias("v"))

    def _check(self, points: DataFrame, width: int) -> None:
        other = points.where(F.size("v") != width).count()
        if other:
            raise ValueError(f"{other} vectors are not of dimension {width}")

    def _model(self, version: int | None = None) -> dict:
        """Centres and codes, no larger than cells and codes make them."""
        (told,) = [s for s in self.table.manifest(version)["segments"] if s["kind"] == "model"]
        read = {r["part"]: np.frombuffer(r["centres"], "<f8") for r in self.table.read(told["name"]).collect()}
        step = told["width"] // told["parts"]
        return {"centres": read[-1].reshape(told["cells"], told["width"]), "codes": np.stack([read[p].reshape(CODES, step) for p in range(told["parts"])])} | told

    def add(self, points: DataFrame) -> int:
        """points (id, vector) in place of those with their ids; ValueError if one has another dimension."""
        points = self._usable(points)
        self._check(points, self._model()["width"])
        return self._add(points)

    def _add(self, points: DataFrame) -> int:
        model = self._model()
        centres, codes, step = model["centres"], model["codes"], model["width"] // model["parts"]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                cell = nearest(x, centres)[0]
                left = x - centres[cell]
                code = np.stack([nearest(np.ascontiguousarray(left[:, p * step : (p + 1) * step]), codes[p])[0] for p in range(len(codes))], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "v", "code", "cell"])

        kind = points.schema["id"].dataType.simpleString()
        rows = points.mapInArrow(place, f"id {kind}, v array<double>, code binary, cell int")
        name = self.table.write(rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))), "rows", "cell")  # a hot cell is written by several tasks
        entries = self.table.write(self.table.read(name).select("id"), "entries")
        return self.table.append(lambda now, at: [{"name": name, "kind": "rows"}, {"name": entries, "kind": "entries"}])

    def remove(self, ids: DataFrame) -> int:
        name = self.table.write(ids.select("id").where("id IS NOT NULL").distinct(), "entries")
        return self.table.append(lambda now, at: [{"name": name, "kind": "entries"}])

    def rows(self, cells: list[int] | None, version: int, *columns: str) -> DataFrame:
        """Rows that count now, of some cells or of all."""
        rows = self.table.tagged("rows", version, None if cells is None else F.col("cell").isin(cells)).select(*columns, "_at")
        segments = [s["at"] for s in self.table.manifest(version)["segments"] if s["kind"] == "entries"]
        later = self.table.tagged("entries", version).where(F.col("_at") > min(segments)).groupBy(F.col("id").alias("_id")).agg(F.max("_at").alias("_last"))
        return rows.join(later, (F.col("id") == F.col("_id")) & (F.col("_last") > F.col("_at")), "left_anti").drop("_at")

    def search(self, queries: DataFrame, k: int, probes: int = 16, wide: int = 10, version: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): k rows for each query (query_id, vector), by exact cosine among the wide * k that look best in the probes nearest cells."""
        version = self.table.version() if version is None else version
        model = self._model(version)
        asked = cut(queries.select("query_id", doubles("vector").alias("q")).withColumn("n", norm(F.col("q"))).where("n > 0").select("query_id", F.transform("q", lambda x: x / F.col("n")).alias("q")))
        self._check(asked.withColumnRenamed("q", "v"), model["width"])
        blocks = max(1, -(-asked.count() // QUERIES))
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        found = None
        for block in range(blocks):
            part = dealt.where(F.col("block") == block).drop("block").collect()  # about QUERIES vectors
            if part:
                hits = self._block(part, asked.schema["query_id"].dataType.simpleString(), model, k * wide, probes, version)
                found = hits if found is None else found.unionByName(hits)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
        best = cut(found.withColumn("nth", near).where(F.col("nth") <= k * wide).select("query_id", "id", "cell"))
        cells = sorted(r["cell"] for r in best.select("cell").distinct().collect())  # no more than there are
        exact = best.join(self.rows(cells, version, "id", "cell", "v"), ["id", "cell"]).join(asked, "query_id").select("query_id", "id", dot(F.col("v"), F.col("q")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
        return exact.withColumn("rank", rank).where(F.col("rank") <= k)

    def _block(self, part: list, query_type: str, model: dict, most: int, probes: int, version: int) -> DataFrame:
        """(query_id, id, cell, near): for each query the most best rows of each task."""
        q = np.array([r["q"] for r in part])
        close = q @ model["centres"].T - (model["centres"] ** 2).sum(axis=1) / 2
        chosen = np.argsort(-close, axis=1, kind="stable")[:, :probes]
        asking = {int(c): np.flatnonzero((chosen == c).any(axis=1)) for c in np.unique(chosen)}
        step = model["width"] // model["parts"]
        tables = np.stack([q[:, p * step : (p + 1) * step] @ model["codes"][p].T for p in range(model["parts"])], axis=1)  # query, section, code
        at_centre = q @ model["centres"].T
        names = [r["query_id"] for r in part]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, tuple] = {}
            for batch in batches:
                cell = batch.column(2).to_numpy()
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(cell), -1)
                for c in np.unique(cell):
                    here = np.flatnonzero(cell == c)
                    for i in asking.get(int(c), ()):
                        near = at_centre[i, c] + sum(tables[i, p][code[here, p]] for p in range(code.shape[1]))
                        old = kept.get(i)
                        ids = batch.column(0).take(pa.array(here))
                        if old is not None:
                            near, ids, where = np.concatenate([old[0], near]), pa.concat_arrays([old[1], ids]), np.concatenate([old[2], np.full(len(here), c)])
                        else:
                            where = np.full(len(here), c)
                        if len(near) > most:
                            top = np.argpartition(-near, most)[:most]
                            near, ids, where = near[top], ids.take(pa.array(top)), where[top]
                        kept[i] = (near, ids, where)
            for i, (near, ids, where) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(near)), ids, pa.array(where.astype(np.int32)), pa.array(near)], names=["query_id", "id", "cell", "near"])

        rows = self.rows(sorted(asking), version, "id", "code", "cell")
        return rows.mapInArrow(scan, f"query_id {query_type}, id {rows.schema['id'].dataType.simpleString()}, cell int, near double")
