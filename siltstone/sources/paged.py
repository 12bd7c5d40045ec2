"""Collections of points in pages of JSON, as a scroll interface gives them: a Spark data source that reads page ranges in parallel, prunes by id and filters by
source where it reads, and writes in two phases; and an upsert that halves a failing batch until only the bad row is left out.

A collection is a folder: pages (``{"points": [{"id", "vector", "payload"}]}``) and ``index.json``, which names each page with its least and greatest id and number of points. Pages that
the index does not name do not exist, so a write is visible when its index is, all at once, and one that ends before leaves nothing behind that counts. The folder is any that
pyarrow's file systems open; driver and executors share it.

    register(spark)
    spark.read.format("paged").option("max_points", 1000).load(folder).where("id >= 10 AND source = 'x'")
    df.write.format("paged").mode("append").save(folder)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Points of a page that is written, and pages that one task reads.
PAGE, PAGES = 256, 16
SCHEMA = "id bigint, source string, vector array<double>, payload string"
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, path.rstrip("/")


def index_of(folder: str) -> dict[str, Any]:
    system, path = opened(folder)
    if system.get_file_info(f"{path}/index.json").type == fs.FileType.NotFound:
        return {"pages": []}
    with system.open_input_stream(f"{path}/index.json") as f:
        return json.loads(f.read())


def vector_of(point: dict[str, Any]) -> list[float] | None:
    """A point's vector; of named ones the first that holds numbers; None if there is none."""
    raw = point.get("vector")
    for v in raw.values() if isinstance(raw, dict) else [raw]:
        if isinstance(v, list) and v and isinstance(v[0], (int, float)):
            return [float(x) for x in v]
    return None


@dataclass
class Pages(InputPartition):
    files: list[str]
    most: int | None


class Paged(DataSource):
    """Options: path; max_points (points of the whole read at most, from the first page on; pages are cut off where they are dealt); dim (points with vectors of another length are left out)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "PagedReader":
        return PagedReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> "PagedWriter":
        return PagedWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known, and let filters be pushed into it."""
    spark.dataSource.register(Paged)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.most = int(options["max_points"]) if "max_points" in options else None
        self.dim = int(options["dim"]) if "dim" in options else None
        self.ids: list[tuple[str, Any]] = []
        self.sources: list[set] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the id and equality of the source are done here, all others are Spark's."""
        for f in filters:
            kind = type(f)
            if getattr(f, "attribute", None) == ("id",) and kind in COMPARED:
                self.ids.append((COMPARED[kind], f.value))
            elif getattr(f, "attribute", None) == ("id",) and kind is In:
                self.ids.append(("in", set(f.value)))
            elif getattr(f, "attribute", None) == ("source",) and kind in (EqualTo, In):
                self.sources.append(set(f.value) if kind is In else {f.value})
            else:
                yield f

    def _may_hold(self, least: int, most: int) -> bool:
        """Whether ids from least to most may pass."""
        tests = {"=": lambda v: least <= v <= most, ">": lambda v: most > v, ">=": lambda v: most >= v, "<": lambda v: least < v, "<=": lambda v: least <= v, "in": lambda v: any(least <= x <= most for x in v)}
        return all(tests[op](v) for op, v in self.ids)

    def partitions(self) -> list[Pages]:
        pages = [p for p in index_of(self.folder)["pages"] if self._may_hold(p["least"], p["most"])]
        out, left = [], self.most
        for i in range(0, len(pages), PAGES):
            part = pages[i : i + PAGES]
            if left is None:
                out.append(Pages([p["file"] for p in part], None))
                continue
            if left <= 0:
                break
            n = sum(p["n"] for p in part)
            out.append(Pages([p["file"] for p in part], min(n, left)))
            left -= n
        return out

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no page
            return
        system, path = opened(self.folder)
        tests = {"=": lambda i, v: i == v, ">": lambda i, v: i > v, ">=": lambda i, v: i >= v, "<": lambda i, v: i < v, "<=": lambda i, v: i <= v, "in": lambda i, v: i in v}
        seen = 0
        for file in partition.files:
            with system.open_input_stream(f"{path}/{file}") as f:
                points = json.loads(f.read())["points"]
            if partition.most is not None:
                points = points[: partition.most - seen]
            seen += len(points)
            rows = []
            for p in points:
                payload, v = p.get("payload") or {}, vector_of(p)
                if all(tests[op](p["id"], x) for op, x in self.ids) and all(payload.get("source") in s for s in self.sources) and (self.dim is None or v is not None and len(v) == self.dim):
                    rows.append((p["id"], payload.get("source"), v, json.dumps(payload, sort_keys=True)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.float64())), pa.array(columns[3], pa.string())], names=["id", "source", "vector", "payload"])


@dataclass
class Written(WriterCommitMessage):
    pages: list[dict[str, Any]]


class PagedWriter(DataSourceWriter):
    """Rows of SCHEMA; source goes into the payload. A task writes its pages under names of its own; the driver's commit names those of tasks that succeeded."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> Written:
        system, path = opened(self.folder)
        system.create_dir(f"{path}/pages", recursive=True)
        pages, held = [], []

        def flush() -> None:
            file = f"pages/{uuid.uuid4().hex}.json"
            with system.open_output_stream(f"{path}/{file}") as f:
                f.write(json.dumps({"points": held}).encode())
            ids = [p["id"] for p in held]
            pages.append({"file": file, "least": min(ids), "most": max(ids), "n": len(ids)})
            held.clear()

        for r in rows:
            payload = json.loads(r["payload"]) if r["payload"] else {}
            held.append({"id": r["id"], "vector": list(r["vector"]) if r["vector"] is not None else None, "payload": payload | ({"source": r["source"]} if r["source"] is not None else {})})
            if len(held) >= PAGE:
                flush()
        if held:
            flush()
        return Written(pages)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        old = [] if self.overwrite else index_of(self.folder)["pages"]
        pages = sorted([*old, *(p for m in messages if m is not None for p in m.pages)], key=lambda p: (p["least"], p["most"], p["file"]))
        system.create_dir(path, recursive=True)
        fresh = f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps({"pages": pages}).encode())
        system.move(fresh, f"{path}/index.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        for m in messages:
            for p in m.pages if m is not None else []:
                system.delete_file(f"{path}/{p['file']}")


class Refused(Exception):
    """A store's answer that trying again does not change."""


#: Errors that may pass.
PASSING = (ConnectionError, TimeoutError, OSError)


def put_all(points: list[dict], put: Callable[[list[dict]], None], retries: int = 3, backoff: float = 1.0, wait: Callable[[float], None] = time.sleep) -> list[tuple[dict, str]]:
    """put points, all or in halves: what a store refuses, or does not take after retries (each after twice the time), is halved until single points are left; these come back with
    the error. Other errors are the caller's."""
    if not points:
        return []
    error = ""
    for attempt in range(retries + 1):
        if attempt:
            wait(backoff * 2 ** (attempt - 1))
        try:
            put(points)
            return []
        except Refused as e:
            error = str(e)
            break
        except PASSING as e:
            error = f"{type(e).__name__}: {e}"
    if len(points) == 1:
        return [(points[0], error)]
    half = len(points) // 2
    return [bad for part in (points[:half], points[half:]) for bad in put_all(part, put, retries, backoff, wait)]


def upsert(rows: DataFrame, put: Callable[[list[dict]], None], batch: int = 256, retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """rows, in batches, into a store by put, which takes points again without harm (a task may run twice). The rows that it does not take, with why: columns of rows and error. To be
    written somewhere: nothing is put before."""
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "error"], T.StructField("error", T.StringType())])
    rows = rows.drop("error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for b in batches:
            kind = b.schema
            for a in range(0, b.num_rows, batch):
                bad = put_all(b.slice(a, batch).to_pylist(), put, retries, backoff)
                if bad:
                    taken = pa.RecordBatch.from_pylist([p for p, _ in bad], schema=kind)
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([e for _, e in bad], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
