"""Tables of Parquet segments under numbered manifests, and keyed tables that are rebuilt beside the one in use.

A version is a small JSON file (``versions/00000012.json``) that names the segments it consists of. It appears by a rename that fails if the number is taken,
so a writer that has read version 11 can only write 12, and only if nobody else has. A segment is written whole before a manifest names it; one that
no manifest names is not part of the table. Readers hold one version and are not disturbed by later ones. Folders are those of any
Hadoop file system whose rename without overwriting is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Stale(RuntimeError):
    """Somebody has committed since the version that a commit is based on."""


class Versioned:
    """The manifests and segments below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(self._conf)
        self.folder = self._fs.makeQualified(path).toString()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _number(self, version: int) -> str:
        return f"versions/{version:08d}.json"

    def version(self) -> int:
        """The last version, 0 before the first commit."""
        if not self._fs.exists(self._path("versions")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """What a version (the last one, unless named) consists of."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "segments": [], "notes": {}}
        return json.loads(self._get(self._number(version)))

    def commit(self, base: int, segments: list[dict[str, Any]], notes: dict[str, Any] | None = None) -> int:
        """Version base + 1; Stale if there is one already."""
        out = {"version": base + 1, "segments": segments, "notes": notes or {}}
        name = f"versions/.{uuid.uuid4().hex}"
        self._put(name, json.dumps(out), False)
        written = self._path(name)
        gateway = self.spark.sparkContext._gateway
        no_overwriting = gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), self._conf)
        try:
            files.rename(written, self._path(self._number(base + 1)), no_overwriting)
        except Exception as e:
            self._fs.delete(written, False)
            if self.version() > base:
                raise Stale(f"version {base + 1} of {self.folder} is there already") from e
            raise
        return base + 1

    def write(self, df: DataFrame, name: str, *partition_by: str, bare: bool = False) -> str:
        """The segment name, written from df in place of what an attempt that did not come to a commit has left. bare: keep the name; else it is made unique."""
        name = name if bare else f"{name}-{uuid.uuid4().hex[:12]}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/segments/{name}")
        self._put(f"schemas/{name}.json", df.schema.json(), True)  # a segment without rows may have no file that tells it
        return name

    def read(self, name: str) -> DataFrame:
        """A segment, folder columns included."""
        schema = StructType.fromJson(json.loads(self._get(f"schemas/{name}.json")))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{name}")

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def tagged(self, kind: str, version: int | None = None, where: Column | None = None) -> DataFrame | None:
        """All segments of a kind as one frame, with the number of the entry (at) that each row came with as _at; where is put before the union, so that it prunes folders."""
        out = None
        for s in self.manifest(version)["segments"]:
            if s["kind"] == kind:
                df = self.read(s["name"])
                df = df if where is None else df.where(where)
                df = df if "_at" in df.columns else df.withColumn("_at", F.lit(s["at"]).cast("long"))
                out = df if out is None else out.unionByName(df)
        return out

    def append(self, new: Callable[[dict[str, Any], int], list[dict[str, Any]]]) -> int:
        """Commit the segments that new gives for the last manifest and the number of the entry, again for a later manifest if somebody was faster."""
        while True:
            now = self.manifest()
            at = now["notes"].get("entries", 0) + 1
            try:
                return self.commit(now["version"], [*now["segments"], *[{"at": at} | s for s in new(now, at)]], now["notes"] | {"entries": at})
            except Stale:
                continue

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete segments that none of the last versions names, and older manifests. Readers of older versions and attempts under way lose their segments."""
        last = self.version()
        kept = {s["name"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["segments"]}
        gone = []
        if self._fs.exists(self._path("segments")):
            gone = [s.getPath().getName() for s in self._fs.listStatus(self._path("segments")) if s.getPath().getName() not in kept]
        for name in gone:
            self._fs.delete(self._path(f"segments/{name}"), True)
            self._fs.delete(self._path(f"schemas/{name}.json"), False)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(self._number(v)), False)
        return sorted(gone)


class KeyedTable(Versioned):
    """Rows by a key: a base and a journal of added and removed rows. The last entry of a key decides; reads see it at once.

    ``rebuild`` stages a new base beside the table. Its commit takes over the entries that came after it began, so nothing that was added or removed meanwhile is lost
    or comes back, and it changes over by one manifest. Null keys are skipped; of rows of one call that share a key the greatest counts.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        super().__init__(spark, folder)
        self.key = key

    def _rows(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        if not rest:
            return rows.where(F.col(self.key).isNotNull()).distinct()
        return rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_row")).select(self.key, "_row.*").select(*rows.columns)

    def _append(self, kind: str, df: DataFrame, at: int | None) -> int:
        """The journal's next entry, after version at if one is named, else after whatever is last by then."""
        name = self.write(self._rows(df), kind)
        while True:
            now = self.manifest(at)
            try:
                return self.commit(now["version"], [*now["segments"], {"name": name, "kind": kind}], now["notes"])
            except Stale:
                if at is not None:
                    raise

    def add(self, rows: DataFrame, at: int | None = None) -> int:
        """Rows in place of those with their keys."""
        return self._append("add", rows, at)

    def remove(self, keys: DataFrame, at: int | None = None) -> int:
        """Without the rows of these keys; unknown ones change nothing."""
        return self._append("remove", keys.select(self.key), at)

    def current(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None while nothing has ever been added. The base is read past the journal's keys, and only the journal is grouped."""
        segments = self.manifest(version)["segments"]
        base = [self.read(s["name"]) for s in segments if s["kind"] == "base"]
        entries = [(i, s) for i, s in enumerate(segments) if s["kind"] != "base"]
        schema = next((self.read(s["name"]).columns for s in segments if s["kind"] in ("base", "add")), None)
        if schema is None:
            return None
        if not entries:
            return base[0].select(*schema)
        rest = [c for c in schema if c != self.key]
        tagged = None
        for i, s in entries:
            df = self.read(s["name"]).withColumn("_at", F.lit(i)).withColumn("_added", F.lit(s["kind"] == "add"))
            tagged = df if tagged is None else tagged.unionByName(df, allowMissingColumns=True)
        for c in rest:
            if c not in tagged.columns:
                tagged = tagged.withColumn(c, F.lit(None).cast(base[0].schema[c].dataType))
        last = tagged.groupBy(self.key).agg(F.max_by(F.struct("_added", *rest), "_at").alias("_row"))
        added = last.where("_row._added").select(self.key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*schema)
        return base[0].select(*schema).join(last.select(self.key), self.key, "left_anti").unionByName(added) if base else added

    def rebuild(self) -> "Rebuild":
        return Rebuild(self)

    def compact(self) -> int:
        """The current rows as a new base; entries that come meanwhile stay in the journal."""
        again = self.rebuild()
        rows = self.current(again.since)
        if rows is None:
            return self.version()
        return again.stage(rows).commit()


class Rebuild:
    """A new base for a keyed table, invisible until commit."""

    def __init__(self, table: KeyedTable) -> None:
        self.table = table
        now = table.manifest()
        self.since, self._known, self._generation = now["version"], {s["name"] for s in now["segments"]}, now["notes"].get("generation", 0)
        self._staged: list[str] = []

    def stage(self, rows: DataFrame) -> "Rebuild":
        """Part of the new base, or all of it; of parts that share a key the last counts."""
        self._staged.append(self.table.write(self.table._rows(rows), "staged"))
        return self

    def commit(self) -> int:
        """Change over to what was staged and all that was journalled since the rebuild began. Stale if another rebuild came first."""
        if not self._staged:
            raise ValueError("nothing is staged")
        table = self.table
        name = self._staged[0] if len(self._staged) == 1 else self._merged()
        while True:
            now = table.manifest()
            if now["notes"].get("generation", 0) != self._generation:
                raise Stale("the table has been rebuilt meanwhile")
            later = [s for s in now["segments"] if s["name"] not in self._known]
            try:
                return table.commit(now["version"], [{"name": name, "kind": "base"}, *later], now["notes"] | {"generation": self._generation + 1})
            except Stale:
                continue  # one more entry of the journal: take it along

    def _merged(self) -> str:
        parts = None
        for i, name in enumerate(self._staged):
            df = self.table.read(name).withColumn("_at", F.lit(i))
            parts = df if parts is None else parts.unionByName(df)
        rest = [c for c in parts.columns if c not in (self.table.key, "_at")]
        rows = parts.groupBy(self.table.key).agg(F.max_by(F.struct(*rest) if rest else F.lit(None), "_at").alias("_row"))
        merged = self.table.write(rows.select(self.table.key, *[F.col(f"_row.{c}").alias(c) for c in rest]), "staged")
        self.abort()
        return merged

    def abort(self) -> None:
        """Forget what was staged; the table stays as it is."""
        for name in self._staged:
            self.table._fs.delete(self.table._path(f"segments/{name}"), True)
        self._staged = []
