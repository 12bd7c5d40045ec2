"""Keyed state with event-time timers: sessions that end when a key is idle, lockouts after too many failures, jobs that fail when they stall.

Rows wait in their key's state until the watermark has passed their time, and are then handled in order of time (and id), so results do not depend on how rows came in; later ones than
the watermark allows are dropped. Timers do what has no row of its own: they end a session, forget failures, fail a job. A key whose last timer has fired has no state.
State is in RocksDB and in the query's checkpoint; a query that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


class InOrder(StatefulProcessor):
    """Rows (key, at: microseconds, id, what) by key, in order of (at, id). A subclass handles a row, and a time at which it asked to be called."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), StructField("id", LongType()), StructField("what", StringType())]))
        self.value = handle.getValueState("value", StructType([StructField("text", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new = [(r["at"], r["id"], r["what"]) for r in rows if r["at"] // 1000 >= mark]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All rows before the watermark, in order, then the time it stands at: timers that are asked for meanwhile and lie before it need not fire."""
        until = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(r for r in rows if r[0] // 1000 < until)
        if due:
            left = [r for r in rows if r[0] // 1000 >= until]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(left)[0] // 1000 + 1)
            else:
                self.waiting.clear()
        state = self.load(self.value.get()[0] if self.value.exists() else None)
        for at, id_, what in due:
            yield from self.row(key, state, at, id_, what)
        yield from self.time(key, state, until * 1000)
        text = self.dump(state)
        if text is None:
            self.value.clear() if self.value.exists() else None
        else:
            self.value.update((text,))

    def ask(self, micros: int) -> None:
        """Call time() once the watermark is beyond this time."""
        self.handle.registerTimer(-(-micros // 1000) + 1)

    def close(self) -> None:
        pass

    def load(self, text: str | None) -> dict:
        return {"times": [int(x) for x in text.split(",")] if text else []}

    def dump(self, state: dict) -> str | None:
        return ",".join(map(str, state["times"])) or None

    def row(self, key, state: dict, at: int, id_: int, what: str | None) -> Iterator[Row]:
        raise NotImplementedError

    def time(self, key, state: dict, now: int) -> Iterator[Row]:
        raise NotImplementedError


class Sessions(InOrder):
    """A key's rows until none has come for more than gap seconds: (key, start, n, seconds). Of a session only its first and last time and its number of rows are held."""

    def __init__(self, gap: int) -> None:
        self.gap = gap * MICROS

    def _end(self, key, state: dict) -> Iterator[Row]:
        first, last, n = state["times"]
        state["times"] = []
        yield Row(key=key[0], start=_time(first), n=n, seconds=int((last - first) / MICROS))

    def row(self, key, state, at, id_, what):
        if state["times"] and at - state["times"][1] > self.gap:
            yield from self._end(key, state)
        state["times"] = [state["times"][0], at, state["times"][2] + 1] if state["times"] else [at, at, 1]
        self.ask(at + self.gap)

    def time(self, key, state, now):
        if state["times"] and now > state["times"][1] + self.gap:
            yield from self._end(key, state)


class Failures(InOrder):
    """How many rows of a key came within the last seconds, this one included, and whether that locks it out: (key, id, n, locked). Times are forgotten once they are too old."""

    def __init__(self, seconds: int, locked_from: int) -> None:
        self.span, self.locked_from = seconds * MICROS, locked_from

    def row(self, key, state, at, id_, what):
        state["times"] = [t for t in state["times"] if t >= at - self.span] + [at]
        self.ask(at + self.span)
        yield Row(key=key[0], id=id_, n=len(state["times"]), locked=len(state["times"]) >= self.locked_from)

    def time(self, key, state, now):
        state["times"] = [t for t in state["times"] if t + self.span >= now]
        yield from ()


class Stalls(InOrder):
    """Jobs that are running and say nothing for more than limit seconds: (key, at, seconds), once, when the time is up; any later word of the job starts anew."""

    def __init__(self, limit: int) -> None:
        self.limit = limit * MICROS

    def row(self, key, state, at, id_, what):
        yield from self._late(key, state, at)
        state["times"] = [at] if what == "running" else []
        if state["times"]:
            self.ask(at + self.limit)

    def _late(self, key, state, now):
        if state["times"] and now > state["times"][0] + self.limit:
            yield Row(key=key[0], at=_time(state["times"][0]), seconds=self.limit // MICROS)
            state["times"] = []

    def time(self, key, state, now):
        yield from self._late(key, state, now)


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(micros // MICROS, timezone.utc).replace(microsecond=micros % MICROS)


RESULTS = {Sessions: "key long, start timestamp, n long, seconds long", Failures: "key long, id long, n long, locked boolean", Stalls: "key long, at timestamp, seconds long"}


def timed(stream: DataFrame, processor: InOrder, late: str, key: str, ts: str, id_: str, what: str | None = None) -> DataFrame:
    """The stream of what a processor makes of the rows of each key (a whole number)."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_).cast("long").alias("id"), (F.col(what) if what else F.lit(None)).cast("string").alias("what"))
    rows = rows.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(processor, RESULTS[type(processor)], "append", "eventTime")


def use(spark: SparkSession) -> None:
    """State in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run_timed(spark: SparkSession, results: DataFrame, out: str, checkpoint: str):
    """The query that appends results to Parquet at out, until the input there is has been used up."""
    use(spark)
    return results.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
