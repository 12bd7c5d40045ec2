"""The order of a queue: priority band, then what the user sorts by, then the oldest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import cut

#: Rows that one part of a sorted queue holds.
PART = 1_000_000


def order(sort: str, descending: bool = False) -> list[Column]:
    """Sort columns of rows (band, file_name, size, updated_at, status, id); an unknown key sorts by size, priority has no second key."""
    key = {"name": F.lower(F.coalesce("file_name", F.lit(""))), "updated": F.coalesce(F.col("updated_at").cast("string"), F.lit("")), "status": F.coalesce("status", F.lit("")), "priority": None}.get(sort, F.coalesce("size", F.lit(0)))
    second = [] if key is None else [key.desc() if descending else key.asc()]
    return [F.coalesce("band", F.lit(1)).asc(), *second, F.coalesce(F.col("updated_at").cast("string"), F.lit("")).asc(), F.col("id").asc()]


def _age(updated_at: Column, now: Column) -> Column:
    """Seconds since an update, never below 0; null without one."""
    return F.greatest(F.lit(0.0), now.cast("double") - updated_at.cast("timestamp").cast("double"))


def _over(updated_at: Column, now: Column, limit: int) -> Column:
    """F.greatest skips nulls, so a missing time is asked for by itself."""
    return updated_at.isNull() | (_age(updated_at, now) > limit)


def stalled(status: Column, updated_at: Column, now: Column, limit: int) -> Column:
    """A running row that has not moved for more than limit seconds, or has no time. A limit of 0 or less finds none."""
    return F.lit(False) if limit <= 0 else F.coalesce((status == "running") & _over(updated_at, now, limit), F.lit(False))


def shown(status: Column, updated_at: Column, now: Column, limit: int, indexed: bool = False) -> Column:
    """All rows but those that were indexed more than limit seconds ago, or at no known time. indexed, or a limit of 0 or less: all rows."""
    return F.lit(True) if indexed or limit <= 0 else ~F.coalesce((status == "indexed") & _over(updated_at, now, limit), F.lit(False))


def places(rows: DataFrame, by: list[Column], least: int = 8) -> DataFrame:
    """rows with place, from 1, in the order of by: sorted by range into parts, whose sizes are added up; no task sees all rows."""
    parts = max(least, -(-rows.count() // PART))
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ranged = cut(ranged)  # both sides of the join below read the same parts
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.join(F.broadcast(sizes.select(F.col("_part").alias("_of"), before.alias("_before"))), F.col("_part") == F.col("_of"))
    return out.withColumn("place", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_id", "_part", "_of", "_before")
