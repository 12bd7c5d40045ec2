"""Running sums, row numbers, last values and as-of joins by key and order, without a task that holds a key.

Rows are sorted by range of (keys, order) into parts and written. Each part adds up what it has of a key; those sums, a row for each key and part, are
carried on from part to part, and enter each part as a first row of the key. A key with most of the rows is spread over many parts; windows never cross one.
The order has to end in something unique for results that do not depend on how ties are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import cut

#: Rows of a part.
PART = 1_000_000


def _parts(rows: DataFrame, parts: int | None) -> int:
    return parts or max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))


def before(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """rows with, for each entry of sums, the sum over the rows of the same keys that stand before (0 for the first one), and for each entry of lasts the last value
    before that is not null. Null keys are a key. parts: how many parts; by default one for each PART rows, and no fewer than cores."""
    sums, lasts = sums or {}, lasts or {}
    values = {f"_sum_{n}": c for n, c in sums.items()} | {f"_last_{n}": c for n, c in lasts.items()}
    ranged = rows.withColumns(values) if values else rows
    ranged = ranged.repartitionByRange(_parts(rows, parts), *[F.col(k).asc() for k in keys], *order)
    at = {f"_order_{i}": c for i, c in enumerate(order)}
    ranged = cut(ranged.sortWithinPartitions(*[F.col(k).asc() for k in keys], *order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    totals = [F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums] + [F.max_by(f"_last_{n}", F.when(F.col(f"_last_{n}").isNotNull(), F.col("_nth"))).alias(f"_last_{n}") for n in lasts]
    if not totals:
        return ranged.drop("_part", "_nth", *at)
    each = ranged.groupBy(*keys, "_part").agg(*totals)
    until = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part that has the key
    carried = each.select(*keys, "_part", *[F.sum(f"_sum_{n}").over(until).alias(f"_sum_{n}") for n in sums], *[F.last(f"_last_{n}", ignorenulls=True).over(until).alias(f"_last_{n}") for n in lasts])
    both = ranged.unionByName(carried.withColumn("_nth", F.lit(-1).cast("long")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(ranged.dtypes)
    out = both.withColumns({f"_out_{n}": F.coalesce(F.sum(f"_sum_{n}").over(w), F.lit(0).cast(kinds[f"_sum_{n}"])) for n in sums} | {f"_out_{n}": F.last(f"_last_{n}", ignorenulls=True).over(w) for n in lasts})
    return out.where("_nth >= 0").select(*rows.columns, *[F.col(f"_out_{n}").alias(n) for n in (*sums, *lasts)])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "nth", parts: int | None = None) -> DataFrame:
    """rows with their number within their keys, from 1."""
    return before(rows, keys, order, {name: F.lit(1).cast("long")}, parts=parts).withColumn(name, F.col(name) + 1)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], parts: int | None = None) -> DataFrame:
    """left with, for each of values, what the last row of right with the same keys at or before its time has (all of one row, nulls included); null without one.
    Times are columns called at on both sides, with null times meeting nothing. Of rows of right at one time the greatest counts. Both sides are merged in one sorted order."""
    found = right.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("_found"))
    both = left.withColumn("_left", F.lit(True)).unionByName(found, allowMissingColumns=True)
    order = [F.col(at).asc(), F.coalesce("_left", F.lit(False)).asc(), F.xxhash64(*[F.col(c) for c in left.columns if not isinstance(left.schema[c].dataType, _maps())]).asc()]
    out = before(both, keys, order, lasts={"_seen": F.col("_found")}, parts=parts).where("_left")
    seen = F.when(F.col(at).isNotNull(), F.col("_seen"))
    return out.select(*left.columns, *[seen[v].alias(v) for v in values])


def _maps():
    from pyspark.sql.types import MapType

    return MapType


def spaced(samples: DataFrame, keys: list[str], at: str, least: float) -> DataFrame:
    """samples without those that come less than least after the one of their keys that was kept before; of equal times the least row counts, null times are out.

    Each sample points to the first one that comes late enough behind it (an as-of join), the first sample of a key is kept, and what is kept grows by jumps of
    1, 2, 4, ... pointers until it stays the same: no task walks through a key."""
    rest = [c for c in samples.columns if c not in (*keys, at)]
    rows = samples.where(F.col(at).isNotNull())
    if rest:
        rows = rows.groupBy(*keys, at).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, at, "_row.*").select(*samples.columns)
    else:
        rows = rows.distinct()
    rows = cut(rows)
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + [F.col(k).isNull() for k in keys]
    nodes = cut(rows.select(F.struct(*named).alias("_key") if keys else F.lit(0).alias("_key"), F.col(at).alias("_from")))
    # Sums of doubles are rounded: the sample at or after a slightly earlier time, or the one behind it, is the first whose difference is long enough.
    ahead = before(nodes, ["_key"], [F.desc("_from")], lasts={"_then": F.col("_from")}).select("_key", (-F.col("_from")).alias("_at"), F.col("_from").alias("_to"), "_then")
    later = as_of(nodes.withColumn("_at", -(F.col("_from") + least * (1 - 2.0**-40))), ahead, ["_key"], "_at", ["_to", "_then"])
    to = F.when(F.col("_to") - F.col("_from") >= least, F.col("_to")).otherwise(F.col("_then"))
    jumps = cut(later.select("_key", "_from", to.alias("_to")).where("_to IS NOT NULL"))
    kept, n = cut(nodes.groupBy("_key").agg(F.min("_from").alias("_from"))), -1
    while (size := kept.count()) != n:
        n = size
        kept = cut(kept.unionByName(kept.join(jumps, ["_key", "_from"]).select("_key", F.col("_to").alias("_from"))).distinct())
        jumps = cut(jumps.join(jumps.select("_key", F.col("_from").alias("_to"), F.col("_to").alias("_further")), ["_key", "_to"]).select("_key", "_from", F.col("_further").alias("_to")))
    tagged = rows.withColumn("_key", F.struct(*named) if keys else F.lit(0)).withColumn("_from", F.col(at))
    return tagged.join(kept, ["_key", "_from"], "left_semi").select(*samples.columns)
