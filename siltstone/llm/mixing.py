"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of their ids, are cut into blocks. Block i (from 0) of a source with weight w is released at floor(i / w) and due by
ceil((i + 1) / w), counted in blocks of the whole mix; the released block that is due first goes next. A source that has had b of
the first t blocks then never deviates from w * t by a whole block.

Weights are taken exactly (a float as the decimal number that it is written as): a cycle has as many blocks as their common
denominator, equal weights one for each source, after which the schedule repeats. When a source has no block left, the others
share its weight in proportion: the mix is a row of phases, each with the sources that still have blocks, and the bound holds
within each phase. Nothing is dropped or repeated: the last phases hold what the largest sources have left over.

The plan, made on the driver, holds each phase's cycle, or the phase itself where that is shorter, and places any number of
blocks. With more than ``MOST_SOURCES`` sources or ``MOST_PLAN`` rows it is a table instead, with a row for each block,
written ``PLAN_ROWS`` rows at a time and joined by source and block.

Rows are numbered within their source without a task that sees the whole source: rows are sorted by range into parts, and a
row's number is its place in its part plus the rows of the parts and less those of the sources before. The counts of parts
(``MOST_PARTS`` at most) are broadcast, those of sources gathered, and broadcast up to ``MOST_SOURCES``.

Defined cases: sources are compared as text; a null source is a source of its own; null and repeated ids are ordered by the row's hash; weights that are missing, null, zero or
negative put a source behind all others with weights; an empty table gives no rows; extra columns pass through whatever their names, those called like new ones
are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import Scratch

BLOCK = 64
MOST_SOURCES = 500
MOST_PLAN, PLAN_ROWS = 400_000, 200_000
#: Deadlines beyond any table, of weights that are next to nothing, still fit a long.
FAR = 1 << 61
PART, MOST_PARTS = 20_000, 20_000


def shares(weights: dict, cycle: int | None = None) -> dict:
    """Whole numbers of blocks in a cycle, exactly in proportion to the weights and as small as can be. With a cycle, they are
    rounded to that many blocks, at least 1 each (or to the number of sources, if that is more)."""
    parts = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    if cycle is None:
        common = math.lcm(*(x.denominator for x in parts.values()))
        whole = {s: int(x * common) for s, x in parts.items()}
        least = math.gcd(*whole.values())
        return {s: n // least for s, n in whole.items()}
    total = sum(parts.values())
    exact = {s: x * cycle / total for s, x in parts.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    cycle = max(cycle, len(weights))
    order = sorted(weights, key=lambda s: (out[s] - exact[s], str(s)))
    while (rest := cycle - sum(out.values())) > 0:
        for s in order[:rest]:
            out[s] += 1
    while (over := sum(out.values()) - cycle) > 0:
        for s in sorted((s for s in out if out[s] > 1), key=lambda s: (exact[s] - out[s], str(s)))[:over]:
            out[s] -= 1
    return out


def slots(blocks: dict) -> Iterator[tuple]:
    """(source, number of its block, release, deadline) for each slot, without end. blocks: source -> blocks in a cycle.
    Among released blocks the one due first goes next; of equals, one whose successor is released before it is due, then by source."""
    cycle = sum(blocks.values())
    names = sorted(blocks, key=lambda s: (s is None, str(s)))
    done = [0] * len(names)

    def entry(k: int) -> tuple:
        b, i = blocks[names[k]], done[k]
        release, due = i * cycle // b, -(-(i + 1) * cycle // b)
        overlap = (i + 1) * cycle % b != 0  # its window and the next one's share a slot
        return release, (due, not overlap, k)

    waiting = [(*entry(k),) for k in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        due, _, k = heapq.heappop(ready)
        yield names[k], done[k], done[k] * cycle // blocks[names[k]], due
        done[k] += 1
        heapq.heappush(waiting, entry(k))


def schedule(blocks: dict) -> list[tuple]:
    """One cycle of slots."""
    return list(itertools.islice(slots(blocks), sum(blocks.values())))


def _targets(left: dict, weights: dict) -> dict:
    return shares({s: weights.get(s) for s in left if (weights.get(s) or 0) > 0} or dict.fromkeys(left, 1))


def plan(counts: dict, weights: dict, most: int = MOST_PLAN) -> list[dict] | None:
    """Phases: the blocks of a cycle, the first slot, the first block of each source and how many slots the phase has; of the
    order as much as the phase needs. counts: source -> number of blocks; a phase ends when a source's last block is placed.
    None: it would take more than most rows."""
    left, given = {s: n for s, n in counts.items() if n > 0}, dict.fromkeys(counts, 0)
    out, slot, rows = [], 0, 0
    while left:
        share = _targets(left, weights)
        length = sum(share.values())
        whole = min(left[s] // share[s] for s in share)
        order, taken = [], dict.fromkeys(share, 0)
        for o in itertools.islice(slots(share), min(length, most + 1)):
            order.append(o)
            taken[o[0]] += 1
            if (rows := rows + 1) > most:
                return None
            if not whole and taken[o[0]] == left[o[0]]:
                break
        count = len(order)
        ended = [s for s in share if whole and left[s] == whole * share[s]]
        if ended:
            # The phase ends with the last block of the source that ends first.
            taken = {s: whole * share[s] for s in share}
            last = min(max(k for k, o in enumerate(order) if o[0] == s) for s in ended)
            for o in order[last + 1 :]:
                taken[o[0]] -= 1
            count = whole * length - (length - last - 1)
        elif whole:
            count, taken = whole * length, {s: whole * share[s] for s in share}
            for o in order:
                count += 1
                taken[o[0]] += 1
                if taken[o[0]] == left[o[0]]:
                    break
        out.append({"share": share, "cycle": length, "order": order, "first": dict(given), "slot": slot, "slots": count, "taken": taken})
        rows += sum(1 for n in taken.values() if n)
        slot += count
        for s, n in taken.items():
            given[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
    return out


def placed(counts: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, phase, slot, release, deadline) of every block, in order: what a plan says, block by block."""
    left, given = {s: n for s, n in counts.items() if n > 0}, dict.fromkeys(counts, 0)
    phase = start = 0
    while left:
        for t, (s, i, release, due) in enumerate(slots(_targets(left, weights))):
            yield s, given[s] + i, phase, start + t, start + release, start + min(due, FAR)
            left[s] -= 1
            if not left[s]:
                break
        for s in list(left):
            given[s] = counts[s] - left[s]
            if not left[s]:
                del left[s]
        phase, start = phase + 1, start + t + 1


def numbered(keyed: DataFrame, work: Scratch, rows: int, starts: list[tuple]) -> DataFrame:
    """keyed (source, order, tie, row) -> (source, row, n): the row's number (from 0) within its source. starts: (source, rows of the sources before it)."""
    sort = [F.col(c).asc_nulls_last() for c in ("source", "order", "tie")]
    parts = min(MOST_PARTS, -(-rows // PART))
    ranged = keyed.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    ranged = work.table(ranged.select("source", "row", F.monotonically_increasing_id().alias("id")), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("id", 33))
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))  # MOST_PARTS rows at most
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("of"), before.alias("before"))
    first = keyed.sparkSession.createDataFrame(starts, T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType())]))
    out = ranged.join(F.broadcast(offsets), F.col("part") == F.col("of")).join(F.broadcast(first) if len(starts) <= MOST_SOURCES else first, F.col("source").eqNullSafe(F.col("name")))
    number = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("start")
    return out.select("source", "row", number.cast("long").alias("n"))


def mix(df: DataFrame, weights: dict | None = None, source: str = "source", order: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """df with mix_block (number within the source), mix_phase, mix_release, mix_deadline and mix_slot (of the block, in the
    whole mix), and mix_place (of the row: slot * block + its number in the block). weights: source -> target; None: equal."""
    new = ["mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline", "mix_place"]
    df = df.drop(*new)
    spark = df.sparkSession
    work = Scratch(spark, "mixing")
    named = lambda c: F.col(f"`{c}`")
    tie = F.xxhash64(*[named(c) for c, kind in df.dtypes if "map" not in kind and "variant" not in kind])
    keyed = df.select(named(source).cast("string").alias("source"), named(order).alias("order"), tie.alias("tie"), F.struct(*map(named, df.columns)).alias("row"))
    totals = keyed.groupBy("source").agg(F.count("*").alias("n")).collect()
    counts = {r[0]: -(-r["n"] // block) for r in totals}
    rows = sum(r["n"] for r in totals)
    if not rows:
        return df.select("*", *[F.lit(None).cast("long").alias(c) for c in new])
    weights = weights or dict.fromkeys(counts, 1)
    phases = plan(counts, weights) if len(totals) <= MOST_SOURCES else None
    ordered = sorted(totals, key=lambda r: (r[0] is None, b"" if r[0] is None else str(r[0]).encode()))  # as Spark sorts text
    starts = list(zip((r[0] for r in ordered), itertools.accumulate((r["n"] for r in ordered), initial=0)))
    out = numbered(keyed, work, rows, starts).withColumn("mix_block", F.floor(F.col("n") / block))
    out = _by_block(out, counts, weights, work) if phases is None else _by_cycle(out, phases)
    return out.withColumn("mix_place", F.col("mix_slot") * block + F.col("n") % block).select("row.*", *new)


def _by_block(out: DataFrame, counts: dict, weights: dict, work: Scratch) -> DataFrame:
    """out with the columns of its blocks, from a table of all blocks."""
    long = T.LongType()
    schema = T.StructType([T.StructField("_t", T.StringType()), *[T.StructField(c, long) for c in ("_b", "mix_phase", "mix_slot", "mix_release", "mix_deadline")]])
    path, rows = f"{work.path}/blocks", placed(counts, weights)
    while part := list(itertools.islice(rows, PLAN_ROWS)):
        out.sparkSession.createDataFrame(part, schema).write.mode("append").parquet(path)
    blocks = out.sparkSession.read.schema(schema).parquet(path)
    return out.join(blocks, F.col("source").eqNullSafe(F.col("_t")) & (F.col("mix_block") == F.col("_b")))


def _by_cycle(out: DataFrame, phases: list[dict]) -> DataFrame:
    """out with the columns of its blocks, from the cycles of a plan's phases."""
    spark, kind, long = out.sparkSession, T.StringType(), T.LongType()
    cells, spans = [], []
    for p, phase in enumerate(phases):
        # Of a cycle that is longer than its phase only the part in the phase counts.
        cycle, share = min(phase["cycle"], FAR), {s: min(n, FAR) for s, n in phase["share"].items()}
        cells += [(p, s, i, k, release, min(due, FAR), cycle) for k, (s, i, release, due) in enumerate(phase["order"])]
        spans += [(p, s, phase["first"][s], phase["first"][s] + n, phase["slot"], share[s]) for s, n in phase["taken"].items() if n]
    # MOST_PLAN rows at most.
    cell_rows = spark.createDataFrame(cells, T.StructType([T.StructField("_p", long), T.StructField("_s", kind), T.StructField("_i", long), *[T.StructField(c, long) for c in ("_k", "_release", "_due", "_cycle")]]))
    span_rows = spark.createDataFrame(spans, T.StructType([T.StructField("_q", long), T.StructField("_t", kind), *[T.StructField(c, long) for c in ("_first", "_end", "_slot", "_share")]]))
    inside = F.col("source").eqNullSafe(F.col("_t")) & (F.col("mix_block") >= F.col("_first")) & (F.col("mix_block") < F.col("_end"))
    out = out.join(F.broadcast(span_rows), inside).withColumn("_b", F.col("mix_block") - F.col("_first"))
    here = (F.col("_q") == F.col("_p")) & F.col("_t").eqNullSafe(F.col("_s")) & (F.col("_b") % F.col("_share") == F.col("_i"))
    out = out.join(F.broadcast(cell_rows), here)
    base = F.col("_slot") + F.expr("_b div _share") * F.col("_cycle")
    return out.withColumns({"mix_phase": F.col("_q"), "mix_slot": base + F.col("_k"), "mix_release": base + F.col("_release"), "mix_deadline": base + F.col("_due")})
