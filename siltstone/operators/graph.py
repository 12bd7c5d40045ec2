"""Graph memory: schemas, facts and passages as tables; neighbours, breadth-first walks, personalised PageRank and pruning."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import cut, drop, release

DAMPING, STEPS, LEAST = 0.85, 20, 0.01
#: Pairs that a part of a graph should hold, pairs in a row of it, and how an id tells its part and its place there.
PAIRS, ROW, BITS = 1 << 23, 1 << 20, 33
PLACE = (1 << BITS) - 1
#: What a part holds, what moves in a step, and the sums that are no group's: what nodes without neighbours hold, and how many nodes there are.
OWN, MOVED = "part int, other int, a binary, b binary", "part int, source int, v binary, g long, s double"
_OWN = pa.schema([("part", pa.int32()), ("other", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_MOVED = pa.schema([("part", pa.int32()), ("source", pa.int32()), ("v", pa.binary()), ("g", pa.int64()), ("s", pa.float64())])
LOST, SIZE = -2, -1
#: Steps after which all that moves is written; between, it is kept.
WRITTEN = 5


def encode(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions (seq, schema, fact, passage) -> schemas (schema, frequency), facts (fact, schema of its first mention, passages)."""
    schemas = mentions.groupBy("schema").agg(F.count("*").alias("frequency"))
    facts = mentions.groupBy("fact").agg(F.min_by("schema", "seq").alias("schema"), F.count_distinct("passage").alias("passages"), F.count("*").alias("mentions"))
    return schemas, facts


def frequent(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Mentions whose schema is mentioned ``least`` times or more: an aggregate and a join, so a hot schema is pre-aggregated."""
    keep = mentions.groupBy("schema").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("schema")
    return mentions.join(keep, "schema", "left_semi")


def links(facts: DataFrame, members: DataFrame) -> DataFrame:
    """facts (fact, schema), members (fact, passage) -> distinct (src, dst) of facts of different schemas that share a passage, both ways. A passage holds a
    bounded number of facts; facts of one schema, of which there may be very many, are all neighbours and never paired."""
    m = members.distinct().join(facts.select("fact", "schema"), "fact")
    a, b = m.toDF("src", "passage", "s"), m.toDF("dst", "passage", "t")
    return a.join(b, "passage").where("s <> t").select("src", "dst").distinct()


def degrees(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, degree, first): how many facts share a schema or a passage with each, and the least of them; facts without any are left out."""
    low = facts.groupBy("schema").agg(F.min("fact").alias("low"), F.count("*").alias("n"))
    second = facts.join(low, "schema").where("fact <> low").groupBy("schema").agg(F.min("fact").alias("next"))
    own = facts.join(low, "schema").join(second, "schema", "left").select(F.col("fact").alias("src"), (F.col("n") - 1).alias("same"), F.when(F.col("fact") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("near"))
    far = pairs.groupBy("src").agg(F.count("*").alias("other"), F.min("dst").alias("far"))
    out = own.join(far, "src", "left").withColumn("degree", F.col("same") + F.coalesce("other", F.lit(0)))
    return out.where("degree > 0").select("src", "degree", F.least("near", "far").alias("first"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """edges (src, dst, rel), seeds (node): edges within depth hops of a seed along their direction, with the hop at which they
    are first met. Nodes that have been reached are not entered again. Each hop is written, so plans do not grow."""
    seen = seeds.select("node").distinct()
    frontier, out = seen, None
    for hop in range(1, depth + 1):
        found = cut(edges.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").withColumn("hop", F.lit(hop)))
        out = found if out is None else out.unionByName(found)
        if hop < depth:
            frontier = cut(found.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
            seen = seen.unionByName(frontier)
    return out.groupBy("src", "dst", "rel").agg(F.min("hop").alias("hop"))


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of characters of text, of the given sizes."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(*map(one, sizes)))


def holding(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """hay (id, text), needles (needle) -> (needle, id) of texts that hold a needle. null holds and is held by nothing; an empty needle has no
    characters to meet by and is left to the caller. A needle meets the texts that hold its rarest run of three characters (of its own size, if
    shorter), never all texts, and those are compared; a needle with a run that no text holds meets none."""
    wanted = needles.where("needle <> ''").select("needle").distinct()
    size = F.least(F.length("needle"), F.lit(3))
    runs = wanted.select("needle", F.explode(F.when(size == 3, _grams(F.col("needle"), (3,))).otherwise(F.array("needle"))).alias("run"))
    texts = hay.where("text IS NOT NULL").select("id", F.col("text").alias("hay"))
    held = cut(texts.select("id", F.explode(_grams(F.col("hay"), (1, 2, 3))).alias("run")).join(runs.select("run").distinct(), "run", "left_semi"))
    often = held.groupBy("run").agg(F.count("*").alias("n"))
    rarest = runs.join(often, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("w")).where("w.n > 0")
    met = rarest.select("needle", F.col("w.run").alias("run")).join(held, "run").select("needle", "id")
    return met.join(texts.where(F.length("hay") > 0), "id").where(F.contains("hay", "needle")).select("needle", "id").distinct()


def seeds_by_name(nodes: DataFrame, words: DataFrame, limit: int = 10) -> DataFrame:
    """nodes (id, one for each, and name), words (word): for each word the first limit nodes, by id, whose lower-case name holds it (see ``holding``); the empty word is in every name."""
    low = nodes.select("id", F.lower("name").alias("text"))
    nth = F.row_number().over(Window.partitionBy("word").orderBy("id"))
    found = holding(low, words.select(F.col("word").alias("needle"))).withColumnRenamed("needle", "word")
    first = found.withColumn("nth", nth).where(F.col("nth") <= limit).select("word", "id")
    every = nodes.where("name IS NOT NULL").select("id").distinct().orderBy("id").limit(limit)
    empty = words.where("word = ''").select("word").limit(1).crossJoin(every)  # one row by limit rows
    return first.unionByName(empty).join(nodes.select("id", "name"), "id").select("word", "id", "name")


def numbered(nodes: DataFrame, parts: int, *by: str) -> DataFrame:
    """nodes (number: of their group, ...) with id: the number of its part (parts are ranges of by, so that neighbours should be near by it) above the lowest 33 bits, and in those its place
    in the part, without gaps. Groups stand together there: what their nodes give is much alike and moves in few bytes (see ``_thin``)."""
    return cut(nodes.repartitionByRange(parts, *by).sortWithinPartitions("number").withColumn("id", F.monotonically_increasing_id()))


def parts_of(spark: SparkSession, pairs: int) -> int:
    """How many parts a graph of so many pairs is dealt into."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-pairs // PAIRS))


def sized(groups: DataFrame, g: str) -> DataFrame:
    """(g, number, many): the groups of two members or more, numbered, and how many others a member has."""
    return cut(groups.groupBy(g).agg((F.count("*") - 1).alias("many")).where(F.col(g).isNotNull() & (F.col("many") > 0)).withColumn("number", F.monotonically_increasing_id()))


def shares(seeds: DataFrame) -> DataFrame:
    """seeds (node, weight) -> (node, t): their part of all weights, also of seeds outside the graph."""
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    return seeds.groupBy("node").agg((F.sum("weight") / total).alias("t"))


def pagerank(pairs: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING, least: float = LEAST, groups: DataFrame | None = None) -> DataFrame:
    """pairs (src, dst), seeds (node, weight), groups (node, g: at most one each) -> (node, score) above least.

    Neighbours are those of pairs and, without a pair being built, all others of the same group: what a group gives is its sum less a node's own share.
    As the reference computes it: teleport = weight / sum of all weights, also of seeds outside the graph; what nodes without
    neighbours hold goes to every node in equal parts, undamped. Nodes are numbered first, so that the steps (see ``flow``) move numbers and never names.
    """
    pairs = cut(pairs.select("src", "dst"))
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    if groups is None:
        base = nodes.withColumns({"number": F.lit(None).cast("long"), "many": F.lit(0).cast("long")})
    else:
        base = nodes.join(groups.join(sized(groups, "g"), "g").select("node", "number", "many"), "node", "full_outer")
    parts = parts_of(pairs.sparkSession, pairs.count())
    all_nodes = numbered(base.join(shares(seeds), "node", "left"), parts, "node")
    names = all_nodes.select("id", "node")
    ends = pairs.join(names.toDF("from", "src"), "src").join(names.toDF("to", "dst"), "dst").select("from", "to")
    return flow(all_nodes, ends, parts, steps, damping).where(F.col("score") > least).join(names, "id").select("node", "score")


def shared(members: DataFrame) -> DataFrame:
    """members (passage, facts: array of (id, number)) -> (from, to) of facts of different groups that share a passage, both ways and once for each passage."""
    one = members.select(F.explode("facts").alias("a"), "facts").select("a", F.explode("facts").alias("b"))
    return one.where("a.id <> b.id AND NOT (a.number <=> b.number AND a.number IS NOT NULL)").select(F.col("a.id").alias("from"), F.col("b.id").alias("to"))


def flow(nodes: DataFrame, pairs: DataFrame, parts: int, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """nodes (id as ``numbered`` gives it, number of the group or null, many: others in it, t: teleport or null), pairs (from, to; repeated ones count once) -> (id, score) after so many steps
    of personalised PageRank; nodes without any neighbour are left out.

    Pairs lie with the part of their end and stay there. In a step a part gets from each other part one number for each node of it that it has pairs from, in an order that
    both know, so neither pairs nor ids are moved; and from each group that it has members of, the sum. A step is a cogroup of parts; sums are written, what else a step gives is kept (memory and disk) and
    written each WRITTEN steps, so that plans do not grow and a lost executor costs no more than these. Numbers move as differences by bytes (``_thin``), and a state that was written is deleted when a later one is.
    """
    rows = pairs.mapInArrow(_packed, "part int, a binary, b binary").groupBy("part").applyInArrow(_settled, OWN)
    ranks = nodes.select(F.shiftright("id", 33).cast("int").alias("part"), "id", F.coalesce("number", F.lit(-1)).alias("number"), F.coalesce("many", F.lit(0)).cast("double").alias("many"), F.coalesce("t", F.lit(0.0)).alias("t"))
    own = rows.unionByName(ranks.groupBy("part").applyInArrow(_listed, OWN)).repartition(parts, "part").persist(StorageLevel.MEMORY_AND_DISK)
    held = [own]
    try:
        state = written = cut(own.groupBy("part").applyInArrow(lambda mine: _moved(mine, None, damping, steps == 0), MOVED))
        for step in range(steps):
            sums = state.where("source = -2").groupBy("g").agg(F.sum("s").alias("s"), F.collect_list("part").alias("parts"))
            totals = cut(sums.select(F.explode("parts").alias("part"), F.lit(-2).alias("source"), F.lit(None).cast("binary").alias("v"), "g", "s"))  # a kept state is computed here
            while len(held) > 2:
                held.pop(1).unpersist()
            came = state.where("source <> -2").unionByName(totals)
            state = own.groupBy("part").cogroup(came.groupBy("part")).applyInArrow(_step(damping, step == steps - 1), MOVED)
            if step == steps - 1 or step % WRITTEN == WRITTEN - 1:
                state = cut(state)
                drop(written)
                written = state
                while len(held) > 1:
                    held.pop().unpersist()
                release(pairs.sparkSession)
            else:
                held.append(state.persist(StorageLevel.MEMORY_AND_DISK))
    finally:
        for df in held:
            df.unpersist()
    return state.where("source = -1").select("part", "v").mapInArrow(_unpacked, "id long, score double")


def _thin(x: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes as differences from the one before (of floats, in bits, so that nothing is lost), all first bytes, then all second ones, ..., deflated: near numbers take few bytes."""
    u = x.view(f"u{x.itemsize}")
    d = u.copy()
    d[1:] = u[1:] ^ u[:-1] if x.dtype.kind == "f" else u[1:] - u[:-1]
    packer = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return packer.compress(d.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) + packer.flush()


def _thick(b, kind) -> np.ndarray:
    kind = np.dtype(kind)
    d = np.frombuffer(zlib.decompress(b, -15), np.uint8).reshape(kind.itemsize, -1).T.copy().view(f"u{kind.itemsize}").ravel()
    return (np.bitwise_xor.accumulate(d) if kind.kind == "f" else np.cumsum(d, dtype=d.dtype)).view(kind)


def _packed(batches):
    """Pairs (from, to) without repetition among each ROW of them, packed by the part of their end: (part, from ids, places of their ends)."""
    held, count = [], 0

    def emit():
        source, target = (np.concatenate(c) for c in zip(*held))
        at = np.lexsort((source, target))
        source, target = source[at], target[at]
        new = np.r_[True, (source[1:] != source[:-1]) | (target[1:] != target[:-1])]
        source, target = source[new], target[new]
        part = target >> BITS
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        place = (target & PLACE).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([int(part[i]) for i, _ in spans], pa.int32()), pa.array([_thin(source[i:j]) for i, j in spans], pa.binary()), pa.array([_thin(place[i:j]) for i, j in spans], pa.binary())], ["part", "a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
        if count >= ROW:
            yield emit()
            held, count = [], 0
    if count:
        yield emit()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _numbers(rows: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [_thick(b.as_buffer(), kind) for b in rows[column]]


def _settled(rows: pa.Table) -> pa.Table:
    """The pairs that end in a part: (part, -1, sources as indices, places of ends) in rows of ROW pairs, and for each part that sources are of (that part, this part, places there, pairs of each)."""
    part = rows["part"][0].as_py()
    source, place = np.concatenate(_numbers(rows, "a", np.int64)), np.concatenate(_numbers(rows, "b", np.int32)).astype(np.int64)
    ids, at = np.unique(source, return_inverse=True)
    width = int(place.max()) + 1
    at, place = (x.astype(np.int32) for x in np.divmod(np.unique(at * width + place), width))
    out = [(part, -1, _thin(at[i : i + ROW]), _thin(place[i : i + ROW])) for i in range(0, len(at), ROW)]
    times, home, there = np.bincount(at, minlength=len(ids)).astype(np.int32), ids >> BITS, (ids & PLACE).astype(np.int32)
    cuts = np.r_[0, np.flatnonzero(home[1:] != home[:-1]) + 1, len(home)].tolist()
    out += [(int(home[i]), part, _thin(there[i:j]), _thin(times[i:j])) for i, j in zip(cuts, cuts[1:])]
    return _table(out, _OWN)


def _listed(rows: pa.Table) -> pa.Table:
    """The nodes of a part by place: (part, -2, teleports, numbers of groups) and (part, -3, others in the group)."""
    part, at = rows["part"][0].as_py(), np.argsort(rows["id"].to_numpy())
    t, number, many = (_thin(rows[c].to_numpy()[at]) for c in ("t", "number", "many"))
    return _table([(part, -2, t, number), (part, -3, many, None)], _OWN)


def _moved(own: pa.Table, came: pa.Table | None, damping: float, last: bool) -> pa.Table:
    """A step of a part: from what came (its scores, numbers of other parts, sums of groups; nothing yet: scores are teleports) its new scores and, if another step follows, what it gives to others."""
    part, kind = own["part"][0].as_py(), own["other"].to_numpy()
    of = lambda k: own.filter(pa.array(kind == k))
    t, number, deg = _numbers(of(-2), "a", np.float64)[0], _numbers(of(-2), "b", np.int64)[0], _numbers(of(-3), "a", np.float64)[0].copy()
    grouped = np.flatnonzero(number >= 0)
    asks = [(o, there) for o, there in zip(kind[kind >= 0].tolist(), _numbers(own.filter(pa.array(kind >= 0)), "a", np.int32))]
    for (_, there), times in zip(asks, _numbers(own.filter(pa.array(kind >= 0)), "b", np.int32)):
        deg[there] += times
    edges = list(zip(_numbers(of(-1), "a", np.int32), _numbers(of(-1), "b", np.int32)))
    present = deg > 0
    for _, ends in edges:
        present[ends] = True
    given = lambda score: np.divide(score, deg, out=np.zeros(len(deg)), where=deg > 0)
    if came is None:
        score = np.where(present, t, 0.0)
    else:
        source = came["source"].to_numpy()
        before = given(_numbers(came.filter(pa.array(source == -1)), "v", np.float64)[0])
        values = dict(zip(source[source >= 0].tolist(), _numbers(came.filter(pa.array(source >= 0)), "v", np.float64)))
        values |= {o: before[there] for o, there in asks if o == part}
        got = np.concatenate([values[o] for o in sorted(values)]) if values else np.zeros(0)
        total = np.zeros(len(t))
        for starts, ends in edges:
            total += np.bincount(ends, weights=got[starts], minlength=len(t))
        sums = came.filter(pa.array(source == -2)).sort_by("g")
        keys, sum_of = sums["g"].to_numpy(), sums["s"].to_numpy()
        total[grouped] += sum_of[np.searchsorted(keys, number[grouped])] - before[grouped]
        lost, size = (sum_of[np.searchsorted(keys, k)] for k in (LOST, SIZE))
        score = np.where(present, (1 - damping) * t + damping * total + lost / max(size, 1.0), 0.0)
    out = [(part, -1, _thin(score), None, None)]
    if not last:
        give = given(score)
        out += [(o, part, _thin(give[there]), None, None) for o, there in asks if o != part]
        keys, at = np.unique(number[grouped], return_inverse=True)
        out += [(part, -2, None, int(k), float(x)) for k, x in zip(keys, np.bincount(at, weights=give[grouped], minlength=len(keys)))]
        out += [(part, -2, None, LOST, float(score[deg == 0].sum())), (part, -2, None, SIZE, float(present.sum()))]
    return _table(out, _MOVED)


def _step(damping: float, last: bool):
    return lambda own, came: _moved(own, came, damping, last)


def _unpacked(batches):
    for batch in batches:
        for part, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            score = _thick(v.as_buffer(), np.float64)
            at = np.flatnonzero(score)
            for i in range(0, len(at), ROW):
                yield pa.RecordBatch.from_arrays([pa.array((part << BITS) + at[i : i + ROW]), pa.array(score[at[i : i + ROW]])], ["id", "score"])


def prune(passages: DataFrame, links: DataFrame, facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages (passage), links (fact, passage), facts (fact, schema) after the passages of gone are removed: then facts
    without a passage, then schemas without a fact."""
    left = passages.join(gone, "passage", "left_anti")
    kept = links.join(gone, "passage", "left_anti")
    alive = facts.join(kept.select("fact").distinct(), "fact", "left_semi")
    return left, alive, alive.select("schema").distinct()
