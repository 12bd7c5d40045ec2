"""Substring dedup by super-k-mer partitioning: remove every word covered by a window of ``window`` words that also starts earlier.

1. A window's minimiser is the least hash among its grams of ``GRAM`` words (leftmost of equals), so equal windows have equal minimisers. Consecutive windows
   that share one, at one place, travel as one packed string (a super-k-mer: the slice of the text that they span) to the bucket of that minimiser.
2. A bucket drops minimisers that stand in one place only and cuts the other strings into words. Words get numbers (equal words, equal
   numbers), numbers of twice as many words follow by sorting pairs, up to ``window`` words; one sort by window and place then
   counts each window exactly and finds its first place. Hashes only choose the bucket. What goes back is the word
   ranges of each document that are covered by later places.
3. Minimisers with more than ``most`` strings (lines that a large part of the corpus shares, large groups of copies) are told by a count
   before the strings travel; at most 2 ** ``HOT_BITS`` of them can exist at any input size, since ``most`` grows with the number of strings. Their
   strings are first reduced to the distinct ones, with map-side combination; the windows of these are grouped by their words, again with
   map-side combination, and first places are joined back to the distinct strings and from them to the places. No task gathers such a
   minimiser, and no row of it is dropped or matched otherwise than by its words.

A place is (doc_id, start). Defined cases: null, empty and shorter texts lose nothing; a text of one repeated word keeps its first
``window`` words; null doc_ids come after all others; rows that repeat a doc_id are told apart by a 64-bit hash of their text, and none is earlier
than another at the same start; extra columns pass through, those called like a new one are replaced. Memory: about 150 bytes for each byte of a batch of
``BATCH_BYTES``; texts that are longer are cut into stretches of words that overlap by a window, so their length does not count. One word of any length is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import Scratch, as_bytes, mix64, release, slices, unused

WINDOW = 20
GRAM = 4
#: Bytes of packed strings of a bucket, and words that are sorted at once.
BUCKET_BYTES, SORTED_WORDS = 32 << 20, 1_000_000
#: Strings of a minimiser that one bucket takes, at least: what it sorts at once. 2 ** HOT_BITS bounds the number of minimisers beyond.
MOST, HOT_BITS = 1 << 15, 21
#: Strings are about three times as long as the texts. They travel in so many rounds, each of a share of the minimisers, so that no more lies on disk than about the texts themselves.
ROUNDS = 2
#: Bytes of text that are hashed at once.
STRETCH = 1 << 20
LONG_WORD = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The base of word hashes: odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(LONG_WORD, BASE, np.uint64)]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words [^\\x20\\x09-\\x0D]+ of texts that lie one after the other."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(~space & (cut[:-1] | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(~space & (cut[1:] | np.concatenate([space[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone: a polynomial, or another hash of long words."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    left = np.flatnonzero(size <= LONG_WORD)
    for i in range(int(size[left].max(initial=0))):  # the i-th byte of all words that have one
        left = left[size[left] > i]
        out[left] += (data[starts[left] + i].astype(np.uint64) + np.uint64(1)) * POWERS[i]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mix64(out)


def minimisers(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the least gram, leftmost of equals, in each window of so many consecutive words."""
    gram = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram += hashes[i : len(gram) + i] * np.uint64(BASE * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF)
    gram = mix64(gram, 1)
    least, where, width, wide = gram, np.arange(len(gram), dtype=np.int32), 1, window - GRAM + 1
    while width < wide:
        step = min(width, wide - width)
        right = least[step:] < least[:-step]
        least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
        width += step
    return least, where


def stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(start, end, text, first word) of the words of up to STRETCH bytes of whole texts, or of a part of a longer text
    that takes up the last window - 1 words of the part before."""
    for a, b in slices(offsets, STRETCH):
        if offsets[b] - offsets[a] <= 2 * STRETCH:
            starts, ends, of = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield starts + offsets[a], ends + offsets[a], of + a, 0
            continue
        # One long text. Its words are found a stretch at a time; a word that goes on into the next one is left to it.
        at, known, kept = int(offsets[a]), 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        while at < offsets[b]:
            size = STRETCH
            while True:
                to = min(at + size, int(offsets[b]))
                starts, ends, _ = words_of(data[at:to], np.array([0, to - at]))
                if to == offsets[b] or not len(ends) or ends[-1] < to - at or len(ends) > 1:
                    break
                size *= 2  # one word fills the stretch
            if to < offsets[b] and len(ends) and ends[-1] == to - at:
                to = at + int(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            starts, ends = np.concatenate([kept[0], starts + at]), np.concatenate([kept[1], ends + at])
            yield starts, ends, np.full(len(starts), a), known
            keep = min(window - 1, len(starts))
            known += len(starts) - keep
            kept, at = (starts[len(starts) - keep :], ends[len(ends) - keep :]), to


def super_kmers(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, row, first window, windows, from, to): runs of consecutive windows of a text that share one place of the minimiser key, and the bytes they span.
    Equal windows have their minimiser at one distance from their start, so they are never in one run."""
    for starts, ends, of, before in stretches(data, offsets, window):
        if len(starts) < window:
            continue
        key, where = minimisers(word_hashes(data, starts, ends), window)
        whole = of[: len(key)] == of[window - 1 :]  # windows within one text
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = where[at[1:]] != where[at[:-1]]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        a = at[first]
        row = of[a]
        origin = np.searchsorted(of, row)  # the text's first word here
        yield key[a].view(np.int64), row, a - origin + before, count, starts[a], ends[a + count + window - 2]


def _texts(batches: Iterator[pa.RecordBatch], text: str):
    for batch in batches:
        data, offsets = as_bytes(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def keys_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in _texts(batches, "text"):
            for key, *_ in super_kmers(data, offsets, window):
                yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    return run


STRINGS = "key long, doc_id long, version long, at int, windows int, packed binary"


def strings_of(window: int, hot: np.ndarray, share: int | None):
    """The packed strings whose minimiser is in hot (sorted), or, of all others, those of one of ROUNDS shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _texts(batches, "text"):
            raw, ids, versions = data.tobytes(), rows.column("doc_id"), rows.column("version")
            for key, row, at, n, a, b in super_kmers(data, offsets, window):
                is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)
                asked = is_hot if share is None else ~is_hot & (key.view(np.uint64) % np.uint64(ROUNDS) == share)
                key, row, at, n, a, b = (x[asked] for x in (key, row, at, n, a, b))
                packed = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                arrays = [pa.array(key), ids.take(pa.array(row)), versions.take(pa.array(row)), pa.array(at, pa.int32()), pa.array(n, pa.int32()), packed]
                for x in range(0, len(key), 8192):
                    yield pa.RecordBatch.from_arrays([c.slice(x, 8192) for c in arrays], names=["key", "doc_id", "version", "at", "windows", "packed"])

    return run


def numbered(x: np.ndarray) -> np.ndarray:
    """Equal values, equal numbers from 0, by sorting."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def window_numbers(words: np.ndarray, window: int) -> np.ndarray:
    """words: numbers of words. A number of each run of so many words, equal if their words are: sorted pairs of runs of half as many."""
    name, width, done, out = words, 1, 0, None
    rest = window
    while True:
        if rest & 1:  # this width is part of the window
            if out is None:
                out = name
            else:
                n = max(0, min(len(out), len(name) - done))
                out = numbered(out[:n] * (1 << 32) + name[done : done + n])
            done += width
        rest >>= 1
        if not rest:
            return out[: max(0, len(words) - window + 1)]
        name = numbered(name[:-width] * (1 << 32) + name[width:]) if len(name) > width else name[:0]
        width *= 2


def later_places(strings: pa.Table, window: int) -> pa.Table:
    """strings of whole minimisers: (doc_id, version, from, to), the word ranges covered by windows that start after their first place."""
    data, offsets = as_bytes(strings.column("packed"))
    starts, ends, of = words_of(data, offsets)
    raw = data.tobytes()
    words = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    n = strings.column("windows").to_numpy().astype(np.int64)
    first_word = np.searchsorted(of, np.arange(len(n)))
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    name = window_numbers(words, window)[first_word[row] + nth]
    doc = strings.column("doc_id")
    known = pc.is_valid(doc).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(doc, 0).to_numpy()
    start = strings.column("at").to_numpy().astype(np.int64)[row] + nth
    order = np.lexsort((start, ids[row], ~known[row], name))
    name, at = name[order], row[order]
    head = np.concatenate([[True], name[1:] != name[:-1]])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    same = (ids[at] == ids[at[first]]) & (known[at] == known[at[first]]) & (start[order] == start[order[first]])
    later = np.zeros(len(row), bool)
    later[order] = ~same
    hit = np.flatnonzero(later)
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)]) if len(hit) else np.zeros(0, bool)
    a = hit[new]
    b = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else a
    picked = strings.take(pa.array(row[a]))
    return pa.table({"doc_id": picked.column("doc_id"), "version": picked.column("version"), "from": pa.array(start[a], pa.int32()), "to": pa.array(start[b] + window, pa.int32())})


RANGES = "doc_id long, version long, from int, to int"


def bucket(window: int):
    """Rows sorted by key, whole keys in each partition: keys are held until the next one begins, some of them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            held.append(batch)
            words += int(pc.sum(batch.column("windows")).as_py() or 0) + batch.num_rows * window
            if words < SORTED_WORDS:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut == 0:
                continue  # one key goes on
            held[-1] = batch.slice(0, cut)
            yield from later_places(pa.Table.from_batches(held), window).to_batches()
            held = [batch.slice(cut)]
            words = int(pc.sum(held[0].column("windows")).as_py()) + held[0].num_rows * window
        if held:
            yield from later_places(pa.Table.from_batches(held), window).to_batches()

    return run


def place(doc: Column, at: Column) -> Column:
    """One number that orders places: doc_id, null last, then start."""
    return F.coalesce(doc.cast("decimal(20,0)"), F.expr("9223372036854775808BD").cast("decimal(20,0)")).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)") + at


def hot_ranges(strings: DataFrame, window: int, work: Scratch) -> DataFrame:
    """RANGES of the strings of hot minimisers, by grouping: distinct strings, their windows, first places, and back."""
    strings = work.table(strings, "hot_strings")
    p = place(F.col("doc_id"), F.col("at")).cast("decimal(38,0)")
    distinct = work.table(strings.groupBy("key", "packed").agg(F.min(p).alias("p"), F.count("*").alias("n"), F.max("windows").alias("windows")), "hot_distinct")
    words = F.filter(F.split(F.decode("packed", "UTF-8"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda j: F.struct(j.alias("j"), F.array_join(F.slice("words", j + 1, F.lit(window)), " ").alias("w")))
    each = distinct.withColumn("words", words).select("key", "packed", "p", "n", F.inline(cut))
    first = each.groupBy("w").agg(F.min((F.col("p") + F.col("j")).cast("decimal(38,0)")).alias("first"), F.sum("n").alias("times")).where("times > 1").select("w", "first")
    told = each.join(first, "w").groupBy("key", "packed").agg(F.collect_list(F.struct("j", "first")).alias("told"))  # at most window - GRAM + 1 entries each
    told = work.table(told, "hot_told")  # so that a frequent string is split in the join
    back = strings.withColumn("p", p).join(told, ["key", "packed"])
    hit = F.filter("told", lambda t: t["first"] != F.col("p") + t["j"])
    return back.select("doc_id", "version", F.explode(F.transform(hit, lambda t: t["j"] + F.col("at"))).alias("from")).select("doc_id", "version", "from", (F.col("from") + window).alias("to"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """docs (doc_id long, version long, text): RANGES, the word ranges that repeat an earlier place; they may overlap.
    most: strings of a minimiser that one bucket takes; by default MOST, or more if the corpus is so large that over 2 ** HOT_BITS minimisers could exceed that."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    spark = docs.sparkSession
    work = Scratch(spark, "super-kmers")
    seen = Observation()
    counts = docs.select("text").mapInArrow(keys_of(window), "key long").groupBy("key").count().observe(seen, F.sum("count").alias("n")).where(F.col("count") > (most or MOST))
    counts = work.table(counts, "counts")
    total = seen.get.get("n") or 0
    limit = most or max(MOST, total >> HOT_BITS)
    hot = np.sort(np.array([r["key"] for r in counts.where(F.col("count") > limit).select("key").collect()], np.int64))  # at most total / limit
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 200 // BUCKET_BYTES // ROUNDS)

    def told(share: int) -> DataFrame:
        """Rows are sorted by minimiser once, for the count of its places and for the bucket's kernel."""
        strings = docs.mapInArrow(strings_of(window, hot, share), STRINGS).repartition(buckets, "key")
        strings = strings.withColumn("places", F.count("*").over(Window.partitionBy("key"))).where("places > 1").drop("places")
        return work.table(strings.mapInArrow(bucket(window), RANGES), "ranges")

    ranges = told(0)
    for share in range(1, ROUNDS):
        release(spark)  # the strings of the round before
        ranges = ranges.unionByName(told(share))
    if len(hot):
        ranges = ranges.unionByName(work.table(hot_ranges(docs.mapInArrow(strings_of(window, hot, None), STRINGS), window, work), "hot_ranges"))
    return ranges


def remove_repeats(docs: DataFrame, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed, kept (the remaining words, one space between) and removed (word ranges [from, to))."""
    new = ["n_words", "n_removed", "kept", "removed"]
    docs = docs.drop(*new)
    version, id_ = unused(docs, "version"), unused(docs, "id")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), version: F.xxhash64("text")})
    plain = keyed.select(F.col(id_).alias("doc_id"), F.col(version).alias("version"), "text")
    found, of, of_version = unused(docs, "found"), unused(docs, "of"), unused(docs, "of_version")
    spans = repeated_ranges(plain, window, most).groupBy("doc_id", "version").agg(F.collect_set(F.struct("from", "to")).alias(found))
    spans = spans.withColumnsRenamed({"doc_id": of, "version": of_version})
    joined = keyed.join(spans, F.col(id_).eqNullSafe(F.col(of)) & (F.col(version) == F.col(of_version)), "left").select(*docs.columns, found)
    span = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(new, (T.LongType(), T.LongType(), T.StringType(), span), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = as_bytes(batch.column(batch.schema.get_field_index("text")))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                spans = part.column(part.schema.get_field_index(found)).to_pylist()
                sizes, gone, kept, removed = [], [], [], []
                for text, hits in zip(part.column(part.schema.get_field_index("text")).to_pylist(), spans, strict=True):
                    words = text.encode().split() if text else []  # bytes split at \x20 and \x09-\x0D alone
                    merged: list[list[int]] = []
                    for x, y in sorted((h["from"], h["to"]) for h in hits or ()):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                    sizes.append(len(words))
                    gone.append(sum(y - x for x, y in merged))
                    for x, y in reversed(merged):
                        del words[x:y]
                    kept.append(b" ".join(words).decode())
                    removed.append([{"from": x, "to": y} for x, y in merged])
                columns = [part.column(i) for i, f in enumerate(part.schema) if f.name != found]
                columns += [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.col("kept"), "UTF-8"), 256).alias("kept_sha256"))
