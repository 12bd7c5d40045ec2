"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts earlier.

The suffix index is built in buckets, each small enough for one task, so that equal windows (strings of ``length`` bytes)
always meet in one bucket:

1. Texts are dealt evenly into batches, each packed into one row. Every window belongs to one anchor: its ``ANCHOR``-byte gram of least
   hash (leftmost first), which depends on the window's bytes alone. A batch sends each distinct anchor hash once; buckets
   of hashes report which anchors occur more than once anywhere. Windows of the other anchors cannot repeat.
2. Windows of very frequent anchors (over ``FREQUENT`` places: common lines in ever new surroundings) take part in a second round
   in which the whole window is the anchor, so that no anchor gathers more than one string for each batch that holds it.
3. A batch sends, for each repeated anchor, the piece of text that its windows span, each distinct piece once with its
   first place. In a bucket, pieces of an anchor that has only one distinct piece need no index; over all other pieces
   the bucket sorts suffixes to ``length`` symbols and finds the windows that share them by threshold-bounded interval
   expansion on the Burrows-Wheeler transform (``siltstone.llm.bwt``). Each window's first place goes back to its batches.
4. The batch marks windows that start after their first place and cuts the bytes they cover.

Hashes of anchors are mixed once more before they are dealt, so that buckets, which are equal ranges of hashes, are even though
anchors are least hashes. A bucket stands for ``BUCKET`` bytes of input and works on ``PART`` windows at a time. A batch sends a bucket one
message, and at most one for each of its own anchors, so messages grow with the input and not with batches times buckets.

Pieces are told apart by their anchor's and their own 64-bit hash. Places are ordered by doc_id, then start.

Defined cases: null and empty texts have no bytes; rows with a null doc_id come after all others; of rows that repeat a
doc_id none is earlier than another at the same start, and they may be in any batch; texts shorter than ``length`` lose nothing; a text of one repeated byte
keeps its first ``length`` bytes; extra columns play no part. A batch needs about 100 bytes of memory for each of its bytes; a text that is longer than
``BATCH`` makes a batch of its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bwt import equal_windows
from siltstone.llm.common import Scratch, as_bytes, blob_column, input_bytes, mix64

LENGTH = 100
ANCHOR = 32
FREQUENT = 1000
#: Bytes of input for each batch and for each bucket; the least number of either.
BATCH, BUCKET = 2 << 20, 32 << 20
LEAST_BATCHES = 64
#: Windows that a bucket looks at together, or those of one anchor.
PART = 1 << 20
#: Bytes of pieces in one suffix index.
INDEX = 256 << 10

_LAST = np.int64(2**63 - 1)
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256).astype(np.uint64)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []

_CALL = "kind int, batch long, bucket long, data binary"
#: Where a window was first seen: windows j .. j + count - 1 of piece i start at (doc, start), (doc, start + 1) ...
_FIRST = np.dtype([("i", "<i4"), ("j", "<i4"), ("count", "<i4"), ("doc", "<i8"), ("start", "<i8")])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BATCH + BATCH // 4)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


class _Batch:
    """The texts of a batch in order of doc_id, their windows and what has been said about them."""

    def __init__(self, texts: pa.Table, length: int) -> None:
        ids = texts.column("doc_id").combine_chunks()
        texts = texts.take(pa.array(np.lexsort((np.arange(len(ids)), ids.fill_null(_LAST).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))))
        self.ids = texts.column("doc_id").combine_chunks()
        self.docs = self.ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.data, self.offsets = as_bytes(texts.column("text"))
        self.length = length
        n = len(self.data)
        self.up, self.down = _power(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        terms = _BYTE[self.data]
        terms *= self.up[:n]
        np.cumsum(terms, out=self.total[1:])
        del terms
        size = np.maximum(np.diff(self.offsets) - length + 1, 0)
        ends = np.cumsum(size)
        self.starts = np.arange(int(ends[-1]) if len(ends) else 0)
        self.starts += np.repeat(self.offsets[:-1] - (ends - size), size)
        self.row = np.repeat(np.arange(len(self.docs), dtype=np.int32), size)  # of each window

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows in a row that have one anchor: first window (index into starts), end, anchor hash."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(self.data) - ANCHOR + 1
        gram = mix64((self.total[ANCHOR:] - self.total[:n]) * self.down[:n])
        bits = np.uint64(n.bit_length())
        low = gram >> bits
        low <<= bits
        low |= np.arange(n, dtype=np.uint64)
        span, width = 1, self.length - ANCHOR + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        anchor = low[self.starts]
        np.minimum(anchor, low[width - span :][self.starts], out=anchor)
        del low
        anchor &= (np.uint64(1) << bits) - np.uint64(1)
        anchor = anchor.view(np.int64)
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (self.row[1:] != self.row[:-1])))
        return new, np.append(new[1:], len(anchor)), mix64(gram[anchor[new]], 5)

    def asked(self, hashes: np.ndarray, replies: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, places of hashes in them, what buckets said of each: 0 single, 1 repeated, 2 frequent)."""
        distinct, where = np.unique(hashes, return_inverse=True)
        said = np.zeros(len(distinct), np.uint8)
        cut = _cuts(distinct, buckets)
        for bucket, data in replies:
            said[slice(*cut[bucket])] = np.frombuffer(data, np.uint8)
        return distinct, where, said

    def pieces(self, replies: dict[int, list[tuple[int, bytes]]], buckets: int) -> dict[str, np.ndarray]:
        """All windows that may repeat, in pieces: first window, windows, anchor hash; of each piece its distinct one."""
        first, end, anchor = self.runs()
        _, where, said = self.asked(anchor, replies.get(1, []), buckets)
        said = said[where]
        often = self.frequent(first, end, said)
        whole = self.hashed(self.starts[often], self.starts[often] + self.length)
        _, where, twice = self.asked(whole, replies.get(2, []), buckets)
        again = twice[where] > 0
        begun = first
        first = np.concatenate([begun[said == 1], often[again]])
        count = np.concatenate([(end - begun)[said == 1], np.ones(int(again.sum()), np.int64)])
        anchor = np.concatenate([anchor[said == 1], whole[again]])
        by = np.argsort(first, kind="stable")
        first, count, anchor = first[by], count[by], anchor[by]
        own = self.hashed(self.starts[first], self.starts[first] + count + self.length - 1)
        order = np.lexsort((np.arange(len(own)), own, anchor))
        a, c = anchor[order], own[order]
        new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return {"first": first, "count": count, "which": which, "chosen": order[new], "anchor": a[new], "own": c[new]}

    def frequent(self, first: np.ndarray, end: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Windows of frequent anchors."""
        f, size = first[said == 2], (end - first)[said == 2]
        ends = np.cumsum(size)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(f - (ends - size), size)


def _cuts(distinct: np.ndarray, buckets: int) -> dict[int, tuple[int, int]]:
    """The range of each bucket that is not empty among sorted hashes: buckets are equal ranges of the upper 32 bits."""
    if not len(distinct):
        return {}
    bucket = (distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return dict(zip(bucket[start].tolist(), zip(start.tolist(), np.append(start[1:], len(bucket)).tolist(), strict=True), strict=True))


def _calls(kind: int, batch: list, bucket: list, data: list[bytes]) -> pa.Table:
    n = len(data)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "batch": pa.array(batch, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})


def _said(calls: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {}
    for kind, bucket, data in zip(calls.column("kind").to_pylist(), calls.column("bucket").to_pylist(), calls.column("data").to_pylist(), strict=True):
        out.setdefault(kind, []).append((bucket, data))
    return out


def _ask(batch: int, hashes: np.ndarray, buckets: int, kind: int) -> pa.Table:
    distinct, count = np.unique(hashes, return_counts=True)
    cut = _cuts(distinct, buckets)
    # 40 bits of a hash beside its bucket: another hash with the same ones is asked for in vain, which changes no result.
    low, count = distinct.view(np.uint8).reshape(-1, 8)[:, :5], np.minimum(count, 255).astype(np.uint8)
    data = [low[x:y].tobytes() + count[x:y].tobytes() for x, y in cut.values()]
    return _calls(kind, [batch] * len(cut), list(cut), data)


def _tell_counts(kind: int, frequent: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """For each batch that asked: 0, 1 or 2 for each of its hashes; nothing if all are single."""
        data = rows.column("data").to_pylist()
        size = np.array([len(x) // 6 for x in data])
        hashes = np.zeros((int(size.sum()), 8), np.uint8)
        hashes[:, :5] = np.concatenate([np.frombuffer(x, np.uint8, 5 * n) for x, n in zip(data, size, strict=True)]).reshape(-1, 5)
        count = np.concatenate([np.frombuffer(x, np.uint8, n, 5 * n) for x, n in zip(data, size, strict=True)])
        _, where = np.unique(hashes.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(where, count)[where]
        said = np.where(total > frequent, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        ends = np.cumsum(size)
        keep = [i for i in range(len(data)) if said[ends[i] - size[i] : ends[i]].any()]
        batch = rows.column("batch").to_pylist()
        return _calls(kind, [batch[i] for i in keep], [key[0].as_py()] * len(keep), [said[ends[i] - size[i] : ends[i]].tobytes() for i in keep])

    return run


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def _batch_row(number: int, rows: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return _calls(0, [number], [-1], [sink.getvalue().to_pybytes()])


def _read_batch(rows: pa.Table, length: int) -> _Batch:
    return _Batch(pa.ipc.open_stream(rows.column("data")[0].as_buffer()).read_all(), length)


def _send_pieces(number: int, batch: _Batch, replies: dict, buckets: int) -> pa.Table:
    p = batch.pieces(replies, buckets)
    cut = _cuts(p["anchor"], buckets)
    at, count = batch.starts[p["first"][p["chosen"]]], p["count"][p["chosen"]]
    row = batch.row[p["first"][p["chosen"]]]
    out = {k: [] for k in ("bucket", "data")}
    for b, (x, y) in cut.items():
        text = b"".join(batch.data[s : s + c + batch.length - 1].tobytes() for s, c in zip(at[x:y].tolist(), count[x:y].tolist(), strict=True))
        head = np.array([y - x], np.int64).tobytes()
        out["bucket"].append(b)
        out["data"].append(_pack(head + p["anchor"][x:y].tobytes() + p["own"][x:y].tobytes() + batch.docs[row[x:y]].tobytes() + (at[x:y] - batch.offsets[row[x:y]]).tobytes() + count[x:y].tobytes() + text))
    return _calls(3, [number] * len(out["data"]), out["bucket"], out["data"])


def _classes(text: np.ndarray, begin: np.ndarray, size: np.ndarray, count: np.ndarray, anchor: np.ndarray, pick: np.ndarray, length: int) -> np.ndarray:
    """Classes of equal windows of the picked pieces (in order of anchor). Equal windows have one anchor, so an index takes
    the pieces of some anchors at a time, ``INDEX`` bytes or the pieces of one anchor."""
    cuts, run = [0], np.append(0, np.cumsum(size[pick]))
    for i in np.append(np.flatnonzero(anchor[pick][1:] != anchor[pick][:-1]) + 1, len(pick)).tolist():
        total = int(run[i] - run[cuts[-1]])
        if total >= INDEX or i == len(pick):
            cuts.append(i)
    out, base = [], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = pick[a:b]
        place = np.cumsum(np.append(0, size[some]))
        index = np.arange(int(place[-1])) + np.repeat(begin[some] - place[:-1], size[some])
        group = equal_windows(text[index], place, count[some], length)
        out.append(group + base)
        base += int(place[-1]) + len(some) + 1  # more than there are classes
    return np.concatenate(out)


def _first_places(text, begin, size, count, anchor, doc, start, lead, length):
    """(piece of lead, first window, windows, doc, start) of runs of windows of distinct pieces whose first places go on side by side."""
    windows = count[lead]
    ends = np.cumsum(windows)
    step = np.arange(int(ends[-1])) - np.repeat(ends - windows, windows)
    w_doc, w_start = np.repeat(doc[lead], windows), np.repeat(start[lead], windows) + step
    several = np.zeros(len(lead), bool)
    same = anchor[lead][1:] == anchor[lead][:-1]
    several[1:] |= same
    several[:-1] |= same
    if several.any():
        group = _classes(text, begin, size, count, anchor, lead[several], length)
        mine = np.flatnonzero(np.repeat(several, windows))
        by = np.lexsort((w_start[mine], w_doc[mine], group))
        head = np.append(True, group[by][1:] != group[by][:-1])
        low = mine[by][head][np.cumsum(head) - 1]
        to_doc, to_start = w_doc.copy(), w_start.copy()
        to_doc[mine[by]], to_start[mine[by]] = w_doc[low], w_start[low]
        w_doc, w_start = to_doc, to_start
    runs = np.flatnonzero(np.append(True, (w_doc[1:] != w_doc[:-1]) | (w_start[1:] != w_start[:-1] + 1)) | (step == 0))
    piece = np.repeat(np.arange(len(lead)), windows)[runs]
    return piece, step[runs], np.append(runs[1:], len(step)) - runs, w_doc[runs], w_start[runs]


def _find_first(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """For each batch: the first places of its pieces' windows, where they are not the batch's own first ones."""
        heads, texts, source, number = [], [], [], []
        for i, x in enumerate(map(_unpack, rows.column("data").to_pylist())):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            heads.append(np.frombuffer(x, np.int64, 5 * n, 8).reshape(5, n))
            texts.append(np.frombuffer(x, np.uint8, -1, 8 + 40 * n))
            source.append(np.full(n, i))
            number.append(np.arange(n))
        anchor, own, doc, start, count = np.concatenate(heads, axis=1)
        text, source, number = np.concatenate(texts), np.concatenate(source), np.concatenate(number)
        del heads, texts
        size = count + length - 1
        begin = np.cumsum(size) - size
        # One string for equal pieces, at its first place.
        order = np.lexsort((start, doc, own, anchor))
        a, c = anchor[order], own[order]
        new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
        at = np.append(np.flatnonzero(new), len(order))
        lead = order[new]
        cuts, run_ = [0], np.append(0, np.cumsum(count[lead]))
        for i in np.append(np.flatnonzero(anchor[lead][1:] != anchor[lead][:-1]) + 1, len(lead)).tolist():
            if run_[i] - run_[cuts[-1]] >= PART or i == len(lead):
                cuts.append(i)
        told, to = [], []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            piece, j, many, w_doc, w_start = _first_places(text, begin, size, count, anchor, doc, start, lead[x:y], length)
            r_at = np.searchsorted(piece, np.arange(y - x + 1))
            members = order[at[x] : at[y]]
            w = np.repeat(np.arange(y - x), np.diff(at[x : y + 1]))
            n = r_at[w + 1] - r_at[w]
            e = np.cumsum(n)
            r = np.arange(int(e[-1])) + np.repeat(r_at[w] - (e - n), n)
            got = np.empty(len(r), _FIRST)
            got["i"], got["j"], got["count"], got["doc"], got["start"] = np.repeat(number[members], n), j[r], many[r], w_doc[r], w_start[r]
            alone = (n == 1) & (w_doc[r_at[w]] == doc[members]) & (w_start[r_at[w]] == start[members])
            keep = np.repeat(~alone, n)
            told.append(got[keep])
            to.append(np.repeat(source[members], n)[keep])
        got, to = np.concatenate(told), np.concatenate(to)
        by = np.argsort(to, kind="stable")
        got, at = got[by], np.searchsorted(to[by], np.arange(rows.num_rows + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        return _calls(3, rows.column("batch").take(pa.array(some)).to_pylist(), [key[0].as_py()] * len(some), [got[at[i] : at[i + 1]].tobytes() for i in some])

    return run


def _cut(batch: _Batch, replies: dict, buckets: int) -> pa.Table:
    """doc_id, n_bytes, spans and kept bytes of each text."""
    p = batch.pieces(replies, buckets)
    n = len(batch.data)
    cover = np.zeros(n + 1, np.int32)
    if len(p["first"]):
        cut = _cuts(p["anchor"], buckets)
        told = [(cut[b][0], np.frombuffer(x, _FIRST)) for b, x in replies.get(3, [])]
        first = np.concatenate([x for _, x in told]) if told else np.zeros(0, _FIRST)
        piece = np.concatenate([x["i"] + base for base, x in told]) if told else np.zeros(0, np.int64)
        lead = p["chosen"]
        silent = np.ones(len(lead), bool)
        silent[piece] = False
        row = batch.row[p["first"][lead]]
        own = np.empty(int(silent.sum()), _FIRST)
        own["j"], own["count"], own["doc"] = 0, p["count"][lead][silent], batch.docs[row][silent]
        own["start"] = (batch.starts[p["first"][lead]] - batch.offsets[row])[silent]
        first, piece = np.concatenate([first, own]), np.concatenate([piece, np.flatnonzero(silent)])
        by = np.argsort(piece, kind="stable")
        first, piece = first[by], piece[by]
        at = np.searchsorted(piece, np.arange(len(lead) + 1))
        k = at[p["which"] + 1] - at[p["which"]]
        e = np.cumsum(k)
        r = first[np.arange(int(e[-1])) + np.repeat(at[p["which"]] - (e - k), k)]
        begin = np.repeat(batch.starts[p["first"]], k)
        row = np.repeat(batch.row[p["first"]], k)
        doc, start = batch.docs[row], begin - batch.offsets[row]
        late = (r["doc"] < doc) | ((r["doc"] == doc) & (r["start"] - r["j"] < start))
        x, y = (begin + r["j"])[late], (begin + r["j"] + r["count"] - 1 + batch.length)[late]
        cover += np.bincount(x, minlength=n + 1).astype(np.int32) - np.bincount(y, minlength=n + 1).astype(np.int32)
    gone = np.cumsum(cover[:n]) > 0
    edge = np.zeros(n + 1, bool)
    edge[batch.offsets] = True
    turn = np.flatnonzero(gone & (np.append(False, ~gone[:-1]) | edge[:n]))
    stop = np.flatnonzero(gone & (np.append(~gone[1:], True) | edge[1:])) + 1
    per = np.searchsorted(turn, batch.offsets)
    base = np.repeat(batch.offsets[:-1], np.diff(per))
    spans = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays([pa.array(turn - base), pa.array(stop - base)], names=["start", "end"]))
    kept = np.append(0, np.cumsum(~gone))[batch.offsets]
    return pa.table({"doc_id": batch.ids, "n_bytes": pa.array(np.diff(batch.offsets)), "spans": spans, "kept": blob_column(batch.data[~gone], kept)})


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of documents (doc_id, text): removed runs [start, end) and the other bytes."""
    if length < ANCHOR:
        raise ValueError(f"length has to be {ANCHOR} at least")
    work = Scratch(documents.sparkSession, "suffix")
    total = input_bytes(documents, "text")
    batches, buckets = max(LEAST_BATCHES, -(-total // BATCH)), max(LEAST_BATCHES, -(-total // BUCKET))
    # Which batch a row is in changes no result, so rows that repeat an id, or have none, are spread as well.
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(batches)).alias("batch")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(place, "doc_id", "text").groupBy("batch")

    def deal(key: tuple, rows: pa.Table) -> pa.Table:
        """The batch as one row, and the anchors that it asks for."""
        number, rows = key[0].as_py(), rows.select(["doc_id", "text"])
        return pa.concat_tables([_batch_row(number, rows), _ask(number, _Batch(rows, length).runs()[2], buckets, 1)])

    def often(key: tuple, rows: pa.Table, calls: pa.Table) -> pa.Table:
        if not rows.num_rows or not calls.num_rows:
            return _calls(2, [], [], [])
        batch = _read_batch(rows, length)
        first, end, anchor = batch.runs()
        _, where, said = batch.asked(anchor, _said(calls)[1], buckets)
        found = batch.starts[batch.frequent(first, end, said[where])]
        return _ask(key[0].as_py(), batch.hashed(found, found + length), buckets, 2)

    def pieces(key: tuple, rows: pa.Table, calls: pa.Table) -> pa.Table:
        if not rows.num_rows or not calls.num_rows:
            return _calls(3, [], [], [])
        return _send_pieces(key[0].as_py(), _read_batch(rows, length), _said(calls), buckets)

    def cut(key: tuple, rows: pa.Table, calls: pa.Table) -> pa.Table:
        return _cut(_read_batch(rows, length), _said(calls), buckets)

    dealt = work.table(texts.applyInArrow(deal, _CALL), "dealt", by="kind")
    packed = dealt.where("kind = 0").groupBy("batch")
    one = work.table(dealt.where("kind = 1").groupBy("bucket").applyInArrow(_tell_counts(1, FREQUENT), _CALL), "repeated")
    work.drop_part(dealt, "kind=1")
    two = packed.cogroup(one.groupBy("batch")).applyInArrow(often, _CALL)
    two = work.table(two.groupBy("bucket").applyInArrow(_tell_counts(2, 2**62), _CALL), "frequent")
    said = one.unionByName(two)
    three = packed.cogroup(said.groupBy("batch")).applyInArrow(pieces, _CALL)
    three = work.table(three.groupBy("bucket").applyInArrow(_find_first(length), _CALL), "first")
    said = said.unionByName(three)
    return packed.cogroup(said.groupBy("batch")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digests(out: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
