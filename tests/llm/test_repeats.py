"""Suffix-array dedup: the index kernels, the steps without Spark on small batches, and the operator against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bwt
from siltstone.llm import suffix_dedup as S
from siltstone.llm.common import table

L = 100


def brute(rows, length=L):
    seen, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in rows:  # first places
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            place = (i is None, i or 0, s)
            w = b[s : s + length]
            if w not in seen or place < seen[w]:
                seen[w] = place
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (i is None, i or 0, s):
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def by_hand(rows, batches=5, buckets=4, frequent=3):
    """The operator's steps, without Spark."""
    whole = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    parts = {i: whole.filter(pa.array([(r[0] or 0) % batches == i for r in rows])) for i in range(batches)}
    parts = {i: p for i, p in parts.items() if p.num_rows}

    def reduce(calls, fn):
        all_ = pa.concat_tables(calls)
        where = all_.column("bucket").to_pylist()
        out = [fn((pa.scalar(b),), all_.filter(pa.array([x == b for x in where]))) for b in sorted(set(where))]
        return pa.concat_tables(out) if out else S._calls(1, [], [], [])

    def told(calls, i):
        return S._said(calls.filter(pa.array([x == i for x in calls.column("batch").to_pylist()], pa.bool_())))

    read = lambda i, p: S._read_batch(S._batch_row(i, p), L)
    one = reduce([S._ask(i, S._Batch(p, L).runs()[2], buckets, 1) for i, p in parts.items()], S._tell_counts(1, frequent))
    two = []
    for i, p in parts.items():
        b = read(i, p)
        first, end, anchor = b.runs()
        _, where, said = b.asked(anchor, told(one, i).get(1, []), buckets)
        found = b.starts[b.frequent(first, end, said[where])]
        two.append(S._ask(i, b.hashed(found, found + L), buckets, 2))
    said = pa.concat_tables([one, reduce(two, S._tell_counts(2, 2**62))])
    three = reduce([S._send_pieces(i, read(i, p), told(said, i), buckets) for i, p in parts.items()], S._find_first(L))
    said, out = pa.concat_tables([said, three]), []
    for i, p in parts.items():
        got = S._cut(read(i, p), told(said, i), buckets)
        for d, n, s, k in zip(*(got.column(c).to_pylist() for c in ("doc_id", "n_bytes", "spans", "kept")), strict=True):
            out.append((d, n, sum(x["end"] - x["start"] for x in s), len(s), hashlib.sha256(k).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(20))
def test_lcp(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 4 if seed % 3 else 2, rng.integers(1, 300)), 0).astype(np.uint16)
    depth = int(rng.integers(2, 14))
    order = bwt.suffix_order(text, depth)
    s = bytes(text.astype(np.uint8))
    share = [next((k for k in range(depth) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or not s[a + k : a + k + 1]), depth) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert bwt.common_prefixes(text, order, depth).tolist() == [0, *share]
    assert all(s[a : a + depth] <= s[b : b + depth] for a, b in zip(order[:-1], order[1:], strict=True))


@pytest.mark.parametrize(("frequent", "index"), [(3, 500), (1000, 1 << 18), (1, 1)])
def test_steps(frequent, index, monkeypatch):
    monkeypatch.setattr(S, "INDEX", index)
    monkeypatch.setattr(S, "PART", index)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    passage = " ".join(words[:40])
    rows = [(i, " ".join(rng.choice(words, 20)) + (passage[i % 7 :] if i % 3 else passage[: 90 + i]) + " ".join(rng.choice(words, 9))) for i in range(60)]
    rows += [(70 + i, "".join(rng.choice(list("ab"), 250))) for i in range(10)]
    rows += [(90, "x" * 700), (91, ""), (92, None), (93, "é" * 120), (94, passage), (94, passage), (None, passage), (95, "y" * 99), (96, "ab" * 300)]
    assert by_hand(rows, frequent=frequent) == brute(rows)


def test_operator(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    extra = spark.createDataFrame([(None, rows[0][1]), (10_001, None), (10_002, ""), (10_003, "z" * 5000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).withColumns({"batch": F.lit(1), "bucket": F.lit("x"), "data": F.lit(2)})
    got = sorted((tuple(r) for r in S.digests(S.remove_repeats(both)).collect()), key=str)
    assert got == brute(rows + [tuple(r) for r in extra.collect()])
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_buckets_are_even(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text").toArrow()
    hashes = np.unique(S._Batch(docs, L).runs()[2])
    for buckets in (64, 15_000):
        sizes = np.array([y - x for x, y in S._cuts(hashes, buckets).values()])
        assert sizes.sum() == len(hashes) and sizes.max() < 4 * len(hashes) / buckets
    assert len(S._cuts(hashes[:10], 1 << 31)) <= 10  # no work for buckets that are empty


def test_many_of_one_id(spark):
    """Rows that repeat an id or have none are spread over batches and keep their defined order."""
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300))
    rows = [(None, text)] * 30 + [(5, text)] * 30 + [(6, text + "tail")]
    got = sorted((tuple(r) for r in S.digests(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()), key=str)
    assert got == brute(rows)
