"""Substring dedup by super-k-mers against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import super_kmers as S

W = S.WINDOW


def brute(rows, window=W):
    seen, words = {}, [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            k, p = tuple(w[s : s + window]), (i is None, i or 0, s)
            seen[k] = min(seen.get(k, p), p)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (i is None, i or 0, s):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def planted():
    """Null, empty and short texts, one repeated word, periods, all kinds of white space, exact copies, passages in ever new surroundings, repeated rows, ids that repeat or are null or negative."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 4)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, copy = some(30), some(90)
    texts = [None, "", " \t\n", some(19), "a " * 300, "a b c " * 60, "x " * 19 + "y", "　" * 30, "\xa0 " * 40, ("z" * 400 + " ") * 25, copy.replace(" ", "\n"), copy.replace(" ", " \t "), "q" * 5000]
    texts += [copy] * 12 + [f"{some(rnd.randint(0, 25))} {passage} {some(rnd.randint(0, 25))}" for _ in range(30)] + [some(rnd.randint(0, 60)) for _ in range(80)]
    texts += [f"{passage} {passage}", some(3000)]
    rows = [(i - 20, t) for i, t in enumerate(texts)]
    return rows + [(None, copy), (None, passage + " x"), (7, texts[27]), (7, texts[27]), (7, passage + " other")]


def result(df):
    return sorted((tuple(r) for r in S.digests(df).collect()), key=str)


@pytest.mark.parametrize("most", [None, 1, 5])
def test_planted(spark, most):
    """Through buckets alone, with every repeated minimiser grouped by its windows, and with both."""
    rows = planted()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, version string, `from` int").repartition(4)
    got = S.remove_repeats(df, most=most)
    assert got.columns[:4] == ["doc_id", "text", "version", "from"]
    assert result(got) == brute(rows)


def test_other_windows_and_spans(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = S.remove_repeats(df, window=5)
    assert result(got) == brute(rows, 5)
    for r in got.collect():
        words = (r["text"] or "").encode().split()
        spans = [(x["from"], x["to"]) for x in r["removed"]]
        assert spans == sorted(spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        gone = {i for a, b in spans for i in range(a, b)}
        assert len(gone) == r["n_removed"] and r["kept"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_small_stretches_and_sorts(spark, monkeypatch):
    """Texts of many stretches, some with words longer than one, and buckets that are sorted a few keys at a time."""
    monkeypatch.setattr(S, "STRETCH", 300)
    monkeypatch.setattr(S, "SORTED_WORDS", 200)
    rows = planted()
    assert result(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == brute(rows)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_super_kmers_hold_every_window_once():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices("abc", k=n)).encode() for n in (0, 5, 19, 20, 21, 400)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows, keys = set(), {}
    for key, row, at, n, a, b in S.super_kmers(data, offsets, W):
        for k, r, s, m, x, y in zip(key, row, at, n, a, b, strict=True):
            words = data[x:y].tobytes().split()
            assert len(words) == m + W - 1 and m <= W - S.GRAM + 1
            for j in range(m):
                assert (r, s + j) not in windows
                windows.add((r, s + j))
                assert keys.setdefault(tuple(words[j : j + W]), k) == k  # equal windows, equal minimisers
                assert words[j : j + W] == texts[r].split()[s + j : s + j + W]
    assert len(windows) == sum(max(0, len(t.split()) - W + 1) for t in texts)


@pytest.mark.parametrize("window", [4, 5, 7, 16, 20, 31])
def test_window_numbers(window):
    rnd = np.random.default_rng(window)
    words = rnd.integers(0, 2, 3000)
    got = S.window_numbers(words, window)
    exact = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    assert len(got) == len(exact) and len(set(zip(got.tolist(), exact, strict=True))) == len(set(exact)) == len(set(got.tolist()))


def test_word_hash_is_of_the_word_alone():
    text = ("w" * 64 + " " + "w" * 65 + " ab ab " + "w" * 65 + " " + "w" * 64).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = S.words_of(data, np.array([0, len(data)]))
    h = S.word_hashes(data, starts, ends)
    assert h[0] == h[5] and h[1] == h[4] and h[2] == h[3] and len(set(h.tolist())) == 3
