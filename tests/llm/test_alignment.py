"""Cross-tokenizer alignment against whole texts encoded by both libraries and counted plainly."""

import collections
import hashlib
import json
import os
import random

import pytest

from siltstone.llm import alignment, queries
from siltstone.llm.common import table

A, B = queries.tokenizer_path(), queries.piece_path()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    """The byte that each printable letter of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    free = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(free)): b for b in range(256)}


def brute(libraries, rows):
    a, b = libraries
    back, vocab = letters(), {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            want = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes(back[c] for c in vocab[i]) for i in ids_a]
            parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(parts_a) == want == b"".join(parts_b):
                n = len(ids_a), len(ids_b)
                ends_a = {sum(map(len, parts_a[: k + 1])): k for k in range(len(ids_a))} if len(want) < 500 else cumulative(parts_a)
                ends_b = cumulative(parts_b)
                i = j = 0
                for end in sorted(ends_a.keys() & ends_b.keys()):
                    x, y = ends_a[end], ends_b[end]
                    links.append((ids_a[x], ids_b[y]))
                    groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
                    i, j = x + 1, y + 1
        counts.update(links)
        docs.append((doc_id, *n, links, ";".join(groups)))
    most = collections.defaultdict(int)
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return sorted(
        ((i, x, y, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, links, g in docs),
        key=str,
    )


def cumulative(parts):
    out, end = {}, 0
    for k, p in enumerate(parts):
        end += len(p)
        out[end] = k
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_registered_query(spark, sf, libraries):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_alignment(spark, sf)) == brute(libraries, docs)


def odd_rows():
    rnd = random.Random(5)
    pieces = ["a", "b", " ", "  ", ",", "'s", "\n", "\t", "é", "▁", "中", "　", "\xa0", "\x1c", "\x85", "​", "😀", "ﬁ", "\0", "<0x0A>", "</s>", "<|endoftext|>", "ing", " the", "7", "42"]
    texts = [None, "", " ", "  ", "\n", "x", "▁", "a▁b", "the " * 3000, "x" * 30000, "中" * 4000, "<|endoftext|>", " <s> ok</s>"]
    texts += ["".join(rnd.choices(pieces, k=rnd.randint(1, 16))) for _ in range(700)]
    rows = list(enumerate(texts))
    return rows + [(None, "of the the"), (None, "of the the"), (9, "other text"), (9, "other text")]


def test_odd_texts(spark, libraries):
    """Null, empty, very long, white space of all kinds, strings of special tokens, repeated rows, ids that repeat or are null, and columns of clashing names."""
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, pairs string").repartition(3)
    assert rows_of(alignment.link_counts(df, A, B)) == brute(libraries, rows)


def test_chunks_and_memo(spark, libraries, monkeypatch):
    """Many small chunks, and a memo that forgets."""
    monkeypatch.setattr(alignment, "CHUNK", 1 << 10)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 1 << 12)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    aligned = alignment.align(df, A, B, groups=True).toPandas()
    assert aligned["chunk"].nunique() > 10
    for _, chunk in aligned.groupby("chunk"):
        assert sum(p is not None for p in chunk["pairs"]) == 1
    got = {(i, hashlib.sha256(g.encode()).hexdigest() if g else "") for i, g in zip(aligned["doc_id"].astype(object).where(aligned["doc_id"].notna(), None), aligned["groups"], strict=True)}
    assert got == {(r[0], r[-1]) for r in brute(libraries, rows)}


def test_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_BYTES", 1 << 16)
    aligner = alignment.Aligner(A, B)
    list(aligner.documents([" ".join(f"w{i}" for i in range(n, n + 500)) for n in range(0, 20000, 500)] + ["字" * 5000]))
    size = lambda memo: sum(alignment.ENTRY_BYTES + 2 * len(k) + len(v[0]) + len(v[1]) for k, v in memo.items())
    assert size(aligner.new) <= (1 << 15) + 1000 and size(aligner.old) <= (1 << 15) + 1000
    assert max(map(len, aligner.new)) <= alignment.LONGEST


def test_ids_are_those_of_the_file_by_either_library(libraries):
    """The quicker library is used where it can be told the vocabulary; without it results are the same."""
    texts = [t for _, t in odd_rows()]
    one, two = alignment.Aligner(A, B), alignment.Aligner(A, B)
    assert one.ranks is not None
    two.ranks = None
    assert list(one.documents(texts)) == list(two.documents(texts))


def test_merge():
    sizes = list(range(10))
    assert alignment.merge([2, 3, 1], [1, 4, 1], sizes, sizes) == [(2, 2), (3, 3)]
    assert alignment.merge([6], [1, 2, 3], sizes, sizes) == [(1, 3)]
    assert alignment.merge([], [], sizes, sizes) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(df, A, B).collect() == []


def test_vocabulary_files_are_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not A.startswith(root) and not B.startswith(root)
