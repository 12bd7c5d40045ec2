"""Chunk dispatch and ingest against plain Python; completions and captures in cases that the tables do not hold."""

import hashlib
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, messages
from siltstone.operators import text as op
from siltstone.plans import service_queries as q
from siltstone.sources.tables import table

SIZE, OVERLAP, LEAST = chunking.SIZE, chunking.OVERLAP, chunking.LEAST


def windows(text, size, overlap=0):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]


def split(pieces, size, *ways):
    out = []
    for x in pieces:
        if len(x.split()) <= size:
            out.append(x)
        else:
            out += split([y for y in ways[0](x) if y.strip()], size, *ways[1:]) if ways else windows(x, size)
    return out


def pack(pieces, size, glue):
    out = []
    for x in pieces:
        if out and len(out[-1].split()) + len(x.split()) <= size:
            out[-1] += glue + x
        else:
            out.append(x)
    return out


def merge(pieces, least, most):
    if len(pieces) < 2:
        return pieces
    out = pieces[:1]
    for x in pieces[1:]:
        n = len(out[-1].split())
        if n < least and n + len(x.split()) <= most:
            out[-1] += "\n\n" + x
        else:
            out.append(x)
    return out


def plain_blocks(text):
    """Top-level blocks by marking the lines that begin one, after strings and comments are blanked out letter by letter."""
    lines, depth, leads, marks = text.split("\n"), 0, False, []
    for k, line in enumerate(lines):
        flat = line[:1] not in ("", " ", "\t") and line.strip() != ""
        on = re.match(r"(else|elif|except|finally|catch|end)\b", line) or line[:1] in (")", "]", "}") or re.match(r"```\s*$", line)
        marks.append(k == 0 or bool(flat and depth <= 0 and not leads and not on))
        if line.strip():
            leads = bool(flat and depth <= 0 and line.startswith(("@", "#", "//", "/*", "*", "--")))
            bare = re.sub(r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|(?:#|//).*""", lambda m: " " * len(m[0]), line)
            for c in bare:
                depth += (c in "([{") - (c in ")]}")
            depth = max(depth, 0)
    at = [k for k, m in enumerate(marks) if m] + [len(lines)]
    out = ["\n".join(lines[a:b]).strip("\n") for a, b in zip(at, at[1:], strict=False)]
    return [x for x in out if x.strip()]


def brute(strategy, text, cleaned, size=SIZE, overlap=OVERLAP, least=LEAST):
    text = text.strip()
    by_sentence = lambda x: re.split(r"(?<=[.!?。！？])\s+", x)
    if not text:
        return []
    if strategy == "token" and cleaned:
        got = windows(cleaned, size, overlap)
    elif strategy == "code":
        parts = split(plain_blocks(text), size, lambda x: re.split(r"\n\s*\n", x), lambda x: x.split("\n"))
        got = pack(parts, size, "\n\n")
    elif strategy in ("sentence", "semantic"):
        got = pack(split([x for x in by_sentence(text) if x.strip()], size), size, " ")
    else:
        parts = split([x for x in re.split(r"\n\s*\n", text) if x.strip()], size, lambda x: x.split("\n"), by_sentence)
        got = pack([x.strip() for x in parts], size, "\n\n")
        if overlap:
            got = [x if not i else " ".join(got[i - 1].split()[-overlap:]) + "\n\n" + x for i, x in enumerate(got)]
    return merge(got, least, size)


def test_dispatch(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", op.drop_boilerplate("text").alias("cleaned")).collect()
    texts = {r["doc_id"]: (r["text"] or "", r["cleaned"]) for r in rows}
    got = q.chunk_dispatch(spark, sf).collect()
    assert len(got) == len(texts) and len({r["strategy"] for r in got}) > 2
    for r in got:
        want = brute(r["strategy"], *texts[r["doc_id"]])
        assert (r["n_chunks"], r["chunks_md5"]) == (len(want), hashlib.md5("\x1e".join(want).encode()).hexdigest()), r


@pytest.mark.parametrize(("size", "overlap", "least"), [(5, 2, 0), (7, 0, 3), (12, 4, 6)])
def test_small_sizes(spark, size, overlap, least):
    texts = ["One two three. Four five! Six seven eight nine ten eleven twelve thirteen.", "a b\n\nc d e f g h i\nj k l m n o p q r s\n\nt", "", "  \n ", "word " * 40, "x. y. z.", "# Title\n\nBody of text here. And more of it now.\n\n\n\nend"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"kind": F.lit("text"), "path": F.lit("a.md")})
    for r in chunking.chunks(df, size=size, overlap=overlap, least=least).collect():
        assert r["chunks"] == (brute(r["strategy"], r["text"], r["text"].strip(), size, overlap, least) if least else brute(r["strategy"], r["text"], r["text"].strip(), size, overlap, -1)), r


CODE = """import os
from x import (
    a,
b,
)

# About f.
# More.
@wrap
def f(x):
    s = "({[ not a bracket"  # nor here (
    if x:
        return [1,
2]

    return None
else_ = 1
try:
    g()
except E:
    pass
class C { // (
  void m() { }
}
x = {
"a": 1 }
"""


def test_top_level_blocks():
    got = chunking.top_level(CODE)
    assert [b.split("\n")[0] for b in got] == ["import os", "from x import (", "# About f.", "else_ = 1", "try:", "class C { // (", "x = {"]
    assert "\n".join(got).replace("\n", "") == CODE.replace("\n", "")
    assert chunking.top_level("") == [] and chunking.top_level("\n \n") == [] and chunking.top_level("  a\n  b") == ["  a\n  b"]
    for text in (CODE, CODE * 3, "}\n)\na\n", "(" * 50 + "\na\nb", "```\na = 1\n```\nb = 2"):
        assert chunking.top_level(text) == plain_blocks(text)
    assert len(chunking.top_level("x = 1\n" * 200_000)) == 200_000  # in proportion to the text


@pytest.mark.parametrize("size", [4, 12, 60])
def test_code_chunks(spark, size):
    texts = [f"```\n{t}\n```" for t in (CODE, CODE * 4)] + ["def f():\n" + "    y = 1\n" * 60 + "\n    z = 2\n", "x = (" + "1,\n" * 50 + ")\nimport q\nimport r\nimport s\n```\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"kind": F.lit("text"), "path": F.lit("a.py")})
    got = chunking.chunks(df, size=size, overlap=3, least=2).collect()
    assert "code" in {r["strategy"] for r in got}
    for r in got:
        assert r["chunks"] == brute(r["strategy"], r["text"], r["text"].strip(), size, 3, 2), r
        assert max(len(c.split()) for c in r["chunks"]) <= size + 3


def plain_valleys(vectors, depth=1.0):
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return None
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)

    s = [cosine(a, b) for a, b in zip(vectors, vectors[1:], strict=False)]
    known = [x for x in s if x is not None]
    if not known:
        return []
    mean = sum(known) / len(known)
    least = mean - depth * (sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5
    beside = lambda i: [x for k in (i - 1, i + 1) if 0 <= k < len(s) and (x := s[k]) is not None]
    return [i + 1 for i, x in enumerate(s) if x is not None and round(x, 9) < round(least, 9) and all(x <= y for y in beside(i))]


def test_semantic_chunks(spark):
    """Sentences of two topics by turns, with vectors, with too few of them, with null and zero ones, and without."""
    import random

    rnd = random.Random(5)
    rows = []
    for n in (1, 2, 3, 12, 40):
        topics = [(i // 4) % 2 for i in range(n)]
        text = "\n".join(f"Sentence {i} about {'cats' if t else 'rocks'} and so on." for i, t in enumerate(topics))
        vectors = [[1.0 - t + rnd.random() / 9, t + rnd.random() / 9, 0.1] for t in topics]
        rows += [(text, vectors), (text, vectors[:-1]), (text, [None if i % 5 == 2 else [0.0, 0.0, 0.0] if i % 5 == 4 else v for i, v in enumerate(vectors)]), (text, None)]
    df = spark.createDataFrame([(i, t, v, "pdf", "arxiv.pdf") for i, (t, v) in enumerate(rows)], "id long, text string, vs array<array<double>>, kind string, path string")
    split_into = 0
    for r in chunking.chunks(df, size=30, overlap=0, least=0, vectors="vs").collect():
        assert r["strategy"] == "semantic"
        parts = re.split(r"(?<=[.!?。！？])\s+", r["text"])
        starts = plain_valleys(r["vs"]) if r["vs"] is not None and len(r["vs"]) == len(parts) else []
        at = [0, *starts, len(parts)]
        want = [c for a, b in zip(at, at[1:], strict=False) for c in pack(split(parts[a:b], 30), 30, " ")]
        assert r["chunks"] == merge(want, 0, 30) if len(want) > 1 else want
        split_into += len(starts)
    assert split_into > 5


def test_ingest(spark):
    rows = [("f.pdf", "pdf", i, t, f"p{i}", "") for i, t in enumerate(["first page.\n\nlast words", " \n", "second page", None])] + [("r.jsonl", "corpus_jsonl", 0, "record text", "R", "Cited | Topics: x"), ("t.txt", "text", 0, "plain", "T", "")]
    got = [tuple(r) for r in chunking.ingest(spark.createDataFrame(rows, "path string, kind string, part long, text string, title string, prefix string")).orderBy("path", "chunk_idx").select("path", "part", "chunk_idx", "title", "chunk").collect()]
    assert got == [("f.pdf", 0, 0, "p0", "first page. last words"), ("f.pdf", 2, 1, "p2", "last words\n\nsecond page"), ("r.jsonl", 0, 0, "R", "Cited | Topics: x\n\nrecord text"), ("t.txt", 0, 0, "T", "plain")]


def test_completions(spark):
    cases = [
        ("v1/chat/completions", True, "", ("", None, None)), ("v1/chat/completions", False, '{"choices": []}', (None, None, "missing choices[0].message")), ("v1/chat/completions", False, "<html>", (None, None, "invalid JSON")),
        ("api/chat", False, '{"message": {"content": "hi"}, "done": true}', ("hi", "stop", None)), ("api/chat", False, '{"message": "no"}', (None, None, "missing message")), ("api/chat", True, "", ("", None, None)),
        ("v1/chat/completions/", True, 'data: {"choices": []}\ndata: {"choices": [{"delta": {"content": "é\\n"}}]}\nevent: x', ("é\n", None, None)), ("x", True, "", (None, None, "unsupported chat path: x")),
    ]
    df = spark.createDataFrame([(i, p, s, b) for i, (p, s, b, _) in enumerate(cases)], "i int, path string, stream boolean, body string")
    got = df.select("i", messages.parsed(F.col("path"), F.col("body"), F.col("stream")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["content"], r["p"]["finish_reason"], r["p"]["error"]) for r in got] == [c[3] for c in cases]


def test_capture_is_sampled_by_trace(spark):
    hits = F.array().cast("array<struct<id:string,score:double,source:string,text:string>>")
    sent = F.array(F.struct(F.lit("user").alias("role"), F.lit("why").alias("content")))
    df = spark.range(400).select(F.col("id").cast("string").alias("trace_id"), F.lit("c").alias("conversation_id"), F.lit("t").alias("ts"), F.lit("api/chat").alias("path"), F.lit(False).alias("stream"), F.lit("m").alias("model"), F.lit("why").alias("query_text"), F.lit(" ").alias("retrieval_query"), sent.alias("messages"), hits.alias("hits"), F.lit('{"message": {"content": "so"}}').alias("body"))
    some = {r["trace_id"] for r in messages.capture(df, 0.5).collect()}
    assert 120 < len(some) < 280 and some == {r["trace_id"] for r in messages.capture(df.repartition(3), 0.5).collect()} and messages.capture(df, 0.0).count() == 0
    records = [json.loads(r["record"]) for r in messages.capture(df.limit(1)).collect()]
    assert [r["record_type"] for r in records] == ["rag_turn", "finetune_turn"] and records[0]["qa_pair"] == {"question": "why", "answer": "so"} and records[1]["messages"] == [{"role": "user", "content": "why"}]


def test_texts_are_cut_once(spark):
    """Many chunks of one text take time in proportion; before an explode, no filter computes all chunks once more."""
    text = "".join(f"w{i} " for i in range(60_000))
    start = time.time()
    cut = spark.createDataFrame([(text, text.replace("0 ", "0\n\n"))], "a string, b string").select(chunking.word_windows(F.col("a"), 6, 1).alias("a"), chunking.recursive(F.col("b"), 6, 2).alias("b")).first()
    assert len(cut["a"]) == 12_000 and len(cut["b"]) > 6_000 and time.time() - start < 25
    files = spark.createDataFrame([("f", "text", 0, "One. Two.", "t", "")], "path string, kind string, part long, text string, title string, prefix string")
    plan = chunking.ingest(files)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]
