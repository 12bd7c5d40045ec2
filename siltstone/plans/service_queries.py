"""Chunk dispatch, ingest, messages, completions, captures, agent answers and catalogue rows, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as fx
from siltstone.operators import chunking, dense, fusion, html, messages
from siltstone.operators import text as op
from siltstone.operators.context import PREFIX
from siltstone.plans.text_queries import _WINDOWS, TRIM
from siltstone.sources.tables import cut, spread, table

PROVENANCE = ("source", "lang")


def chunk_dispatch(spark, sf):
    """Each document cut by the strategy that its text gets."""
    kind = F.element_at(F.array(*map(F.lit, ("text", "zim", "pdf", "corpus_jsonl"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", kind.alias("kind"), F.lit("a.txt").alias("path"), "text")
    out = chunking.chunks(docs)
    return out.select("doc_id", "strategy", F.size("chunks").cast("long").alias("n_chunks"), F.md5(F.array_join("chunks", "\x1e")).alias("chunks_md5"))


def chunk_tokens(spark, sf):
    """The token strategy alone: windows of words, small ones merged."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(chunking.word_windows(F.col("text"), 512, 64)).alias("chunk")).select("doc_id", F.md5("chunk").alias("chunk_md5"))


def ingest_chunks(spark, sf):
    """Conversations as pdf files whose turns are pages, documents as text files and records, to chunks with titles, prefixes and ids."""
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit(".pdf")).alias("path"), F.lit("pdf").alias("kind"), F.col("turn").alias("part"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.concat(F.lit("C"), F.col("conv_id"), F.lit(" (p. "), F.col("turn") + 1, F.lit(")")).alias("title"), F.lit("").alias("prefix"))
    record = F.col("doc_id") % 2 == 0
    prefix = F.when(record, op.chunk_prefix(F.lit(None).cast("string"), F.concat(F.lit("["), F.col("source"), F.lit("]")), F.col("lang"), F.lit(2020), F.array(F.lit("prose")))).otherwise("")
    docs = spread(table(spark, sf, "documents")).select(F.concat(F.lit("d"), F.col("doc_id"), F.when(record, ".jsonl").otherwise(".txt")).alias("path"), F.when(record, "corpus_jsonl").otherwise("text").alias("kind"), F.lit(0).cast("long").alias("part"), "text", F.concat(F.lit("D"), F.col("doc_id")).alias("title"), prefix.alias("prefix"))
    out = chunking.ingest(turns.unionByName(docs))
    return out.select("path", "part", "chunk_idx", "title", F.length("chunk").cast("long").alias("chars"), "point_id")


def sanitize_messages(spark, sf):
    """Conversations behind a system message that a proxy wrote into, by id: with context, with memory, with either and words of its own, empty."""
    system = F.element_at(F.array(F.lit(f"{PREFIX}some context"), F.lit(f"{messages.MEMORY_PREFIX}notes\n\nBe brief."), F.lit(f"{PREFIX}x\n\n{messages.MEMORY_PREFIX}y\n\n Be kind. "), F.lit("  "), F.lit("Plain.")), (F.col("conv_id") % 5 + 1).cast("int"))
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("ts"))
    sent = F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    out = turns.select("conv_id", messages.clean(sent).alias("m"))
    return out.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(":"), F.coalesce(x["content"], F.lit("")))), "\n")).alias("sent_md5"))


#: What is left of the five system messages: the text behind the context's block has no blank line; memory's block ends at its first one.
MESSAGES_SQL = """
WITH t AS (SELECT conv_id, count(*) AS n, string_agg(coalesce(role, '') || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
s AS (SELECT *, CASE conv_id % 5 WHEN 1 THEN 'Be brief.' WHEN 2 THEN 'Be kind.' WHEN 4 THEN 'Plain.' END AS own FROM t)
SELECT conv_id, n + CASE WHEN own IS NULL THEN 0 ELSE 1 END AS n, md5(CASE WHEN own IS NULL THEN '' ELSE 'system:' || own || chr(10) END || said) AS sent_md5 FROM s
"""


def _bodies(spark, sf):
    """Assistant turns as response bodies of five kinds by turn id: events, one JSON, JSON lines, broken, and on a path that is no chat."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t"), "conv_id")
    kind = F.col("id") % 5
    j = lambda c, name: F.to_json(F.struct(c.alias(name)))
    half = (F.length("t") / 2).cast("int")
    a, b = F.substring(F.col("t"), F.lit(1), half), F.substring(F.col("t"), half + 1, F.length("t"))
    delta = lambda c: F.concat(F.lit('data: {"choices": [{"delta": '), j(c, "content"), F.lit("}]}\n\n"))
    call = lambda i, x: F.lit(f'data: {{"choices": [{{"delta": {{"tool_calls": [{{"index": {i}, "id": "c{i}", "function": {{"name": "f{i}", "arguments": "{x}"}}}}]}}}}]}}\r\n')
    events = F.concat(F.lit(": ping\n"), delta(a), call(1, "[1"), call(0, "{}"), call(1, ", 2]"), delta(b), F.lit('data: {"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"total_tokens": 7}}\ndata: [DONE]\n'))
    whole = F.concat(F.lit('{"choices": [{"finish_reason": "length", "message": '), j(F.col("t"), "content"), F.lit("}]}"))
    line = lambda c: F.concat(F.lit('{"message": '), j(c, "content"), F.lit(', "done": false}\n'))
    lines = F.concat(line(a), line(b), F.lit('{"done": true}'))
    body = F.when(kind == 0, events).when(kind == 1, whole).when(kind == 2, lines).when(kind == 3, F.lit("data: {oops\n")).otherwise(F.lit("{}"))
    path = F.when(kind == 2, "api/chat/").when(kind == 4, "v1/embeddings").otherwise("v1/chat/completions")
    return rows.select("id", "conv_id", "t", path.alias("path"), body.alias("body"), (kind != 1).alias("stream"))


def parse_completions(spark, sf):
    out = _bodies(spark, sf).select("id", messages.parsed(F.col("path"), F.col("body"), F.col("stream")).alias("p"))
    calls = F.array_join(F.transform("p.tool_calls", lambda c: F.concat_ws(" ", c["id"], c["name"], c["arguments"])), ";")
    return out.select("id", F.col("p.content").alias("content"), calls.alias("calls"), F.col("p.finish_reason").alias("finish_reason"), F.col("p.usage").alias("usage"), F.col("p.error").alias("error"))


PARSE_SQL = """
SELECT conv_id * 1000 + turn AS id, CASE WHEN k < 3 THEN coalesce(text, '') END AS content, CASE WHEN k = 0 THEN 'c0 f0 {};c1 f1 [1, 2]' ELSE '' END AS calls, CASE k WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'stop' END AS finish_reason,
  CASE WHEN k = 0 THEN '{"total_tokens":7}' END AS usage, CASE k WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'unsupported chat path: v1/embeddings' END AS error
FROM (SELECT *, (conv_id * 1000 + turn) % 5 AS k FROM conversations WHERE role = 'assistant')
"""


def capture_records(spark, sf):
    """What is kept of each answered request: record types with their size and a few fields."""
    asked = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query_text"))
    sent = F.array(F.struct(F.lit("user").alias("role"), F.col("query_text").alias("content")))
    hits = F.array(F.struct(F.col("id").cast("string").alias("id"), F.lit(0.123456).alias("score"), F.lit("src1").alias("source"), F.repeat(F.lit("word "), F.lit(200)).alias("text")))
    requests = _bodies(spark, sf).join(asked, "conv_id").select(
        F.col("id").cast("string").alias("trace_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit("2024-01-01T00:00:00Z").alias("ts"), "path", "stream", F.lit("m").alias("model"), "query_text",
        F.lit(None).cast("string").alias("retrieval_query"), sent.alias("messages"), hits.alias("hits"), "body",
    )
    out = messages.capture(requests)
    field = lambda p: F.get_json_object("record", p)
    return out.select("trace_id", "record_type", field("$.path").alias("path"), field("$.hits[0].score").alias("score"), F.length(field("$.hits[0].text_preview")).cast("long").alias("preview"), F.coalesce(field("$.qa_pair.answer"), field("$.assistant.content")).alias("answer"), field("$.parse_error").alias("error"))


CAPTURE_SQL = f"""
WITH q AS (SELECT conv_id, max_by(text, turn) AS query_text FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT *, (conv_id * 1000 + turn) % 5 AS k, {TRIM.format("query_text")} AS q FROM conversations JOIN q USING (conv_id) WHERE role = 'assistant'),
c AS (SELECT *, CASE WHEN k < 3 THEN coalesce(text, '') END AS content, CASE k WHEN 2 THEN 'api/chat' WHEN 4 THEN 'v1/embeddings' ELSE 'v1/chat/completions' END AS path, CASE k WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'unsupported chat path: v1/embeddings' END AS error, lower(q[1:400]) AS head FROM b)
SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS trace_id, 'rag_turn' AS record_type, path, '0.123' AS score, CAST(300 AS BIGINT) AS preview, CASE WHEN query_text <> '' AND content <> '' THEN content END AS answer, error FROM c
UNION ALL SELECT CAST(conv_id * 1000 + turn AS VARCHAR), 'finetune_turn', path, NULL, NULL, content, NULL FROM c
WHERE error IS NULL AND q <> '' AND {TRIM.format("content")} <> '' AND NOT (starts_with(head, '### task:') OR (contains(head, 'follow-up') AND contains(head, 'suggest')) OR contains(head, 'relevant follow-up questions'))
"""


def _near(spark, sf):
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return points, points.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def agent_context(spark, sf):
    """Passages above 0.9 of each query, at most five, as one text; queries without any say so."""
    points, asks = _near(spark, sf)
    hits = dense.top(dense.scores(points, asks).where("score > 0.9 AND query_id <> id"), 5)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    rows = hits.join(docs, "id", "left").select("query_id", "rank", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Doc "), F.col("id"))).alias("title"), "source", F.round("score", 3).alias("score"), F.lit("dense").alias("retrieval"), F.coalesce("lang", F.lit("")).alias("text"))
    return messages.for_agent(asks.select("query_id"), rows)


_COS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.id AS query_id, v.id, list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))) AS score FROM v CROSS JOIN v q WHERE q.id % 100 = 0)"
AGENT_SQL = f"""
WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0.9 AND query_id <> id),
h AS (SELECT query_id, rank, '### [' || rank || '] ' || CASE WHEN r.id % 2 = 0 THEN 'Doc ' || r.id ELSE 'Untitled' END || ' (score ' || printf('%.3f', round(score, 3)) || ', dense)' || chr(10) || 'Source: `' || coalesce(nullif(source, ''), 'unknown') || '`' || chr(10) || chr(10) || coalesce(lang, '') || chr(10) AS one
  FROM r LEFT JOIN documents d ON d.doc_id = r.id WHERE rank <= 5),
g AS (SELECT query_id, 'Found ' || count(*) || ' passage(s):' || chr(10) || chr(10) || string_agg(one, chr(10) ORDER BY rank) AS shown FROM h GROUP BY query_id)
SELECT v.id AS query_id, coalesce(shown, '{messages.NOTHING_FOUND}') AS shown FROM v LEFT JOIN g ON g.query_id = v.id WHERE v.id % 100 = 0
"""


def fact_search(spark, sf):
    """Vectors as facts, documents of the same number as their passages."""
    best = dense.nearest(*_near(spark, sf), 5)
    facts = table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact"), F.concat(F.lit("("), F.col("label"), F.lit(", has, "), F.col("vec_id"), F.lit(")")).alias("triple"))
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("fact"), F.col("doc_id").alias("position"), "text")
    out = messages.fact_hits(best.select("query_id", F.col("id").alias("fact"), "score"), facts, docs, 5, 2000)
    return out.select("query_id", "fact", F.col("rank").cast("long"), F.round("score", 6).alias("score"), "text")


FACT_SQL = f"""
WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0), p AS (SELECT doc_id % 50 AS fact, min_by(text[1:2000], doc_id) AS excerpt FROM documents GROUP BY 1)
SELECT query_id, id AS fact, rank, round(score, 6) AS score, '(' || label || ', has, ' || vec_id || ')' || CASE WHEN {TRIM.format("excerpt")} <> '' THEN chr(10) || chr(10) || {TRIM.format("excerpt")} ELSE '' END AS text
FROM r JOIN embeddings ON vec_id = id LEFT JOIN p ON p.fact = id WHERE rank <= 5
"""


def embed_inputs(spark, sf):
    """Queries keep their end, documents their beginning, and a key for a cache of vectors."""
    t = fx.trimmed("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(F.right(t, F.lit(400))).alias("query_md5"), F.md5(F.left(t, F.lit(400))).alias("document_md5"), F.sha2(t, 256).alias("cache_key"))


def slim_payloads(spark, sf):
    """The first text field that is not empty, what tells where a chunk is from, and its age; rows without text go."""
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("p "), F.col("lang"))).alias("page_content"), *PROVENANCE)
    kept = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.when(F.col("page_content") != "", F.col("page_content")))
    return rows.select("doc_id", F.md5(kept).alias("text_md5"), F.when(F.col("text") != "", "text").otherwise("page_content").alias("field"), *PROVENANCE).where("text_md5 IS NOT NULL")


def page_numbers(spark, sf):
    """A page's number from its title, from its pager, else from the manifest's address."""
    page = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<TITLE>Page  "), F.col("page_id"), F.lit(" - x</TITLE>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<i class="b-pager-active"> '), F.col("page_id"), F.lit(" <"))).otherwise(F.col("html"))
    address = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?page="), F.col("page_id") * 2)).otherwise(""))
    rows = table(spark, sf, "pages").select("page_id", page.alias("h"), address.alias("u"))
    got = lambda c, p: F.when(F.regexp_extract(c, p, 1) != "", F.regexp_extract(c, p, 1)).cast("long")
    return rows.select("page_id", F.coalesce(got("h", r"(?i)<title[^>]*>\s*Page\s+(\d+)\s*-"), got("h", r"(?i)b-pager-active[^>]*>\s*(\d+)\s*<"), got("u", r"[?&]page=(\d+)"), F.lit(1).cast("long")).alias("page_no"))


def hit_rows(spark, sf):
    """Search answers as JSON, to rows: hits without an id go, answers of another form give none."""
    hit = F.when(F.col("event_id") % 4 == 0, F.lit("{}")).otherwise(F.format_string('{"id": %d, "score": %.2f}', F.col("event_id"), F.col("value")))
    body = F.when(F.col("event_id") % 7 == 0, F.lit('{"results": "none"}')).otherwise(F.concat(F.lit('{"results": ['), hit, F.lit(', {"id": "x"}]}')))
    found = F.from_json(F.get_json_object(body, "$.results"), "array<struct<id:string,score:double>>")
    rows = table(spark, sf, "events").select("event_id", F.explode(found).alias("h")).where("h.id IS NOT NULL")
    return rows.select("event_id", F.col("h.id").alias("id"), F.coalesce("h.score", F.lit(0.0)).alias("score"))


def sanitize_compare(spark, sf):
    """Characters that the flat strip and the sanitiser keep of each page."""
    pages = spread(table(spark, sf, "pages").select("page_id", "url", "html"))
    flat = pages.select("page_id", F.length(op.strip_tags("html")).cast("long").alias("flat_chars"))
    return html.sanitize_pages(pages).select("page_id", F.coalesce("text_chars", F.lit(0)).alias("clean_chars")).join(flat, "page_id").withColumn("delta", F.col("flat_chars") - F.col("clean_chars"))


#: Patterns of a name and the tier they tell, in order (fixed values of the capacity plan, as far as they are used here).
TIERS = [("h100", "high"), ("a100", "high"), ("v100", "high"), ("4090", "high"), ("3080", "high"), ("4070", "mid"), ("a4000", "mid"), ("a2000", "low"), ("3060", "low"), ("t4", "low")]
GPUS = ["NVIDIA A100-SXM4", "GeForce RTX 4070 Ti", "RTX A2000", "Tesla T4", "Tesla V100-PCIE", "unknown", ""]


def gpu_tiers(spark, sf):
    rules = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(TIERS)], "pos int, pattern string, tier string")
    names = table(spark, sf, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, GPUS)), (F.col("s_suppkey") % len(GPUS) + 1).cast("int")).alias("name"))
    hits = names.join(F.broadcast(rules), F.contains(F.lower("name"), "pattern")).groupBy("s_suppkey").agg(F.min_by("tier", "pos").alias("tier"))
    return names.join(hits, "s_suppkey", "left").select("s_suppkey", F.coalesce("tier", F.lit("mid")).alias("tier"))


def _tiers_sql() -> str:
    rules = ", ".join(f"({i}, '{p}', '{t}')" for i, (p, t) in enumerate(TIERS))
    names = ", ".join(f"'{n}'" for n in GPUS)
    return f"WITH n AS (SELECT s_suppkey, lower([{names}][s_suppkey % {len(GPUS)} + 1]) AS name FROM supplier), h AS (SELECT s_suppkey, min_by(tier, pos) AS tier FROM n JOIN (VALUES {rules}) r(pos, pattern, tier) ON contains(name, pattern) GROUP BY s_suppkey) SELECT s_suppkey, coalesce(tier, 'mid') AS tier FROM n LEFT JOIN h USING (s_suppkey)"


def pending_downloads(spark, sf):
    """The five that have waited longest."""
    rows = table(spark, sf, "orders").where("o_orderstatus IN ('O', 'P')").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return rows.orderBy("updated_at", "id").limit(5)


def check_updates(spark, sf):
    """Local copies against what the catalogue says: missing, of another size or of another date; null tells nothing."""
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    local = part.where("p_partkey % 6 <> 0").select("p_partkey", (F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("p_partkey") % 8 != 0, "old").alias("seen"))
    both = part.select("p_partkey", F.col("p_size").alias("remote_size"), F.when(F.col("p_partkey") % 9 == 0, "new").otherwise("old").alias("modified")).join(local, "p_partkey", "left")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    why = F.when(F.col("size").isNull(), "missing").when(differs("size", "remote_size"), "size").when(differs("seen", "modified"), "date")
    return both.select("p_partkey", why.alias("why")).where("why IS NOT NULL")


def dashboard_stats(spark, sf):
    docs, vecs = table(spark, sf, "documents").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")), table(spark, sf, "embeddings").agg(F.count("*").alias("points"))
    return docs.crossJoin(F.broadcast(vecs)).select("docs", "chars", "points", F.format_string("%,d indexed · %,d corpus chunks", "docs", "points").alias("shown"))


def archive_items(spark, sf):
    """Search answers of an archive: items with a title (the identifier without one) and a size if it is a number, and a last row for the next page."""
    row = F.format_string('{"identifier": "%s", "title": "%s", "item_size": "%s"}', F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("i"), F.col("event_id"))), F.when(F.col("event_id") % 2 == 0, "T").otherwise(""), F.when(F.col("event_id") % 3 == 0, "12").otherwise("?"))
    body = F.concat(F.lit('{"response": {"numFound": 51, "docs": ['), row, F.lit("]}}"))
    found = F.from_json(body, "struct<response:struct<numFound:long,docs:array<struct<identifier:string,title:string,item_size:string>>>>")["response"]
    rows = table(spark, sf, "events").select("event_id", found.alias("r")).select("event_id", "r.numFound", F.explode("r.docs").alias("d")).where("d.identifier <> ''")
    items = rows.select("event_id", F.coalesce(fx.none_if_blank("d.title"), F.col("d.identifier")).alias("name"), F.concat(F.lit("item/"), F.col("d.identifier")).alias("href"), F.when(F.col("d.item_size").rlike(r"^\d+$"), F.col("d.item_size").cast("long")).alias("size"))
    more = table(spark, sf, "events").where("event_id % 100 = 0").select("event_id", F.lit("[Next page]").alias("name"), F.lit("page/2").alias("href"), F.lit(None).cast("long").alias("size"))
    return items.unionByName(more)


def file_titles(spark, sf):
    """Titles from file names, and the titles and sources of corpus records by what they have."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Cite "), F.col("doc_id"))).alias("citation"), F.when(F.col("doc_id") % 3 == 0, "lang").alias("title"), F.when(F.col("doc_id") % 5 == 0, "p").alias("path"), F.when(F.col("doc_id") % 7 == 0, "http://x").alias("source_url"))
    named = docs.withColumn("file", F.concat(F.lit("in/the_bOOK-of_"), F.col("doc_id"), F.lit("th don't.txt")))
    out = op.title_and_source(named.withColumn("doc_id", F.col("doc_id").cast("string")), F.col("file"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return out.select(F.col("doc_id").cast("long"), "chunk_title", "chunk_source", fx.title_case(F.replace(stem, F.lit("_"), F.lit(" "))).alias("file_title"))


TITLES_SQL = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Cite ' || doc_id WHEN doc_id % 3 = 0 THEN 'lang' WHEN doc_id % 5 = 0 THEN 'p' ELSE 'the_bOOK-of_' || doc_id || 'th don''t' END AS chunk_title,
  CASE WHEN doc_id % 7 = 0 THEN 'http://x' ELSE CAST(doc_id AS VARCHAR) END AS chunk_source, 'The Book-Of ' || doc_id || 'Th Don''T' AS file_title FROM documents
"""


def reranked(spark, sf):
    """Dense hits in the order of verdicts; those that no verdict came for keep their order behind."""
    hits = cut(dense.nearest(*_near(spark, sf), 8).select("query_id", "id", "rank"))
    judged = hits.where("id % 3 <> 0").select("query_id", "id", F.pmod(F.col("id") * 7, F.lit(11)).alias("verdict"))
    return fusion.rerank(hits, judged, 5).select("query_id", "id", F.col("reranked").cast("long").alias("place"))


RERANK_SQL = f"""
WITH {_COS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 8),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 3 <> 0 THEN id * 7 % 11 END DESC NULLS LAST, rank) AS place FROM h) SELECT * FROM r WHERE place <= 5
"""


def failed_latest(spark, sf):
    """The last eight failures, and how many there are of each kind."""
    rows = table(spark, sf, "events").where("event_type = 'error'")
    n = rows.groupBy("event_type").agg(F.count("*").alias("all"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(8).join(F.broadcast(n), "event_type").select("event_id", "user_id", "all")


_T = TRIM.format("text")
QUERIES = {
    "chunk_dispatch": (chunk_dispatch, None),
    "chunk_tokens": (chunk_tokens, f"WITH {_WINDOWS} SELECT doc_id, md5(chunk) AS chunk_md5 FROM chunks"),
    "ingest_chunks": (ingest_chunks, None),
    "sanitize_messages": (sanitize_messages, MESSAGES_SQL),
    "parse_completions": (parse_completions, PARSE_SQL),
    "capture_records": (capture_records, CAPTURE_SQL),
    "agent_context": (agent_context, AGENT_SQL),
    "fact_search": (fact_search, FACT_SQL),
    "embed_inputs": (embed_inputs, f"SELECT doc_id, md5(right({_T}, 400)) AS query_md5, md5(left({_T}, 400)) AS document_md5, sha256({_T}) AS cache_key FROM documents"),
    "slim_payloads": (slim_payloads, "SELECT doc_id, md5(CASE WHEN t <> '' THEN t ELSE p END) AS text_md5, CASE WHEN t <> '' THEN 'text' ELSE 'page_content' END AS field, source, lang FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text END AS t, CASE WHEN doc_id % 3 < 2 THEN 'p ' || lang END AS p FROM documents) WHERE coalesce(nullif(t, ''), p) IS NOT NULL"),
    "page_numbers": (page_numbers, "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN page_id ELSE coalesce(TRY_CAST(regexp_extract(url || CASE WHEN page_id % 2 = 0 THEN '?page=' || (page_id * 2) ELSE '' END, '[?&]page=(\\d+)', 1) AS BIGINT), 1) END AS page_no FROM pages"),
    "hit_rows": (hit_rows, "SELECT event_id, CAST(event_id AS VARCHAR) AS id, round(value, 2) AS score FROM events WHERE event_id % 7 <> 0 AND event_id % 4 <> 0 UNION ALL SELECT event_id, 'x', 0.0 FROM events WHERE event_id % 7 <> 0"),
    "sanitize_compare": (sanitize_compare, None),
    "gpu_tiers": (gpu_tiers, _tiers_sql()),
    "pending_downloads": (pending_downloads, "SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 5"),
    "check_updates": (check_updates, "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'missing' WHEN p_partkey % 10 = 0 THEN 'size' ELSE 'date' END AS why FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 10 = 0 OR (p_partkey % 9 = 0 AND p_partkey % 8 <> 0)"),
    "dashboard_stats": (dashboard_stats, "SELECT docs, chars, points, format('{:,} indexed · {:,} corpus chunks', docs, points) AS shown FROM (SELECT count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents) CROSS JOIN (SELECT count(*) AS points FROM embeddings)"),
    "archive_items": (archive_items, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'i' || event_id END AS name, 'item/i' || event_id AS href, CAST(CASE WHEN event_id % 3 = 0 THEN 12 END AS BIGINT) AS size FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, '[Next page]', 'page/2', NULL FROM events WHERE event_id % 100 = 0"),
    "file_titles": (file_titles, TITLES_SQL),
    "reranked": (reranked, RERANK_SQL),
    "failed_latest": (failed_latest, "SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS \"all\" FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 8"),
}
