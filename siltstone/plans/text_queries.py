"""Queries over texts, pages and paths, each with its DuckDB form. Rules that the synthetic prose never meets also run over a literal probe table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as fx
from siltstone.operators import html
from siltstone.operators import text as op
from siltstone.sources.tables import spread, sql, table

#: Probe texts that reach every rule; the same rows are in the oracles.
PROBES = [
    "hello there", "thanks", "ok", "what is kubernetes?", "k8s node v1.2.3 failed at /etc/app/config", "please review this pr", "implement a parser", "see main.py",
    "summary of the day", "plan the roadmap", "compare a and b", "it is not working", "write a story", "step by step", "describe the sea",
    "2024-01-02 ERROR disk full", "analyze the log", "docker compose up", "terror in the night", "", "### Task: make titles", "omv on 192.168.1.36 stays",
    "use background-image { a } { b } { c } { d } here", "wombat was here", '{"@context": "schema.org"}',
]
PROBE_SQL = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PROBES)) + ") AS p(id, q)"
#: Conversation turns and the probes, as (id, q).
QUERY_SQL = f"(SELECT conv_id * 1000 + turn + 1000 AS id, text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT CAST(id AS BIGINT), q FROM {PROBE_SQL})"

TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def asked(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.col("text").alias("q"))
    return turns.unionByName(spark.createDataFrame(list(enumerate(PROBES)), "id long, q string"))


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, w.replace("'", "''").replace("\n", "' || chr(10) || '")) for w in words) + ")"


def re_sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def file_type_dispatch(spark, sf):
    extra = ["a/my_corpus.jsonl", "corpus-2026-07.jsonl", "finetune.jsonl", "notes.jsonl", "x.PDF", "b/kiwix-library.xml", "c.zim", "d.md", ".txt"]
    paths = table(spark, sf, "pages").select(F.col("url").alias("path")).unionByName(spark.createDataFrame([(p,) for p in extra], "path string"))
    return paths.select("path", op.file_type("path").alias("file_type"))


FILE_TYPE_SQL = r"""
WITH p AS (SELECT url AS path FROM pages UNION ALL SELECT * FROM (VALUES ('a/my_corpus.jsonl'), ('corpus-2026-07.jsonl'), ('finetune.jsonl'), ('notes.jsonl'), ('x.PDF'),
  ('b/kiwix-library.xml'), ('c.zim'), ('d.md'), ('.txt')) v(path)), n AS (SELECT path, string_split(path, '/')[-1] AS name FROM p)
SELECT path, CASE WHEN name = 'kiwix-library.xml' THEN 'unknown' WHEN regexp_matches(lower(name), '.\.jsonl$') AND contains(regexp_replace(lower(name), '\.[^.]*$', ''), 'corpus') THEN 'corpus_jsonl'
  WHEN regexp_matches(lower(name), '.\.zim$') THEN 'zim' WHEN regexp_matches(lower(name), '.\.(txt|md)$') THEN 'text' WHEN regexp_matches(lower(name), '.\.pdf$') THEN 'pdf' ELSE 'unknown' END AS file_type FROM n
"""


def normalize_plain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", op.normalize_plain("text").alias("plain")).where("plain IS NOT NULL")


NORMALIZE_SQL = r"SELECT doc_id, t AS plain FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) >= 80"


def delete_by_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    gone = docs.select("source").where("source IN ('src0', 'src7')").distinct()
    return docs.join(gone, "source", "left_anti").select("doc_id", "source")


def page_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<a href="([^"]*)">(.*?)</a>'), F.lit(0))).alias("pos", "a"))
    parts = pages.select("page_id", "pos", F.regexp_extract("a", r'<a href="([^"]*)">', 1).alias("href"), F.regexp_extract("a", r"(?s)>(.*?)</a>", 1).alias("name"))
    firsts = parts.groupBy("page_id", "href").agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("times"))
    return firsts.select("page_id", "href", "name", F.col("href").endswith("/").alias("is_directory"), "times")


PAGE_LINKS_SQL = r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>'), 1) AS pos FROM pages),
p AS (SELECT page_id, pos, regexp_extract(a, '<a href="([^"]*)">', 1) AS href, regexp_extract(a, '(?s)>(.*?)</a>', 1) AS name FROM a)
SELECT page_id, href, min_by(name, pos) AS name, ends_with(href, '/') AS is_directory, count(*) AS times FROM p GROUP BY page_id, href
"""


def sanitize_pages(spark, sf):
    return html.sanitize_pages(spread(table(spark, sf, "pages").select("page_id", "url", "html")))


WIKI_ROWS = [("Category:Cats", "A/Category:Cats"), ("Cat", "https://x.org/wiki/Cat"), ("Plain", "https://x.org/a"), ("User: me", "b"), ("Disuser:", "c")]


def wiki_namespace_filter(spark, sf):
    rows = table(spark, sf, "pages").select(F.lit("").alias("title"), "url").unionByName(spark.createDataFrame(WIKI_ROWS, "title string, url string"))
    return rows.select("title", "url", op.looks_like_wiki(F.col("title"), F.col("url")).alias("wiki"), op.is_wiki_namespace(F.col("title"), F.col("url")).alias("skipped"))


_NS = re_sql(op.NAMESPACE)
WIKI_SQL = f"""
WITH r AS (SELECT '' AS title, url FROM pages UNION ALL SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in WIKI_ROWS)}) v(title, url))
SELECT title, url, regexp_matches(title, '{_NS}') OR regexp_matches(url, '{_NS}') OR {any_sql("lower(title || chr(10) || url)", op.PATH_HINTS)} AS wiki,
       regexp_matches(title, '{_NS}') OR regexp_matches(url, '{_NS}') AS skipped FROM r
"""


def strip_html_flat(spark, sf):
    return table(spark, sf, "pages").select("page_id", op.strip_tags("html").alias("plain")).select("page_id", "plain", F.length("plain").cast("long").alias("chars"))


STRIP_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS plain FROM b)
SELECT page_id, plain, CAST(length(plain) AS BIGINT) AS chars FROM c
"""


def strip_markers(spark, sf):
    """Books made of documents, with one of three frames by id."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    start = F.when(F.col("doc_id") % 3 == 0, op.BOOK_START[0]).when(F.col("doc_id") % 3 == 1, op.BOOK_START[2])
    end = F.when(F.col("doc_id") % 2 == 0, op.BOOK_END[0]).otherwise(op.BOOK_END[4])
    book = F.concat(F.lit("Front matter\n"), F.coalesce(F.concat(start, F.lit(" ***\n")), F.lit("")), F.coalesce("text", F.lit("")), F.lit("\n"), end, F.lit("\nBack"))
    return docs.select("doc_id", op.between_markers(book).alias("body"))


STRIP_MARKERS_SQL = r"""
SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 2 THEN 'Front matter' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END, '^\s+|\s+$', '', 'g') AS body FROM documents
"""


def chunk_windows(spark, sf):
    cut = op.windows(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("chunk_idx").cast("long"), "chunk_id", "token_count")


_WINDOWS = r"""
w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, source, ws, unnest(range(0, len(ws), 448)) AS w0 FROM w WHERE len(ws) > 0),
chunks AS (SELECT doc_id, source, CAST(w0 / 448 AS BIGINT) AS chunk_idx, array_to_string(ws[w0 + 1 : w0 + 512], ' ') AS chunk, CAST(len(ws[w0 + 1 : w0 + 512]) AS BIGINT) AS token_count FROM s)
"""
CHUNK_SQL = f"WITH {_WINDOWS} SELECT doc_id, chunk_idx, 'chunk_' || chunk_idx || '_' || md5(chunk)[1:16] AS chunk_id, token_count FROM chunks"


def strip_boilerplate_lines(spark, sf):
    probe = spark.createDataFrame([(-1, "Keep\n\n\n\nAccept all cookies\n  Privacy policy  \nBody text\nsubscribe " + "x" * 200)], "doc_id long, text string")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).unionByName(probe).select("doc_id", op.drop_boilerplate("text").alias("cleaned"))


_BP = re_sql(op.BOILERPLATE)
BOILERPLATE_SQL = f"""
WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'Keep' || repeat(chr(10), 4) || 'Accept all cookies' || chr(10) || '  Privacy policy  ' || chr(10) || 'Body text' || chr(10) || 'subscribe ' || repeat('x', 200)),
k AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {TRIM.format("x")} = '' OR length({TRIM.format("x")}) >= 200 OR NOT regexp_matches({TRIM.format("x")}, '{_BP}')) AS ls FROM d)
SELECT doc_id, regexp_replace(regexp_replace(coalesce(array_to_string(list_transform(ls, lambda x: CASE WHEN {TRIM.format("x")} = '' THEN '' ELSE x END), chr(10)), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM k
"""

STRATEGY_ROWS = [
    ("text", "a.txt", "plain words only"), ("text", "a.md", "plain words"), ("pdf", "x/arxiv/1.pdf", "words"), ("pdf", "2401.01234v2.pdf", "words"), ("pdf", "b.pdf", "Abstract of the theorem"),
    ("pdf", "c.pdf", "words"), ("zim", "d.zim", "words"), ("corpus_jsonl", "e.jsonl", "words"), ("text", "f.txt", "```a``` b"), ("text", "g.txt", "def f(x):"), ("text", "h.txt", "# Title"),
    ("text", "i.txt", "w " * 100), ("text", "j.txt", "a\n\nb\n\nc\n\nd"), ("other", "k", "words"), ("text", "l", " "), ("text", "m", "|a|b|\n|-|-|"),
]


def chunk_strategy(spark, sf):
    probe = spark.createDataFrame([(-i - 1, *r) for i, r in enumerate(STRATEGY_ROWS)], "doc_id long, kind string, path string, text string")
    docs = spread(table(spark, sf, "documents").select("doc_id", F.lit("text").alias("kind"), F.concat("source", F.lit(".txt")).alias("path"), "text")).unionByName(probe)
    return docs.select("doc_id", op.chunk_strategy(F.col("kind"), F.col("path"), F.col("text")).alias("strategy"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


STRATEGY_SQL = f"""
WITH d AS (SELECT doc_id, 'text' AS kind, source || '.txt' AS path, text FROM documents UNION ALL SELECT * FROM (VALUES {", ".join(f"({-i - 1}, {_lit(a)}, {_lit(b)}, {_lit(c)})" for i, (a, b, c) in enumerate(STRATEGY_ROWS))}) v(doc_id, kind, path, text)),
t AS (SELECT doc_id, kind, path, {TRIM.format("text")} AS t FROM d),
l AS (SELECT *, string_split(t, chr(10)) AS ls, list_filter(string_split(t, chr(10)), lambda x: {TRIM.format("x")} <> '') AS fl, (length(t) - length(replace(t, chr(10) || chr(10), ''))) / 2 AS breaks FROM t),
m AS (SELECT *, list_sum(list_transform(fl, lambda x: length(x))) / len(fl) AS mean, len(list_filter(ls[1:120], lambda x: regexp_matches(x, '{re_sql(op.CODE_LINE)}'))) / len(ls[1:120]) AS code,
      {" + ".join(f"CAST(contains(lower(t[1:4000]), {_lit(w)}) AS INT)" for w in op.ACADEMIC)} AS marks, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM l)
SELECT doc_id, CASE WHEN t = '' OR kind = 'corpus_jsonl' THEN 'recursive' WHEN (length(t) - length(replace(t, '```', ''))) / 3 >= 2 OR code >= 0.25 THEN 'code'
  WHEN (breaks = 0 AND mean > 160) OR (breaks <= 1 AND len(fl) > 40 AND mean > 120) THEN 'token'
  WHEN ends_with(lower(path), '.md') OR regexp_matches(t, '(?m)^---\\s*\\n') OR regexp_matches(t, '(?m)^#{{1,6}}\\s+\\S') OR (regexp_matches(t, '(?m)^\\|.+\\|\\s*$') AND regexp_matches(t, '(?m)^\\|[\\s\\-:|]+\\|\\s*$')) OR breaks >= 3 THEN 'recursive'
  WHEN kind = 'pdf' AND (contains(lower(path), 'arxiv') OR regexp_matches(stem, '(?i)^\\d{{4}}\\.\\d{{4,5}}(v\\d+)?$') OR marks >= 2) THEN 'semantic'
  WHEN kind IN ('pdf', 'zim', 'text') THEN 'sentence' ELSE 'recursive' END AS strategy FROM m
"""


def merge_small_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.filter(fx.lines("text"), lambda x: fx.trimmed(x) != "").alias("pieces"))
    out = docs.withColumn("merged", op.merge_small(F.col("pieces"), 20, 120))
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.size("merged").cast("long").alias("n_merged"), F.md5(F.array_join("merged", "\x1e")).alias("merged_md5"))


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
#: A step of the recursion takes the next piece of each document: it is joined to what is held, or that is given out.
MERGE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {TRIM.format("x")} <> '') AS ps FROM documents),
p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM d), q AS (SELECT *, {_WORDS.format("piece")} AS n FROM p),
f AS (SELECT doc_id, k, piece AS held, n, CAST(NULL AS VARCHAR) AS given FROM q WHERE k = 1
  UNION ALL SELECT doc_id, k, CASE WHEN joins THEN held || chr(10) || chr(10) || piece ELSE piece END, CASE WHEN joins THEN m + n ELSE n END, CASE WHEN NOT joins THEN held END
  FROM (SELECT q.doc_id, q.k, q.piece, q.n, f.held, f.n AS m, f.n < 20 AND f.n + q.n <= 120 AS joins FROM f JOIN q ON q.doc_id = f.doc_id AND q.k = f.k + 1)),
g AS (SELECT doc_id, k, given AS chunk FROM f WHERE given IS NOT NULL UNION ALL SELECT doc_id, max(k) + 1, max_by(held, k) FROM f GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, string_agg(chunk, chr(30) ORDER BY k) AS merged FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_pieces, coalesce(n, 0) AS n_merged, md5(coalesce(merged, '')) AS merged_md5 FROM d LEFT JOIN m USING (doc_id)
"""


def page_carry(spark, sf):
    """The last paragraph of the previous turn that is not blank goes before each turn, as pages of a file carry over."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    pages = table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = pages.withColumn("carry", F.last(op.last_paragraph("text"), ignorenulls=True).over(w))
    return out.select("conv_id", "turn", "carry", F.length(F.concat_ws("\n\n", "carry", "text")).cast("long").alias("chars"))


PAGE_CARRY_SQL = rf"""
WITH p AS (SELECT conv_id, turn, replace(text, chr(10), chr(10) || chr(10)) AS text FROM conversations),
l AS (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: {TRIM.format("x")}), lambda x: x <> '')[-1] AS lp FROM p),
c AS (SELECT *, last_value(lp IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carry FROM l)
SELECT conv_id, turn, carry, CAST(length(concat_ws(chr(10) || chr(10), carry, text)) AS BIGINT) AS chars FROM c
"""


def chunk_prefix(spark, sf):
    docs = table(spark, sf, "documents")
    given = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" prefix "), F.col("doc_id")))
    cited = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("[2020] "), F.col("source")))
    topics = F.slice(F.split("text", " "), 1, (F.col("doc_id") % 11).cast("int"))
    year = F.when(F.col("doc_id") % 2 == 0, (F.lit(2000) + F.col("doc_id") % 20).cast("int"))
    return docs.select("doc_id", op.chunk_prefix(given, cited, F.col("lang"), year, topics).alias("prefix"))


PREFIX_SQL = r"""
WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'prefix ' || doc_id END AS given, CASE WHEN doc_id % 7 <> 0 THEN '[2020] ' || source END AS cited,
  string_split(text, ' ')[1 : least(doc_id % 11, 8)] AS topics, CASE WHEN doc_id % 2 = 0 THEN CAST(2000 + doc_id % 20 AS VARCHAR) END AS year FROM documents)
SELECT doc_id, coalesce(given, CASE WHEN cited IS NOT NULL THEN concat_ws(' | ', cited, trim(lang || ' ' || coalesce(year, '')), CASE WHEN len(topics) > 0 THEN 'Topics: ' || array_to_string(topics, '; ') END) END, '') AS prefix FROM d
"""


def point_ids(spark, sf):
    cut = op.windows(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return cut.select("doc_id", F.col("chunk_idx").cast("long"), op.point_id(F.col("source"), F.col("chunk_idx"), F.col("chunk")).alias("point_id"))


POINT_SQL = f"WITH {_WINDOWS} SELECT doc_id, chunk_idx, md5(source || ':' || chunk_idx || ':' || chunk[1:100]) AS point_id FROM chunks"


def last_user_query(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", fx.trimmed("text").alias("q"))
    return turns.where((F.col("q") != "") & op.is_real_query(F.col("q"))).groupBy("conv_id").agg(F.max_by("q", "turn").alias("query"))


LAST_USER_SQL = f"""
WITH t AS (SELECT conv_id, turn, {TRIM.format("text")} AS q FROM conversations WHERE role = 'user'), h AS (SELECT *, lower(q[1:400]) AS head FROM t WHERE q <> '')
SELECT conv_id, max_by(q, turn) AS query FROM h WHERE NOT (starts_with(head, '### task:') OR (contains(head, 'follow-up') AND contains(head, 'suggest')) OR contains(head, 'relevant follow-up questions')) GROUP BY conv_id
"""


def tier0_gate(spark, sf):
    header = F.when(F.col("id") % 10 == 3, "force").when(F.col("id") % 10 == 7, "off")
    return asked(spark, sf).select("id", op.skips_retrieval(F.col("q"), header).alias("skips"))


TIER0_SQL = f"""
SELECT id, CASE WHEN id % 10 = 3 THEN false WHEN id % 10 = 7 THEN true WHEN t = '' THEN true WHEN contains(t, '?') OR regexp_matches(t, '{re_sql(op.INFRA)}') OR length(t) > 80 THEN false
  ELSE regexp_matches(t, '{re_sql(op.GREETING)}') OR regexp_matches(t, '{re_sql(op.ACKNOWLEDGED)}') END AS skips FROM (SELECT id, {TRIM.format("q")} AS t FROM {QUERY_SQL})
"""


def _w(name):
    return any_sql("l", op.INTENT_WORDS[name][0])


_INTENT = f"""
i AS (SELECT id, q, CASE WHEN regexp_matches(q, '{re_sql(op.LOG_LINE)}') OR (contains(l, 'log') AND (contains(l, 'analyze') OR contains(l, 'parse'))) THEN {{'label': 'log_analysis', 'c': 0.85}}
  WHEN {_w("infra_debug")} THEN {{'label': 'infra_debug', 'c': 0.8}} WHEN contains(l, 'review') AND (contains(l, 'pr') OR contains(l, 'code') OR f) THEN {{'label': 'code_review', 'c': 0.8}}
  WHEN {_w("code_generation")} THEN {{'label': 'code_generation', 'c': 0.75}} WHEN f THEN {{'label': 'code_generation', 'c': 0.7}} WHEN {_w("summarization")} THEN {{'label': 'summarization', 'c': 0.75}}
  WHEN {_w("planning")} THEN {{'label': 'planning', 'c': 0.7}} WHEN {_w("research")} THEN {{'label': 'research', 'c': 0.7}} WHEN {_w("troubleshooting")} THEN {{'label': 'troubleshooting', 'c': 0.75}}
  WHEN {_w("creative")} THEN {{'label': 'creative', 'c': 0.7}} WHEN length(q) > 200 AND {_w("retrieval_heavy")} THEN {{'label': 'retrieval_heavy', 'c': 0.65}} WHEN {_w("reasoning_heavy")} THEN {{'label': 'reasoning_heavy', 'c': 0.65}}
  WHEN {_w("question")} THEN {{'label': 'research', 'c': 0.7}} WHEN length(q) < 60 THEN {{'label': 'simple_chat', 'c': 0.6}} ELSE {{'label': 'unknown', 'c': 0.0}} END AS r
  FROM (SELECT id, q, lower(q) AS l, regexp_matches(q, '{re_sql(op.CODE_FILE)}') AS f FROM {QUERY_SQL}))
"""


def intent_rules(spark, sf):
    return asked(spark, sf).select("id", op.intent(F.col("q")).alias("r")).select("id", F.col("r.label").alias("label"), F.col("r.confidence").alias("confidence"), op.sure_intent(F.col("r")).alias("used"))


INTENT_SQL = f"WITH {_INTENT} SELECT id, r.label AS label, CAST(r.c AS DOUBLE) AS confidence, CASE WHEN r.c < 0.55 THEN 'unknown' ELSE r.label END AS used FROM i"


def gating_decision(spark, sf):
    rows = asked(spark, sf).withColumn("r", op.intent(F.col("q")))
    return rows.select("id", op.gate(op.sure_intent(F.col("r")), F.col("r.confidence"), F.col("q")).alias("decision"))


GATING_SQL = f"""
WITH {_INTENT}, u AS (SELECT id, q, r.c AS c, CASE WHEN r.c < 0.55 THEN 'unknown' ELSE r.label END AS label FROM i)
SELECT id, CASE WHEN label IN ('infra_debug', 'troubleshooting', 'log_analysis', 'retrieval_heavy', 'research', 'planning', 'code_review') THEN 'full' WHEN label IN ('simple_chat', 'creative') AND c >= 0.6 THEN 'skip'
  WHEN label = 'code_generation' AND length(q) < 120 THEN 'light' WHEN length(q) < 40 AND c < 0.5 THEN 'skip' ELSE 'full' END AS decision FROM u
"""


def route_by_intent(spark, sf):
    """Intents joined to a model table that the configuration may override."""
    routes = spark.createDataFrame([("code_generation", "coder"), ("code_review", "coder"), ("infra_debug", "general"), ("research", "large"), ("simple_chat", "small")], "label string, model string")
    rows = asked(spark, sf).select("id", op.sure_intent(op.intent(F.col("q"))).alias("label"))
    return rows.join(F.broadcast(routes), "label", "left").select("id", "label", "model")


ROUTE_SQL = f"""
WITH {_INTENT}, u AS (SELECT id, CASE WHEN r.c < 0.55 THEN 'unknown' ELSE r.label END AS label FROM i)
SELECT id, label, model FROM u LEFT JOIN (VALUES ('code_generation', 'coder'), ('code_review', 'coder'), ('infra_debug', 'general'), ('research', 'large'), ('simple_chat', 'small')) m(label, model) USING (label)
"""


def rewrite_guard(spark, sf):
    return asked(spark, sf).select("id", op.rewrite(F.col("q")).alias("rewritten"))


REWRITE_SQL = rf"""
WITH a AS (SELECT id, q, regexp_replace(regexp_replace({TRIM.format("q")}, '(?i)\bk8s\b', 'kubernetes', 'g'), '(?i)\bomv\b', 'openmediavault', 'g') AS o FROM {QUERY_SQL}),
b AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(o), '\s+'), lambda x: x <> '')) AS y FROM a)
SELECT id, CASE WHEN length(o) <= length(q) * 1.5 AND len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.3
  AND len(list_filter(regexp_extract_all(q, '{re_sql(op.LITERAL)}'), lambda z: NOT contains(o, z))) = 0 THEN o ELSE q END AS rewritten FROM b
"""


def token_jaccard(spark, sf):
    """Best benchmark item for each document that shares a word set with it: a join on shared tokens, then sizes."""
    docs = table(spark, sf, "documents").select("doc_id", F.array_distinct(fx.split_words(F.lower("text"))).alias("ws"))
    items = table(spark, sf, "benchmark").select("item_id", F.array_distinct(fx.split_words(F.lower("text"))).alias("bs"))
    hits = docs.select("doc_id", F.size("ws").alias("n"), F.explode("ws").alias("w")).join((items.select("item_id", F.size("bs").alias("m"), F.explode("bs").alias("w"))), "w")
    both = hits.groupBy("doc_id", "item_id", "n", "m").agg(F.count("*").alias("c"))
    score = F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6)
    return both.select("doc_id", "item_id", score.alias("jaccard")).where("jaccard >= 0.1")


JACCARD_SQL = r"""
WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS ws FROM documents), b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS bs FROM benchmark),
p AS (SELECT doc_id, item_id, len(ws) AS n, len(bs) AS m, len(list_intersect(ws, bs)) AS c FROM d CROSS JOIN b)
SELECT doc_id, item_id, round(c / (n + m - c), 6) AS jaccard FROM p WHERE round(c / (n + m - c), 6) >= 0.1
"""


def extract_json(spark, sf):
    """The object inside a wrapped answer, as text and by key."""
    raw = F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done"))
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return table(spark, sf, "events").select("event_id", body.alias("body"), F.get_json_object(body, "$.k").cast("long").alias("k"))


EXTRACT_SQL = r"""SELECT event_id, regexp_extract('Sure: ' || props || ' done', '(?s)\{.*\}') AS body, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def format_size(spark, sf):
    size = (F.col("o_totalprice") * F.col("o_orderkey")).cast("long")
    text = op.format_size(size)
    return table(spark, sf, "orders").select("o_orderkey", F.regexp_replace(text, r"^[\d.]+ ", "").alias("unit"), op.parse_size(F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(".5 MiB"))).alias("bytes"))


FORMAT_SIZE_SQL = """
SELECT o_orderkey, CASE WHEN s < 1024 THEN 'B' WHEN s < 1048576 THEN 'KB' WHEN s < 1073741824 THEN 'MB' ELSE 'GB' END AS unit, CAST((o_orderkey % 90 + 0.5) * 1048576 AS BIGINT) AS bytes
FROM (SELECT o_orderkey, CAST(trunc(o_totalprice * o_orderkey) AS BIGINT) AS s FROM orders)
"""


def format_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "dd-MMM-yyyy HH:mm:ss").alias("shown"), F.date_format("ts", "MMM yyyy").alias("month"))


def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", op.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def page_title_h1(spark, sf):
    title = fx.trimmed(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


def page_paragraphs(spark, sf):
    parts = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p>(.*?)</p>"), F.lit(1)), lambda x: fx.trimmed(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " ")))
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.filter(parts, lambda x: F.length(x) >= 20)).alias("pos", "paragraph")).select("page_id", F.col("pos").cast("long"), "paragraph")


PARAGRAPHS_SQL = r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) >= 20) AS ps FROM pages)
SELECT page_id, CAST(unnest(range(len(ps))) AS BIGINT) AS pos, unnest(ps) AS paragraph FROM p
"""


def engagement_rating(spark, sf):
    """1 to 5 by purchases for each 10,000 views."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("favs"))
    score = F.when(F.col("views") <= 0, F.lit(1.0)).otherwise(1.0 + F.least(F.lit(4.0), F.col("favs") * 10000 / F.col("views") / 6.0 * 4.0))
    return e.select("user_id", "views", "favs", F.round(score, 2).alias("rating"))


ENGAGEMENT_SQL = """
SELECT user_id, views, favs, round(CASE WHEN views <= 0 THEN 1.0::DOUBLE ELSE 1.0 + least(4.0, favs * 10000 / views / 6.0 * 4.0) END, 2) AS rating
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS favs FROM events GROUP BY user_id)
"""


def smell_flags(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).unionByName(spark.createDataFrame([(-i - 1, p) for i, p in enumerate(PROBES)], "id long, t string"))
    return docs.select("id", *[c.alias(n) for n, c in op.smells(F.col("t")).items()])


_SMELLS = """contains(lower(t), 'wombat') OR contains(lower(t), '_____wb$') AS wayback_js, contains(t, '@context') AND contains(t, 'schema.org') AS json_ld,
  (contains(lower(t), 'background-image') OR (contains(lower(t), 'external-link') AND contains(t, '{'))) AND length(t) - length(replace(t, '{', '')) > 3 AS css_leak"""
SMELL_SQL = f"SELECT id, {_SMELLS} FROM (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT -id - 1, q FROM {PROBE_SQL})"


def canonical_ids(spark, sf):
    md5 = F.md5(F.col("doc_id").cast("string"))
    dashed = F.concat(F.lit(" "), F.upper(F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12))), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", op.canonical_id(dashed).alias("hex_id"), F.conv(F.substring(op.canonical_id(dashed), 1, 16), 16, 10).alias("key"))


CANONICAL_SQL = "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS hex_id, CAST(CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:16] AS UBIGINT) AS VARCHAR) AS key FROM documents"


def url_parts(spark, sf):
    clean = F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("kind"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"v\d+$", "").alias("name"), F.size(parts).cast("long").alias("depth"))


URL_SQL = r"""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^\w+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS ps FROM pages)
SELECT page_id, coalesce(ps[1], '') AS kind, regexp_replace(coalesce(ps[2], ''), 'v\d+$', '') AS name, CAST(len(ps) AS BIGINT) AS depth FROM p
"""

PHASES = """SELECT kind, configured, mode, ok, dirty, reindexing, active, dual,
  CASE WHEN NOT configured THEN 'unconfigured' WHEN reindexing THEN 'reindexing' WHEN kind = 'dense' AND dual AND active THEN 'dual_write' WHEN dirty THEN 'pending_reindex'
       WHEN ok = false THEN 'down' WHEN mode = 'off' THEN 'off' ELSE 'idle' END AS phase
FROM {flags} c CROSS JOIN (SELECT x AS dirty FROM {b}) d CROSS JOIN (SELECT x AS reindexing FROM {b}) r CROSS JOIN (SELECT x AS active FROM {b}) a CROSS JOIN (SELECT x AS dual FROM {b}) u"""
_FLAGS = "(SELECT * FROM (VALUES ('dense', true, 'idle', true), ('dense', false, 'idle', true), ('sparse', true, 'off', true), ('sparse', true, 'each', false), ('dense', true, 'off', CAST(NULL AS BOOLEAN))) AS f(kind, configured, mode, ok))"
PHASE_SQL = PHASES.format(flags=_FLAGS, b="(VALUES (true), (false)) AS t(x)")


def phase_case(spark, sf):
    flags = [("dense", True, "idle", True), ("dense", False, "idle", True), ("sparse", True, "off", True), ("sparse", True, "each", False), ("dense", True, "off", None)]
    out = spark.createDataFrame(flags, "kind string, configured boolean, mode string, ok boolean")
    for name in ("dirty", "reindexing", "active", "dual"):
        out = out.withColumn(name, F.explode(F.array(F.lit(True), F.lit(False))))
    phase = (
        F.when(~F.col("configured"), "unconfigured").when(F.col("reindexing"), "reindexing").when((F.col("kind") == "dense") & F.col("dual") & F.col("active"), "dual_write")
        .when(F.col("dirty"), "pending_reindex").when(~F.col("ok"), "down").when(F.col("mode") == "off", "off").otherwise("idle")
    )
    return out.withColumn("phase", phase)


def internal_links(spark, sf):
    """Links of a page that stay on its host: relative ones, and absolute ones with the same host."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    other = F.regexp_extract("href", r"^\w+://([^/:?#]*)", 1)
    return pages.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if((other == "") | (other == F.col("host"))).alias("internal"), F.count_if(F.col("href").startswith("/")).alias("rooted"))


INTERNAL_SQL = r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^\w+://([^/:?#]*)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS links, count(*) FILTER (WHERE regexp_extract(href, '^\w+://([^/:?#]*)', 1) IN ('', host)) AS internal, count(*) FILTER (WHERE starts_with(href, '/')) AS rooted FROM l GROUP BY page_id
"""


QUERIES = {
    "file_type_dispatch": (file_type_dispatch, FILE_TYPE_SQL),
    "normalize_plain": (normalize_plain, NORMALIZE_SQL),
    "delete_by_source": (delete_by_source, "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7') OR source IS NULL"),
    "page_links": (page_links, PAGE_LINKS_SQL),
    "sanitize_pages": (sanitize_pages, None),
    "wiki_namespace_filter": (wiki_namespace_filter, WIKI_SQL),
    "strip_html_flat": (strip_html_flat, STRIP_SQL),
    "strip_markers": (strip_markers, STRIP_MARKERS_SQL),
    "chunk_windows": (chunk_windows, CHUNK_SQL),
    "strip_boilerplate_lines": (strip_boilerplate_lines, BOILERPLATE_SQL),
    "chunk_strategy": (chunk_strategy, STRATEGY_SQL),
    "merge_small_lines": (merge_small_lines, MERGE_SQL),
    "page_carry": (page_carry, PAGE_CARRY_SQL),
    "chunk_prefix": (chunk_prefix, PREFIX_SQL),
    "point_ids": (point_ids, POINT_SQL),
    "last_user_query": (last_user_query, LAST_USER_SQL),
    "tier0_gate": (tier0_gate, TIER0_SQL),
    "intent_rules": (intent_rules, INTENT_SQL),
    "gating_decision": (gating_decision, GATING_SQL),
    "route_by_intent": (route_by_intent, ROUTE_SQL),
    "rewrite_guard": (rewrite_guard, REWRITE_SQL),
    "token_jaccard": (token_jaccard, JACCARD_SQL),
    "extract_json": (extract_json, EXTRACT_SQL),
    "format_size": (format_size, FORMAT_SIZE_SQL),
    "format_ts": (format_ts, "SELECT event_id, strftime(ts, '%d-%b-%Y %H:%M:%S') AS shown, strftime(ts, '%b %Y') AS month FROM events"),
    "token_estimate": (token_estimate, "SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents"),
    "page_title_h1": (page_title_h1, r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS title FROM pages"),
    "page_paragraphs": (page_paragraphs, PARAGRAPHS_SQL),
    "engagement_rating": (engagement_rating, ENGAGEMENT_SQL),
    "smell_flags": (smell_flags, SMELL_SQL),
    "canonical_ids": (canonical_ids, CANONICAL_SQL),
    "url_parts": (url_parts, URL_SQL),
    "phase_case": (phase_case, PHASE_SQL),
    "internal_links": (internal_links, INTERNAL_SQL),
}
