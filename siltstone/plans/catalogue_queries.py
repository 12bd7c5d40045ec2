"""Catalogue rows, feeds, stories, staged requests, quantised search and vector caches, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import trimmed
from siltstone.operators import catalogue, dense, stages
from siltstone.operators import text as op
from siltstone.plans.text_queries import TRIM
from siltstone.sources.tables import spread, table

#: Entries of a catalogue by part: source, name, address, link outside, folder, can be subscribed to.
ENTRIES = [
    ("archive", "Some Texts/", "collection/texts", "", True, False), ("archive", "q", "search/q", "", True, False), ("archive", "An item", "item/x", "", True, False), ("arxiv", "cs.AI/", "cat/cs.AI/new", "", True, False),
    ("arxiv", "24", "prefix/24", "", True, False), ("zim", "wiki/", "wiki/", "", True, False), ("zim", "wikipedia_en_all_maxi_2024-03.zim", "w.zim", "", False, True), ("zim", "odd.zim", "odd.zim", "", False, True),
    ("web", "Book.PDF", "b.pdf", "", False, True), ("web", "notes.md", "n.md", "", False, True), ("arxiv", "2301.00001: On  rings ", "paper/2301.00001", "", False, True), ("web", "data.bin", "d", "", False, True),
    ("web", "out", "o", "http://x", False, False), ("web", "[Next page] 2", "page/2", "", True, False),
]
SHOWN = [
    ("collection", "Some Texts", "Collection"), ("search", "q", ""), ("item", "An item", ""), ("category", "cs.AI", "cs.AI"), ("prefix", "24", ""), ("folder", "wiki", ""),
    ("zim", "All Maxi", "Wikipedia · EN · Mar 2024"), ("zim", "odd.zim", ""), ("pdf", "Book.PDF", ""), ("text", "notes.md", ""), ("paper", "On  rings", "2301.00001"), ("file", "data.bin", ""), ("external", "out", ""), ("pagination", "Next page", ""),
]


def catalogue_items(spark, sf):
    entries = spark.createDataFrame([(i, *e) for i, e in enumerate(ENTRIES)], "e long, source_id string, name string, href string, external_url string, is_directory boolean, subscribable boolean")
    modified = F.when(F.col("p_size") % 3 == 0, "2024-05-06T07:08").when(F.col("p_size") % 3 == 1, "")
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(ENTRIES)).alias("e"), modified.alias("modified")).join(F.broadcast(entries), "e")
    return catalogue.described(rows).select("p_partkey", "kind", "kind_label", "title", "subtitle")


def _items_sql() -> str:
    values = ", ".join(f"({i}, '{k}', '{t}', '{s}')" for i, (k, t, s) in enumerate(SHOWN))
    return f"""SELECT p_partkey, kind, upper(kind) AS kind_label, title, CASE WHEN p_size % 3 <> 0 OR kind IN ('external', 'pagination') THEN sub WHEN sub = '' THEN '2024-05-06' ELSE sub || ' · 2024-05-06' END AS subtitle
FROM part JOIN (VALUES {values}) s(e, kind, title, sub) ON e = p_partkey % {len(SHOWN)}"""


def paper_feed(spark, sf):
    """Parts as papers, 20 to a feed."""
    key = F.col("p_partkey")
    escaped = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(
        F.lit("<entry><id>http://"), F.when(key % 4 == 0, "example.org/list/").otherwise("arxiv.org/abs/"), key.cast("string"), F.when(key % 4 == 0, "").otherwise("v12"), F.lit("</id><title>  On\n   "), escaped, F.lit(" </title>"),
        F.when(key % 5 == 0, "").otherwise("<published>2020-01-02T03:04:05Z</published>"), F.when(key % 3 == 0, "<updated>2021-02-03T04:05:06Z</updated>").otherwise(""), F.lit("</entry>"),
    )
    feeds = table(spark, sf, "part").select(F.floor(key / 20).alias("feed"), F.struct(key, entry.alias("x")).alias("e")).groupBy("feed").agg(F.array_sort(F.collect_list("e")).alias("es"))
    body = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><totalResults>'), F.when(F.col("feed") % 2 == 0, "101").otherwise("100"), F.lit("</totalResults>"), F.array_join(F.transform("es", lambda e: e["x"]), ""), F.lit("</feed>"))
    return catalogue.papers(feeds.select("feed", F.lit("cat/x").alias("href_prefix"), F.lit(1).alias("page"), body.alias("body")), "http://arxiv.org/pdf").select("feed", "name", "href", "url", "is_directory", "modified")


PAPERS_SQL = r"""
SELECT p_partkey // 20 AS feed, p_partkey || ': ' || ('On ' || trim(regexp_replace(p_name, '\s+', ' ', 'g')))[1:100] AS name, 'paper/' || p_partkey AS href, 'http://arxiv.org/pdf/' || p_partkey || '.pdf' AS url, false AS is_directory,
  CASE WHEN p_partkey % 3 = 0 THEN '2021-02-03' WHEN p_partkey % 5 <> 0 THEN '2020-01-02' END AS modified FROM part
UNION ALL SELECT DISTINCT p_partkey // 20, '[Next page]', 'cat/x/page/2', '', true, NULL FROM part WHERE p_partkey // 20 % 2 = 0
"""


def story_index(spark, sf):
    rows = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 4).alias("slug"), F.concat("url", F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("&page="), F.col("page_id") % 7 + 2)).otherwise("")).alias("u"))
    out = catalogue.story_index(rows.select("slug", F.regexp_replace("u", r"page=\d+&", "").alias("url")))
    return out.select("slug", F.array_join("pages", ",").alias("pages"), F.array_join("missing", ",").alias("missing"))


STORY_SQL = r"""
WITH u AS (SELECT page_id // 4 AS slug, regexp_replace(url || CASE WHEN page_id % 3 > 0 THEN '&page=' || (page_id % 7 + 2) ELSE '' END, 'page=\d+&', '', 'g') AS u FROM pages),
p AS (SELECT slug, list_sort(list_distinct(list(coalesce(TRY_CAST(regexp_extract(u, '[?&]page=(\d{1,9})', 1) AS INT), 1)))) AS ps FROM u GROUP BY slug)
SELECT slug, array_to_string(ps, ',') AS pages, array_to_string(range(1, ps[1]), ',') AS missing FROM p
"""


def story_markdown(spark, sf):
    """Conversations as stories: the first user turn is the title, views and favourites come from the id."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"), F.count("*").cast("int").alias("pages"))
    title = F.when(F.col("conv_id") % 4 > 0, F.concat(F.substring(F.col("ts")[0]["text"], 1, 30), F.lit(' "q" \\')))
    rows = turns.select(
        F.concat(F.lit("c-"), F.col("conv_id")).alias("slug"), title.alias("title"), F.when(F.col("conv_id") % 3 > 0, "A. Writer").alias("author"), F.when(F.col("conv_id") % 5 > 0, "").otherwise("tales").alias("category"),
        F.when(F.col("conv_id") % 7 > 0, F.col("conv_id") * 10).alias("views"), F.when(F.col("conv_id") % 2 > 0, F.col("conv_id")).alias("favorites"), "pages",
        F.when(F.col("conv_id") % 6 == 0, F.array(F.lit(2), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("missing"), F.array_join(F.transform("ts", lambda t: t["text"]), "\n\n").alias("body"),
    )
    return rows.select("slug", F.md5(catalogue.markdown(F.col("body"))).alias("markdown_md5"))


MARKDOWN_SQL = r"""
WITH t AS (SELECT conv_id, count(*) AS pages, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS body, first(coalesce(text, '') ORDER BY turn, role, text)[1:30] || ' "q" \' AS head FROM conversations GROUP BY conv_id),
s AS (SELECT *, 'c-' || conv_id AS slug, CASE WHEN conv_id % 4 > 0 THEN head ELSE 'c-' || conv_id END AS title FROM t)
SELECT slug, md5(concat_ws(chr(10), '---', 'title: "' || replace(replace(replace(replace(replace(title, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"', CASE WHEN conv_id % 3 > 0 THEN 'author: "A. Writer"' END,
  CASE WHEN conv_id % 5 = 0 THEN 'category: "tales"' END, CASE WHEN conv_id % 7 > 0 THEN 'views: ' || conv_id * 10 END, CASE WHEN conv_id % 2 > 0 THEN 'favorites: ' || conv_id END,
  CASE WHEN conv_id % 7 > 0 AND conv_id % 2 > 0 THEN 'favorite_rate: 0.100000' END, 'slug: "' || slug || '"', 'pages: ' || pages, CASE WHEN conv_id % 6 = 0 THEN 'missing_pages: [2, 3]' END, '---' || chr(10), '# ' || title,
  CASE WHEN conv_id % 3 > 0 THEN chr(10) || '*by A. Writer*' END, '', body, '')) AS markdown_md5 FROM s
"""


def velocity_lines(spark, sf):
    e = table(spark, sf, "events")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = e.groupBy("user_id").agg(n("purchase").alias("indexed"), (F.count("*") * 1000 + F.first("user_id")).alias("total_chunks"), n("click").alias("running"), n("view").alias("pending"))
    rates = counts.withColumns({"active": F.when(F.col("user_id") % 4 > 0, F.col("running") + F.col("pending")), "rate_now": F.when(F.col("user_id") % 3 > 0, F.col("pending") * 700), "rate_5m": F.col("indexed") * 999})
    return rates.select("user_id", catalogue.velocity().alias("line"))


VELOCITY_SQL = """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS indexed, count(*) * 1000 + user_id AS total, count(*) FILTER (WHERE event_type = 'click') AS running, count(*) FILTER (WHERE event_type = 'view') AS pending FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 4 > 0 AND running + pending > 0 THEN concat_ws(' · ', (running + pending) || ' in queue', format('{:,} corpus chunks', total), CASE WHEN running > 0 THEN running || ' embedding' END,
  CASE WHEN user_id % 3 > 0 AND pending > 0 THEN format('{:,} chunks/min', pending * 700) WHEN running > 0 THEN 'measuring…' WHEN pending > 0 THEN 'waiting' END, CASE WHEN indexed > 0 THEN format('5m avg {:,} chunks/min', indexed * 999) END)
  ELSE concat_ws(' · ', format('{:,} indexed', indexed), format('{:,} corpus chunks', total)) END AS line FROM c
"""


def request_stages(spark, sf):
    """Turns as requests with a budget: a gate, a rewrite of what is to be retrieved, memory from the second turn on; a fourth stage is off."""
    rows = table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("query"), F.lit(None).cast("boolean").alias("retrieve"), F.lit(False).alias("memory"), (100.0 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 300).alias("budget_ms")
    )
    steps = [
        stages.Stage("gate", {"retrieve": F.length(F.coalesce("query", F.lit(""))) >= 40}, F.lit(True), 0.0, 10.0),
        stages.Stage("rewrite", {"query": F.concat(F.lit("Find: "), "query")}, F.col("retrieve"), 150.0, 120.0),
        stages.Stage("graph", {"query": F.lit("never")}, F.lit(True), enabled=False),
        stages.Stage("memory", {"memory": F.lit(True)}, F.col("turn") > 0, 100.0, 50.0),
    ]
    return stages.run(rows, steps).select("conv_id", "turn", F.md5("query").alias("query_md5"), "memory", "budget_ms", F.array_join("trace", ">").alias("trace"))


STAGES_SQL = """
WITH r AS (SELECT conv_id, turn, text, 90.0::DOUBLE + (conv_id * 7 + turn * 13) % 300 AS b FROM conversations WHERE role = 'user'), w AS (SELECT *, length(coalesce(text, '')) >= 40 AND b >= 150 AS rw FROM r),
m AS (SELECT *, b - CASE WHEN rw THEN 120 ELSE 0 END AS c FROM w), f AS (SELECT *, turn > 0 AND c >= 100 AS mem FROM m)
SELECT conv_id, turn, md5(CASE WHEN rw THEN 'Find: ' || text ELSE text END) AS query_md5, mem AS memory, c - CASE WHEN mem THEN 50 ELSE 0 END AS budget_ms, 'gate' || CASE WHEN rw THEN '>rewrite' ELSE '' END || CASE WHEN mem THEN '>memory' ELSE '' END AS trace FROM f
"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def dense_quantised(spark, sf):
    """Search over 4-bit codes: the ten best by restored vectors, then the threshold."""
    points, asks = _vectors(spark, sf)
    hits = dense.approximate(dense.quantised(points), asks, 10, 0.3)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


QUANTISED_SQL = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT id, v, list_min(v) AS low, (list_max(v) - list_min(v)) / 15 AS step FROM v),
r AS (SELECT id, list_transform(v, lambda x: low + CASE WHEN step > 0 THEN floor((x - low) / step + 0.5) ELSE 0 END * step) AS v FROM c),
s AS (SELECT q.id AS query_id, r.id, list_dot_product(r.v, q.v) / (sqrt(list_dot_product(r.v, r.v)) * sqrt(list_dot_product(q.v, q.v))) AS score FROM r CROSS JOIN v q WHERE q.id % 100 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score FROM d WHERE rank <= 10 AND score >= 0.3
"""


def dense_writable(spark, sf):
    """Rows without an id or with an empty vector are skipped."""
    v, _ = _vectors(spark, sf)
    empty = F.array().cast("array<float>")
    rows = v.select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), F.when(F.col("id") % 5 > 0, F.col("vector")).when(F.col("id") % 2 > 0, empty).alias("vector"))
    return dense.writable(rows).select("id", F.size("vector").cast("long").alias("dim"))


def vector_cache(spark, sf):
    """Texts against vectors that were stored in the last ten minutes; a text that stands twice takes the newest."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2(trimmed("text"), 256).alias("key"), F.array(F.col("doc_id").cast("double")).alias("vector"), (F.lit(10_000.0) - F.col("doc_id") % 1000 + F.col("doc_id") / 1e7).alias("stored_at"))
    return dense.cached(docs.withColumnRenamed("doc_id", "id"), cache, 10_000.0).select("id", "key", F.col("vector")[0].cast("long").alias("stored"))


CACHE_SQL = f"""
WITH d AS (SELECT doc_id, sha256({TRIM.format("text")}) AS key FROM documents), c AS (SELECT key, doc_id, 10000.0::DOUBLE - doc_id % 1000 + doc_id / 1e7 AS stored_at FROM d WHERE doc_id % 3 = 0),
n AS (SELECT key, max_by(doc_id, stored_at) AS stored FROM c WHERE 10000 - stored_at <= 600 GROUP BY key) SELECT doc_id AS id, key, stored FROM d LEFT JOIN n USING (key)
"""


def scroll_sample(spark, sf):
    """Fifty documents with text: one of each source, the largest sources first, then others in the order of a hash."""
    return op.sample_each(spread(table(spark, sf, "documents")).where("text <> ''").select(F.col("doc_id").alias("id"), "source"), 50).select("id", "source")


SCROLL_SQL = """
WITH d AS (SELECT doc_id AS id, source, md5('42:' || doc_id) AS h FROM documents WHERE text <> ''), s AS (SELECT source, count(*) AS n, min(h) AS h FROM d GROUP BY source ORDER BY n DESC, source LIMIT 50),
f AS (SELECT id, d.source, d.h, s.h IS NULL AS later FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source AND d.h = s.h) SELECT id, source FROM f ORDER BY later, h LIMIT 50
"""

QUERIES = {
    "catalogue_items": (catalogue_items, _items_sql()),
    "paper_feed": (paper_feed, PAPERS_SQL),
    "story_index": (story_index, STORY_SQL),
    "story_markdown": (story_markdown, MARKDOWN_SQL),
    "velocity_lines": (velocity_lines, VELOCITY_SQL),
    "request_stages": (request_stages, STAGES_SQL),
    "dense_quantised": (dense_quantised, QUANTISED_SQL),
    "dense_writable": (dense_writable, "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings WHERE vec_id % 7 > 0 AND vec_id % 5 > 0"),
    "vector_cache": (vector_cache, CACHE_SQL),
    "scroll_sample": (scroll_sample, SCROLL_SQL),
}
