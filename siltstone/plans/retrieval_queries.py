"""Queries of dense and sparse search, fusion and context assembly, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.text import STOP_WORDS, split_words, tokens
from siltstone.operators import context, dense, fusion, ordered, sparse
from siltstone.operators.text import CONSTRAINT
from siltstone.sources.tables import cut, spread, table

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
LINES = 100_000_000  # more than a document has lines
NOW = 1704067200.0  # 2024-01-01 UTC; never the clock


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asks(spark, sf, where="vec_id % 100 = 0"):
    """Queries: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _docs(spark, sf, by="'all'"):
    return table(spark, sf, "documents").selectExpr(f"{by} AS collection", "doc_id AS id", "text")


def _items(spark, sf, where="true"):
    return table(spark, sf, "benchmark").where(where).selectExpr("item_id AS query_id", "text")


_COS = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, v.id, list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))) AS score FROM v CROSS JOIN v q WHERE {ids}),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s {where})
"""


def dense_topk(spark, sf):
    hits = dense.nearest(_points(spark, sf), _asks(spark, sf), 5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def dense_threshold(spark, sf):
    """Top k first, threshold after: fewer than k rows may stay."""
    hits = dense.nearest(_points(spark, sf), _asks(spark, sf), 10).where("score >= 0.3")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


def dense_allowlist(spark, sf):
    allowed = table(spark, sf, "embeddings").where("label IN (1, 2)").select(F.col("vec_id").alias("id"))
    hits = dense.nearest(_points(spark, sf).join(allowed, "id", "left_semi"), _asks(spark, sf), 5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


def dense_late_payload(spark, sf):
    payload = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "source", "lang")
    hits = dense.nearest(_points(spark, sf), _asks(spark, sf), 8).select("query_id", "id", F.col("rank").cast("long").alias("rank"))
    return dense.with_payload(hits, payload).select("query_id", "id", "rank", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))


def fact_scores(spark, sf):
    points = _points(spark, sf).withColumn("vector", F.when(F.col("id") % 50 == 7, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))
    return dense.scores(points, _asks(spark, sf), digits=6)


def journal_replay(spark, sf):
    base = table(spark, sf, "embeddings")
    log = base.selectExpr("vec_id AS seq", "'add' AS op", "vec_id AS id", "label AS vector").unionByName(
        base.where("vec_id % 3 = 0").selectExpr("vec_id + 100000 AS seq", "if(vec_id % 2 = 0, 'remove', 'add') AS op", "vec_id AS id", "label + 1 AS vector")
    )
    return dense.replay(log).select("id", "seq", "vector")


JOURNAL_SQL = """
WITH j AS (SELECT vec_id AS seq, 'add' AS op, vec_id AS id, label AS vector FROM embeddings UNION ALL SELECT vec_id + 100000, CASE WHEN vec_id % 2 = 0 THEN 'remove' ELSE 'add' END, vec_id, label + 1 FROM embeddings WHERE vec_id % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM j) SELECT id, seq, vector FROM n WHERE nth = 1 AND op = 'add'
"""



def _tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_\p{{M}}]+'), lambda w: w NOT IN {STOPS})"


def tokenize_counts(spark, sf):
    found = tokens("text")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.size(found).cast("long").alias("n"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


def bm25_df(spark, sf):
    posts = sparse.postings(sparse.lengths(_docs(spark, sf)))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 3")


def bm25_doclen(spark, sf):
    sized = cut(sparse.lengths(spread(_docs(spark, sf))).select("id", "length"))
    return sized.crossJoin(F.broadcast(sized.agg(F.round(F.avg("length"), 6).alias("mean"))))


def _bm25_sql(by: str, k: int, where: str = "true") -> str:
    return f"""
l AS (SELECT {by} AS collection, doc_id AS id, {_tokens_sql("text")} AS terms FROM documents), n AS (SELECT collection, count(*) AS n, avg(len(terms)) AS mean FROM l GROUP BY collection),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_tokens_sql("text")}) AS term FROM benchmark WHERE {where}) GROUP BY ALL),
p AS (SELECT collection, id, len, term, count(*) AS tf FROM (SELECT collection, id, len(terms) AS len, unnest(terms) AS term FROM l) GROUP BY ALL),
f AS (SELECT collection, term, count(*) AS df FROM p GROUP BY ALL),
t AS (SELECT query_id, p.collection, id, sum(times * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM p JOIN q USING (term) JOIN f USING (collection, term) JOIN n USING (collection) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(score, 9) DESC, id) AS rank FROM t WHERE score > 0)"""


def _bm25(spark, sf, k, by="'all'", where="true"):
    return sparse.search(_docs(spark, sf, by), _items(spark, sf, where), k)


def bm25_search(spark, sf):
    return _bm25(spark, sf, 10, where="item_id = 0").select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def bm25_multi_query(spark, sf):
    return _bm25(spark, sf, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def bm25_per_collection(spark, sf):
    return _bm25(spark, sf, 3, by="lang").select("query_id", "collection", "id", F.round("score", 6).alias("score"))


def _legs(spark, sf, n=20):
    """Dense and sparse hits of every benchmark item: by its text, and by the vector with its number. Both are used several times and written once."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    asks = _asks(spark, sf, "true").join(items, "query_id", "left_semi")
    d = cut(dense.nearest(_points(spark, sf), asks, n))
    s = _bm25(spark, sf, n).select("query_id", "id", "score", "rank")
    return d, cut(s)


_LEGS = f"WITH {_COS.format(ids='q.id IN (SELECT item_id FROM benchmark)', where='')}, {_bm25_sql(chr(39) + 'all' + chr(39), 20)}, dl AS (SELECT * FROM d WHERE rank <= 20), sl AS (SELECT * FROM b WHERE rank <= 20)"
_FUSED = """, u AS (SELECT query_id, id, 0.7 / (60 + rank) AS share, 0 AS leg, rank FROM dl UNION ALL SELECT query_id, id, 0.3 / (60 + rank), 1, rank FROM sl),
g AS (SELECT query_id, id, sum(share) AS fused, min({'leg': leg, 'at': rank}) AS seen FROM u GROUP BY ALL),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, seen.leg, seen.at) AS rank FROM g)"""


def rrf_fusion(spark, sf):
    d, s = _legs(spark, sf)
    return fusion.fuse([(d, 0.7), (s, 0.3)], 20).select("query_id", "id", F.round("fused", 9).alias("fused"), F.col("rank").cast("long"))


def _hybrid(spark, sf, limit):
    d, s = _legs(spark, sf)
    fused = fusion.fuse([(d, 0.7), (s, 0.3)], limit)
    only = s.join(d.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "rank")
    return d, s, fusion.reserve(fused, only, limit)


_RESERVE = """, o AS (SELECT query_id, id, rank FROM sl ANTI JOIN dl USING (query_id, id)), c AS (SELECT query_id, count(*) AS n FROM o GROUP BY ALL),
r AS (SELECT query_id, id, CASE WHEN rank <= {limit} - least(coalesce(n, 0), greatest(1, {limit} // 4)) THEN 0 ELSE 2 END AS bucket, rank FROM fu LEFT JOIN c USING (query_id) WHERE rank <= {limit}
      UNION ALL SELECT query_id, id, 1, rank FROM o),
m AS (SELECT query_id, id, min({{'bucket': bucket, 'at': rank}}) AS place FROM r GROUP BY ALL),
sl2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place.bucket, place.at) AS slot FROM m)"""


def rrf_sparse_reserve(spark, sf):
    return _hybrid(spark, sf, 12)[2].select("query_id", "id", F.col("slot").cast("long"))


def hybrid_search(spark, sf):
    """Flagship: both legs, fusion, reserve, provenance and raw leg score."""
    d, s, slots = _hybrid(spark, sf, 12)
    rows = slots.join(d.select("query_id", "id", F.col("score").alias("ds")), ["query_id", "id"], "left").join(s.select("query_id", "id", F.col("score").alias("ss")), ["query_id", "id"], "left")
    return rows.select("query_id", F.col("slot").cast("long"), "id", F.when(F.col("ds").isNotNull(), "dense").otherwise("sparse").alias("retrieval"), F.round(F.coalesce("ds", "ss"), 6).alias("score"))


HYBRID_SQL = f"""{_LEGS}{_FUSED}{_RESERVE.format(limit=12)}
SELECT query_id, slot, id, CASE WHEN dl.score IS NOT NULL THEN 'dense' ELSE 'sparse' END AS retrieval, round(coalesce(dl.score, sl.score), 6) AS score
FROM sl2 LEFT JOIN dl USING (query_id, id) LEFT JOIN sl USING (query_id, id) WHERE slot <= 12"""


def per_query_topk(spark, sf):
    """How many rows a query keeps depends on its decision."""
    k = F.when(F.col("query_id") % 2 == 0, 20).otherwise(3)
    hits = dense.nearest(_points(spark, sf), _asks(spark, sf), 20).where(F.col("rank") <= k)
    return hits.select("query_id", "id", F.col("rank").cast("long"))


def recency_boost(spark, sf):
    docs = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("score"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("s"))
    epoch = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 2 == 0, F.col("s") * 1000).otherwise(F.col("s"))
    return docs.select("o_orderkey", F.round(fusion.recency_boost(F.col("score"), epoch, 694224000.0 + 86400 * 1500), 9).alias("boosted"))


RECENCY_SQL = """
WITH e AS (SELECT o_orderkey, o_totalprice / 1e6 AS score, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN epoch(o_orderdate) * 1000 ELSE epoch(o_orderdate) END AS t FROM orders)
SELECT o_orderkey, round(CASE WHEN t IS NULL THEN score ELSE score + 0.1 * greatest(0.0, 1.0 - greatest(0.0, (694224000.0 + 86400 * 1500 - CASE WHEN t > 1e12 THEN t / 1000 ELSE t END) / 86400.0) / 365.0) END, 9) AS boosted FROM e
"""


def _hits(spark, sf):
    """All lines of the documents of a source as hits of a query, so that some hold others."""
    docs = spread(table(spark, sf, "documents").select("source", "doc_id", "text")).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).where("length(trim(text)) > 0")
    return docs.select("source", (F.col("doc_id") * LINES + F.col("at")).alias("id"), "text")


_HITS = f"""
h0 AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), h1 AS (SELECT source, doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS k FROM h0),
h AS (SELECT source, doc_id * {LINES} + k AS id, text FROM h1 WHERE length(trim(text, ' ')) > 0)"""
_KEY = r"sha256(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' '))"


def dedupe_exact(spark, sf):
    return context.dedupe(_hits(spark, sf), ["source"]).select("source", "id", F.sha2("text", 256).alias("text_sha"))


def dedupe_containment(spark, sf):
    return context.dedupe_contained(_hits(spark, sf), ["source"]).select("source", "id")


CONTAINMENT_SQL = f"""
WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY source, {_KEY} ORDER BY length(text) DESC, id) AS nth FROM h), e AS (SELECT source, id, text FROM k WHERE nth = 1)
SELECT source, id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.source = a.source AND length(b.text) > length(a.text) AND contains(b.text, a.text))
"""


def context_budget(spark, sf):
    """A text that is taken uses 9 characters of the budget at least, so hits beyond a ninth of it cannot be reached and no row gathers more. Blank ones use none, are never taken, and are not counted."""
    probe = spark.createDataFrame([("probe", 1, "filler " * 200), ("probe", 2, "ERROR: disk full on /dev/sda"), ("probe", 3, "tail")], "source string, id long, text string")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    full = _hits(spark, sf).unionByName(probe).where(F.regexp_replace("text", r"\s+", "") != "")
    near = full.withColumn("nth", nth).where(F.col("nth") <= 3000 // 9 + 1)
    rows = near.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("hits"))
    budget = F.when(F.col("source") == "probe", 120).otherwise(3000)
    return rows.select("source", F.explode(context.fit(F.col("hits"), budget)).alias("k")).select("source", "k.id", "k.text")


CONTEXT_SQL = rf"""
WITH RECURSIVE {_HITS}, al AS (SELECT source, id, text FROM h UNION ALL SELECT * FROM (VALUES ('probe', 1, repeat('filler ', 200)), ('probe', 2, 'ERROR: disk full on /dev/sda'), ('probe', 3, 'tail')) p(source, id, text)),
n AS (SELECT source, id, text, row_number() OVER (PARTITION BY source ORDER BY id) AS k, CASE WHEN source = 'probe' THEN 120 ELSE 3000 END AS budget,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CONSTRAINT}')), chr(10)) AS must, regexp_replace(text, '\s+', '', 'g') = '' AS blank FROM al),
f AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS ended, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS piece FROM n GROUP BY source
  UNION ALL SELECT source, k, used + CASE WHEN taken THEN length(short) + 8 ELSE 0 END, ended OR cut, CASE WHEN taken THEN id END, CASE WHEN taken THEN short END
  FROM (SELECT *, NOT blank AND NOT cut0 AS taken, NOT blank AND cut0 AS cut FROM (SELECT *, length(short) > room AS cut0 FROM (SELECT source, k, used, ended, id, blank, room,
    CASE WHEN length(s1) > room THEN s1[1:greatest(room, 0)] ELSE s1 END AS short FROM (SELECT n.source, n.k, f.used, f.ended, n.id, n.blank, budget - used AS room, CASE WHEN length(n.text) > budget - used AND must <> '' THEN must ELSE n.text END AS s1
    FROM f JOIN n ON n.source = f.source AND n.k = f.k + 1 WHERE NOT f.ended AND f.used < n.budget)))))
SELECT source, id, piece AS text FROM f WHERE id IS NOT NULL AND piece <> ''
"""


def context_prefix_budget(spark, sf):
    """Hits in order as long as all before them fit, without constraint lines."""
    rows = ordered.before(_hits(spark, sf), ["source"], [F.col("id").asc()], {"used": F.length("text") + 8})
    return rows.where(F.col("used") + F.length("text") <= 3000).select("source", "id", F.col("used").cast("long"))


def inject_budget(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length(F.trim("text"))).alias("existing"))
    size = F.when(F.col("conv_id") % 3 == 0, F.lit(None)).when(F.col("conv_id") % 3 == 1, 8192).otherwise(2048)
    return rows.select("conv_id", context.inject_budget(size.cast("int"), F.col("existing")).alias("budget"))


INJECT_SQL = """
WITH e AS (SELECT conv_id, sum(length(trim(text, ' '))) AS existing FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(greatest(0, CASE conv_id % 3 WHEN 0 THEN 8000 WHEN 1 THEN CAST(trunc(8192 * 0.25) AS BIGINT) * 4 ELSE CAST(trunc(2048 * 0.25) AS BIGINT) * 4 END - existing - 2048) AS BIGINT) AS budget FROM e
"""


def _firsts(spark, sf):
    """The hits of a source that are within its context: all before 8,000 characters are used."""
    return ordered.before(_hits(spark, sf), ["source"], [F.col("id").asc()], {"used": F.length("text") + 7}).where(F.col("used") + F.length("text") <= 8000)


def assemble_context(spark, sf):
    return context.assemble(_firsts(spark, sf), ["source"], "id")


ASSEMBLE_SQL = f"WITH {_HITS} SELECT source, '{context.PREFIX.strip()}' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id) AS context FROM (SELECT *, coalesce(sum(length(text) + 7) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h) WHERE used + length(text) <= 8000 GROUP BY source"


def note_recall(spark, sf):
    """Notes by key, text and age for every item: a phrase that stands in a note counts 1000, each shared word 1. Notes meet the items whose words they
    share; a note that holds a phrase holds its words but for the outer ones, which may be parts of its own, so phrases of one or two words are sought in every note,
    longer ones in notes that share all words but two."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0)))
    notes = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", F.lower(F.concat_ws(" ", F.col("source"), "lang", "text")).alias("hay"))
    asks = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("q"), words(F.col("text")).alias("ws"))
    wanted = asks.select("item_id", F.explode("ws").alias("w"))
    shared = notes.select("doc_id", F.explode(words(F.col("hay"))).alias("w")).join(wanted, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    short = notes.join(asks.where("size(ws) <= 2 AND q <> ''"), F.contains("hay", "q")).select("item_id", "doc_id", F.lit(0).cast("long").alias("shared"))
    pairs = shared.unionByName(short).groupBy("item_id", "doc_id").agg(F.max("shared").alias("shared"))
    pairs = cut(pairs)
    near = pairs.join(F.broadcast(asks), "item_id").where(F.col("shared") >= F.size("ws") - 2).select("item_id", "doc_id", "q")  # no other note can hold the phrase; only these meet texts
    held = near.join(notes, "doc_id").where(F.contains("hay", "q")).select("item_id", "doc_id", F.lit(1000).alias("whole")).distinct()
    scored = pairs.join(held, ["item_id", "doc_id"], "left").select("item_id", "doc_id", (F.col("shared") + F.coalesce("whole", F.lit(0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("doc_id")))
    return scored.where("score > 0").withColumn("rank", rank).where("rank <= 5").select("item_id", "doc_id", "score")


_W = r"list_distinct(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_\p{{M}}]+'))"
NOTE_SQL = rf"""
WITH n AS (SELECT doc_id, lower(concat_ws(' ', source, lang, text)) AS hay FROM documents), a AS (SELECT item_id, lower(text) AS q FROM benchmark), nw AS (SELECT *, {_W.format("hay")} AS hw FROM n), aw AS (SELECT *, {_W.format("q")} AS qw FROM a),
p AS (SELECT item_id, doc_id, CASE WHEN contains(hay, q) THEN 1000 ELSE 0 END + len(list_intersect(qw, hw)) AS score FROM nw CROSS JOIN aw),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM p WHERE score > 0) SELECT item_id, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""

_TOP = "WITH " + _COS.format(ids="q.id % 100 = 0", where="")
QUERIES = {
    "dense_topk": (dense_topk, f"{_TOP} SELECT query_id, id, round(score, 6) AS score, rank FROM d WHERE rank <= 5"),
    "dense_threshold": (dense_threshold, f"{_TOP} SELECT query_id, id, round(score, 6) AS score FROM d WHERE rank <= 10 AND score >= 0.3"),
    "dense_allowlist": (dense_allowlist, f"WITH {_COS.format(ids='q.id % 100 = 0', where='WHERE id IN (SELECT vec_id FROM embeddings WHERE label IN (1, 2))')} SELECT query_id, id, round(score, 6) AS score FROM d WHERE rank <= 5"),
    "dense_late_payload": (
        dense_late_payload,
        f"WITH {_COS.format(ids='q.id % 100 = 0', where='')} SELECT query_id, id, rank, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM d LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) p ON p.doc_id = d.id WHERE rank <= 8",
    ),
    "journal_replay": (journal_replay, JOURNAL_SQL),
    "fact_scores": (fact_scores, f"WITH {_COS.format(ids='q.id % 100 = 0', where='')} SELECT query_id, id, round(score, 6) AS score FROM s WHERE id % 50 <> 7"),
    "tokenize_counts": (tokenize_counts, f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)"),
    "bm25_df": (
        bm25_df,
        f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 3",
    ),
    "bm25_doclen": (bm25_doclen, f"SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS length, round(avg(len(t)) OVER (), 6) AS mean FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)"),
    "bm25_search": (bm25_search, f"WITH {_bm25_sql(chr(39) + 'all' + chr(39), 10, 'item_id = 0')} SELECT id, round(score, 6) AS score, rank FROM b WHERE rank <= 10"),
    "bm25_multi_query": (bm25_multi_query, f"WITH {_bm25_sql(chr(39) + 'all' + chr(39), 10)} SELECT query_id, id, round(score, 6) AS score, rank FROM b WHERE rank <= 10"),
    "bm25_per_collection": (bm25_per_collection, f"WITH {_bm25_sql('lang', 3)} SELECT query_id, collection, id, round(score, 6) AS score FROM b WHERE rank <= 3"),
    "rrf_fusion": (rrf_fusion, f"{_LEGS}{_FUSED} SELECT query_id, id, round(fused, 9) AS fused, rank FROM fu WHERE rank <= 20"),
    "rrf_sparse_reserve": (rrf_sparse_reserve, f"{_LEGS}{_FUSED}{_RESERVE.format(limit=12)} SELECT query_id, id, slot FROM sl2 WHERE slot <= 12"),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "per_query_topk": (per_query_topk, f"{_TOP} SELECT query_id, id, rank FROM d WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 20 ELSE 3 END"),
    "recency_boost": (recency_boost, RECENCY_SQL),
    "dedupe_exact": (
        dedupe_exact,
        f"WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY source, {_KEY} ORDER BY length(text) DESC, id) AS nth FROM h) SELECT source, id, sha256(text) AS text_sha FROM k WHERE nth = 1",
    ),
    "dedupe_containment": (dedupe_containment, CONTAINMENT_SQL),
    "context_budget": (context_budget, CONTEXT_SQL),
    "context_prefix_budget": (
        context_prefix_budget,
        f"WITH {_HITS}, u AS (SELECT *, coalesce(sum(length(text) + 8) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h) SELECT source, id, CAST(used AS BIGINT) AS used FROM u WHERE used + length(text) <= 3000",
    ),
    "inject_budget": (inject_budget, INJECT_SQL),
    "assemble_context": (assemble_context, ASSEMBLE_SQL),
    "note_recall": (note_recall, NOTE_SQL),
}
