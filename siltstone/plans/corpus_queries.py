"""Graph memory, audits, roll-ups, queue order, upserts, dataset jobs and event windows, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.text import trimmed
from siltstone.operators import graph, queue
from siltstone.operators import text as op
from siltstone.plans.text_queries import _SMELLS, _WINDOWS, TRIM
from siltstone.sources.tables import cut, drop, release, sql, table
from siltstone.streaming import events as ev

NOW = "TIMESTAMP '1998-12-01 00:00:00'"


def both(text: str, *names: str, spark_text: str | None = None):
    """A query whose SQL reads the same in either engine; tables are named in braces for Spark."""
    def run(spark, sf):
        return sql(spark, sf, spark_text or text, *names)

    plain = text
    for n in names:
        plain = plain.replace("{" + n + "}", n)
    return run, plain


#: Suppliers (two numbers each) that are sent to all, so that line items are not dealt once more.
MOST_SENT = 1_000_000


# Graph: facts are (supplier, returnflag, brand) of line items, a passage is an order, a schema (nation, flag, first word of the part's type).
def _mentions(spark, sf):
    line, part, supp = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    supp = supp.select("s_suppkey", "s_nationkey")
    if supp.count() <= MOST_SENT:
        supp = F.broadcast(supp)
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.concat_ws("|", F.col("s_nationkey").cast("string"), "l_returnflag", F.substring_index("p_type", " ", 1)).alias("schema"),
        F.concat_ws("|", F.col("l_suppkey").cast("string"), "l_returnflag", "p_brand").alias("fact"),
        F.col("l_orderkey").alias("passage"),
    ).groupBy("seq").agg(F.min(F.struct("schema", "fact", "passage")).alias("m")).select("seq", "m.*")


_MENTIONS = """
mentions AS (SELECT * FROM (SELECT l_orderkey * 100 + l_linenumber AS seq, s_nationkey || '|' || l_returnflag || '|' || string_split(p_type, ' ')[1] AS schema, l_suppkey || '|' || l_returnflag || '|' || p_brand AS fact, l_orderkey AS passage
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) QUALIFY row_number() OVER (PARTITION BY seq ORDER BY schema, fact) = 1)"""
_FACTS = "facts AS (SELECT fact, min_by(schema, seq) AS schema, count(DISTINCT passage) AS passages, count(*) AS mentions FROM mentions GROUP BY fact)"


def schema_frequency(spark, sf):
    return graph.encode(_mentions(spark, sf))[0]


def fact_table(spark, sf):
    return graph.encode(_mentions(spark, sf))[1]


def ontology_filter(spark, sf):
    return graph.frequent(_mentions(spark, sf), 5).select("seq", "schema", "fact")


def _facts(spark, sf):
    """Facts with their schema, and (fact, passage) rows, of all mentions, which are computed once."""
    m = cut(_mentions(spark, sf))
    return graph.encode(m)[1], m.select("fact", "passage").distinct()


_ADJ = f"""{_MENTIONS}, {_FACTS}, members AS (SELECT fact, 's' || schema AS g FROM facts UNION SELECT fact, 'p' || passage FROM mentions),
adj AS (SELECT DISTINCT a.fact AS src, b.fact AS dst FROM members a JOIN members b USING (g) WHERE a.fact <> b.fact)"""


def fact_adjacency(spark, sf):
    facts, members = _facts(spark, sf)
    return graph.degrees(facts, graph.links(facts, members))


def _edges(spark, sf):
    """Regions, nations, suppliers and customers as nodes, foreign keys as edges."""
    nation, supp, cust = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    e = nation.selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst", "'in' AS rel")
    e = e.union(supp.selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)", "'of'")).union(nation.selectExpr("concat('r', n_regionkey)", "concat('n', n_nationkey)", "'has'"))
    return e.union(cust.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)", "'buyer'"))


_EDGES = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS rel FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'of' FROM supplier
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'has' FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'buyer' FROM customer)"""


def graph_bfs(spark, sf):
    seeds = spark.createDataFrame([("s1",), ("s2",)], "node string")
    return graph.walk(_edges(spark, sf), seeds, 3).select("src", "dst", "rel", F.col("hop").cast("long"))


BFS_SQL = f"""
WITH RECURSIVE {_EDGES}, reach AS (SELECT * FROM (VALUES ('s1', 0), ('s2', 0)) v(node, d) UNION SELECT dst, d + 1 FROM reach JOIN edges ON src = node WHERE d < 2), near AS (SELECT node, min(d) AS d FROM reach GROUP BY node)
SELECT src, dst, rel, CAST(min(d) + 1 AS BIGINT) AS hop FROM edges JOIN near ON src = node GROUP BY ALL
"""


def graph_seed_match(spark, sf):
    nodes = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS id", "n_name AS name")
    words = spark.createDataFrame([("an",), ("uni",), ("zzz",), ("nation_1",)], "word string")
    return graph.seeds_by_name(nodes, words)


def _ppr(spark, sf):
    """(id, score) of all facts, the facts by id, and (passage, facts) rows. The walk starts at the five facts that are mentioned most."""
    m = cut(_mentions(spark, sf))
    release(spark)
    found = cut(m.groupBy("fact").agg(F.min_by("schema", "seq").alias("schema"), F.count("*").alias("mentions"), F.min("seq").alias("first")))
    seeds = found.orderBy(F.desc("mentions"), "fact").limit(5).select(F.col("fact").alias("node"), F.col("mentions").cast("double").alias("weight"))
    parts = graph.parts_of(spark, 4 * m.count())  # a passage has about four facts
    named = found.join(graph.sized(found, "schema"), "schema", "left").join(F.broadcast(graph.shares(seeds).withColumnRenamed("node", "fact")), "fact", "left")
    facts = graph.numbered(named.select("fact", "number", "many", "t", "first"), parts, "first", "fact")
    members = cut(m.select("fact", "passage").join(facts.select("fact", "id", "number"), "fact").repartition("passage").groupBy("passage").agg(F.collect_set(F.struct("id", "number")).alias("facts")))
    drop(m, found)
    release(spark)
    return graph.flow(facts, graph.shared(members), parts), facts, members


def ppr_scores(spark, sf):
    scores, facts, _ = _ppr(spark, sf)
    return scores.where("score > 0").join(facts.select("id", F.col("fact").alias("node")), "id").select("node", F.round("score", 9).alias("score"))


def _ppr_sql() -> str:
    steps = [f"""WITH {_ADJ}, deg AS (SELECT src, count(*) AS deg FROM adj GROUP BY src), nodes AS (SELECT src AS node FROM adj UNION SELECT dst FROM adj),
seed AS (SELECT fact AS node, mentions AS w FROM facts ORDER BY mentions DESC, fact LIMIT 5), base AS MATERIALIZED (SELECT node, coalesce(w, 0) / (SELECT sum(w) FROM seed) AS t FROM nodes LEFT JOIN seed USING (node)), links AS MATERIALIZED (SELECT adj.src, dst, deg FROM adj JOIN deg USING (src)),
p0 AS MATERIALIZED (SELECT node, t AS score FROM base)"""]
    for i in range(graph.STEPS):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT base.node, 0.15 * t + 0.85 * coalesce(flow, 0) AS score FROM base LEFT JOIN (SELECT dst AS node, sum(score / deg) AS flow FROM links JOIN p{i} ON node = src GROUP BY dst) USING (node))")
    return ", ".join(steps)


PPR_SQL = f"{_ppr_sql()} SELECT node, round(score, 9) AS score FROM p{graph.STEPS} WHERE score > 0"


def _passages(spark, sf):
    scores, _, members = _ppr(spark, sf)
    return scores.where("score > 0").join(members.select("passage", F.explode("facts.id").alias("id")), "id").groupBy("passage").agg((F.sum("score") * 0.5).alias("score"))


def passage_from_facts(spark, sf):
    return _passages(spark, sf).select("passage", F.round("score", 9).alias("score"))


def memgraph_retrieve(spark, sf):
    """Seeds, walk, passages, the five best."""
    rank = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "passage"))
    top = _passages(spark, sf).orderBy(F.round("score", 9).desc(), "passage").limit(5)
    return top.withColumn("rank", rank.cast("long")).select("rank", "passage", F.round("score", 9).alias("score"))


_PASS = f"{_ppr_sql()}, pp AS (SELECT passage, sum(score) * 0.5 AS score FROM p{graph.STEPS} JOIN (SELECT DISTINCT fact AS node, passage FROM mentions) USING (node) WHERE score > 0 GROUP BY passage)"


def cascade_prune(spark, sf):
    m = _mentions(spark, sf)
    facts = graph.encode(m)[1].select("fact", "schema")
    links = m.select("fact", "passage").distinct()
    gone = m.where("passage % 4 = 1").select("passage").distinct()
    left, alive, schemas = graph.prune(m.select("passage").distinct(), links, facts, gone)
    return left.selectExpr("'passage' AS kind", "cast(passage AS string) AS name").union(alive.selectExpr("'fact'", "fact")).union(schemas.selectExpr("'schema'", "schema"))


PRUNE_SQL = f"""
WITH {_MENTIONS}, {_FACTS}, alive AS (SELECT fact, schema FROM facts WHERE fact IN (SELECT fact FROM mentions WHERE passage % 4 <> 1))
SELECT DISTINCT 'passage' AS kind, CAST(passage AS VARCHAR) AS name FROM mentions WHERE passage % 4 <> 1 UNION ALL SELECT 'fact', fact FROM alive UNION ALL SELECT DISTINCT 'schema', schema FROM alive
"""


# Audits.
def audit_by_source(spark, sf):
    flags = op.smells(F.col("t"))
    docs = table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("t"))
    bad = flags["wayback_js"] | flags["json_ld"] | flags["css_leak"]
    rows = docs.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(bad).alias("smelly"), F.count_if(F.length("t") < 200).alias("short"), F.sum(F.length("t")).alias("chars"))
    return rows.withColumn("short_pct", F.round(100.0 * F.col("short") / F.col("chunks"), 2)).orderBy(F.desc("chunks"), "source").limit(20)


AUDIT_SQL = f"""
WITH d AS (SELECT source, coalesce(text, '') AS t FROM documents), f AS (SELECT source, t, {_SMELLS} FROM d)
SELECT source, count(*) AS chunks, count(*) FILTER (WHERE wayback_js OR json_ld OR css_leak) AS smelly, count(*) FILTER (WHERE length(t) < 200) AS short, CAST(sum(length(t)) AS BIGINT) AS chars,
       round(100.0 * count(*) FILTER (WHERE length(t) < 200) / count(*), 2) AS short_pct FROM f GROUP BY source ORDER BY chunks DESC, source LIMIT 20
"""


def smell_totals(spark, sf):
    from siltstone.plans.text_queries import PROBES

    rows = table(spark, sf, "documents").select(F.col("text").alias("t")).union(spark.createDataFrame([(p,) for p in PROBES], "t string"))
    return rows.agg(F.count("*").alias("scanned"), *[F.count_if(c).alias(n) for n, c in op.smells(F.col("t")).items()])


def _smell_totals_sql() -> str:
    from siltstone.plans.text_queries import PROBE_SQL

    return f"SELECT count(*) AS scanned, count(*) FILTER (WHERE wayback_js) AS wayback_js, count(*) FILTER (WHERE json_ld) AS json_ld, count(*) FILTER (WHERE css_leak) AS css_leak FROM (SELECT {_SMELLS} FROM (SELECT text AS t FROM documents UNION ALL SELECT q FROM {PROBE_SQL}))"


def chunk_stats(spark, sf):
    cut = op.windows(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.count_if(F.col("token_count") < 64).alias("small"))


def stratified_alloc(spark, sf):
    """Shares of 100 samples: half-even rounding, at least 1, as long as the target lasts, largest sources first; with fewer samples than sources, one each."""
    return _alloc(spark, sf).select("source", "n", F.col("take").cast("long"))


def _alloc(spark, sf, target=100):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total, strata = F.sum("n").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    rows = counts.withColumn("want", F.when(strata > target, 1).otherwise(F.greatest(F.lit(1), F.bround(target * F.col("n") / total))).cast("long"))
    w = Window.orderBy(F.desc("n"), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("want").over(w), F.lit(0)))
    return rows.withColumn("take", F.greatest(F.lit(0), F.least(F.col("want"), target - F.col("before")))).where("take > 0")


_ALLOC = """
c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), w AS (SELECT source, n, greatest(1, CAST(round_even(100 * n / sum(n) OVER (), 0) AS BIGINT)) AS want FROM c),
b AS (SELECT *, coalesce(sum(want) OVER (ORDER BY n DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w), al AS (SELECT source, n, CAST(least(want, 100 - before) AS BIGINT) AS take FROM b WHERE least(want, 100 - before) > 0)"""


def stratified_sample(spark, sf):
    """The allocated number of rows of each source, in the order of a hash. No source is given more than all 100, so each task drops the others before rows are shuffled."""
    order = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))))
    docs = table(spark, sf, "documents").select("doc_id", "source").withColumn("nth", order).where("nth <= 100")
    return docs.join(F.broadcast(_alloc(spark, sf).select("source", "take")), "source").where("nth <= take").select("source", "doc_id")


# Datasets of conversations.
def _new_turns(turns):
    """Turns without those that repeat the role and text of the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    again = F.lag("role").over(w).eqNullSafe(F.col("role")) & F.lag("text").over(w).eqNullSafe(F.col("text")) & (F.row_number().over(w) > 1)
    return turns.withColumn("again", again).where("NOT again").drop("again")


def dedupe_consecutive(spark, sf):
    return _new_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


def export_finetune(spark, sf):
    turns = _new_turns(table(spark, sf, "conversations")).where((trimmed("text") != "") & F.col("role").isNotNull())
    msgs = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_join(F.transform(msgs, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("example"))
    return rows.where("messages >= 2").select("conv_id", "messages", F.md5("example").alias("example_md5"))


def promote_qa(spark, sf):
    """User turns and the assistant's next, if both are worth keeping, as Q and A with a stable index."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": trimmed(F.lead("text").over(w)), "question": trimmed("text")})
    good = (F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("question") != "") & op.is_real_query(F.col("question")) & (F.length("answer") >= 100)
    seed = F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    return rows.where(good).select("conv_id", "turn", F.conv(F.substring(seed, 1, 8), 16, 10).cast("long").alias("idx"), F.md5(F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer")).alias("doc_md5"))


PROMOTE_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, {TRIM.format("text")} AS question, lead(role) OVER w AS next_role, {TRIM.format("lead(text) OVER w")} AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(('0x' || sha256(conv_id || ':' || turn)[1:8])::UBIGINT AS BIGINT) AS idx, md5('Q: ' || question || chr(10) || chr(10) || 'A: ' || answer) AS doc_md5 FROM t
WHERE role = 'user' AND next_role = 'assistant' AND question <> '' AND length(answer) >= 100 AND NOT (starts_with(lower(question[1:400]), '### task:') OR (contains(lower(question[1:400]), 'follow-up') AND contains(lower(question[1:400]), 'suggest')) OR contains(lower(question[1:400]), 'relevant follow-up questions'))
"""


def merge_pages(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return rows.select("conv_id", F.size("parts").cast("long").alias("pages"), F.length(body).cast("long").alias("chars"), F.md5(body).alias("body_md5"))


def missing_pages(spark, sf):
    """Turns that are missing after every fifth row is taken away."""
    rows = table(spark, sf, "conversations").where("(conv_id + turn) % 5 <> 0").groupBy("conv_id").agg(F.collect_set("turn").alias("have"))
    gaps = F.array_except(F.sequence(F.lit(0).cast("long"), F.array_max("have")), F.col("have"))
    return rows.select("conv_id", F.array_join(F.array_sort(gaps), ",").alias("missing"), F.size(gaps).cast("long").alias("n"))


MISSING_SQL = """
WITH h AS (SELECT conv_id, list(DISTINCT turn) AS have FROM conversations WHERE (conv_id + turn) % 5 <> 0 GROUP BY conv_id), g AS (SELECT conv_id, list_filter(range(0, list_max(have) + 1), lambda x: NOT list_contains(have, x)) AS m FROM h)
SELECT conv_id, coalesce(array_to_string(m, ','), '') AS missing, CAST(len(m) AS BIGINT) AS n FROM g
"""

# The queue: orders as files.
_BAND = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'mid' END"
_QUEUE = f"""(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'indexed' END AS status, {_BAND} AS priority,
  CASE {_BAND} WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS band, o_orderdate AS updated_at, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey AS chunks FROM {{orders}}) AS q"""


def _queued(spark, sf):
    return sql(spark, sf, f"SELECT id, status, band, updated_at, size, concat('f', id % 97) AS file_name FROM {_QUEUE} WHERE status = 'pending'", "orders")


def queue_order(spark, sf):
    """All pending rows, largest first within a band, with their places."""
    return queue.places(_queued(spark, sf), queue.order("size", descending=True)).select("id", "place")


def queue_order_by_name(spark, sf):
    return queue.places(_queued(spark, sf), queue.order("name")).select("id", "place")


_PENDING = f"(SELECT id, status, band, updated_at, size, concat('f', id % 97) AS file_name FROM {_QUEUE.replace('{orders}', 'orders')} WHERE status = 'pending') p"


def throughput_rates(spark, sf):
    """Rates a minute of each type of event, from the last event against the counts 5 and 15 minutes (of this table's time: days and weeks are 288 and
    2,016 of them) earlier: counts by minute are added up, so that no task numbers the events of a type."""
    spans = {"5m": 300, "15m": 900, "day": 86400, "week": 604800}
    rows = table(spark, sf, "events").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("t"))
    last = rows.groupBy("event_type").agg(F.max("t").alias("now"), F.min("t").alias("from"), F.count("*").alias("total"))
    late = rows.join(last.select("event_type", "now"), "event_type")  # a row for each type: broadcast at run time if they are few
    counts = late.groupBy("event_type").agg(*[F.count_if(F.col("t") > F.col("now") - n).alias(f"n_{k}") for k, n in spans.items()], *[F.max(F.when(F.col("t") <= F.col("now") - n, F.col("t"))).alias(f"t_{k}") for k, n in spans.items()])
    rate = lambda k: F.round(F.when(F.col(f"t_{k}").isNull(), F.col("total") - 1).otherwise(F.col(f"n_{k}")) / ((F.col("now") - F.coalesce(f"t_{k}", "from")) / 60.0), 6)
    return last.join(counts, "event_type").select("event_type", *[rate(k).alias(f"rate_{k}") for k in spans])


def _throughput_sql() -> str:
    spans = {"5m": 300, "15m": 900, "day": 86400, "week": 604800}
    parts = ", ".join(f"count(*) FILTER (WHERE t > now - {n}) AS n_{k}, max(t) FILTER (WHERE t <= now - {n}) AS t_{k}" for k, n in spans.items())
    rates = ", ".join(f"round(CASE WHEN t_{k} IS NULL THEN total - 1 ELSE n_{k} END / ((now - coalesce(t_{k}, since)) / 60.0), 6) AS rate_{k}" for k in spans)
    return f"WITH r AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), l AS (SELECT event_type, max(t) AS now, min(t) AS since, count(*) AS total FROM r GROUP BY event_type), c AS (SELECT event_type, now, since, total, {parts} FROM r JOIN l USING (event_type) GROUP BY ALL) SELECT event_type, {rates} FROM c"


THROUGHPUT_SQL = _throughput_sql()


def latency_histogram(spark, sf):
    """Cumulative buckets, as a metrics page shows them."""
    bounds = spark.createDataFrame([(b,) for b in (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)], "le double")
    e = table(spark, sf, "events").select("event_type", "value")
    rows = e.join(F.broadcast(bounds), F.col("value") <= F.col("le")).groupBy("event_type", "le").agg(F.count("*").alias("n"))
    all_ = e.select("event_type").distinct().crossJoin(F.broadcast(bounds))
    return all_.join(rows, ["event_type", "le"], "left").select("event_type", "le", F.coalesce("n", F.lit(0)).alias("n"))


def sliding_failures(spark, sf):
    return ev.sliding_counts(table(spark, sf, "events").where("event_type = 'error'"), 5 * 86400, 3)


def session_gaps(spark, sf):
    return ev.sessions(table(spark, sf, "events"), 86400)


def tumbling_counts(spark, sf):
    return ev.tumbling(table(spark, sf, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def rolling_memory(spark, sf):
    """Summaries are refreshed at every second user turn (a session's are at every eighth; few conversations here have so many); the last refresh stays."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").where("role = 'user'").withColumn("nth", F.row_number().over(w)).where("nth % 2 = 0")
    return rows.groupBy("conv_id").agg(F.max_by(F.substring("text", 1, 500), "turn").alias("summary"), F.max("nth").cast("long").alias("turns"))


def upsert_lww(spark, sf):
    """Writes of a key in order; the last wins: an aggregate of (time, value), combined before the shuffle."""
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id", "event_type", "value").alias("w"))
    return e.groupBy("user_id").agg(F.max("w").alias("w")).select("user_id", "w.event_id", "w.event_type", "w.value")


_LATEST = """WITH p AS (SELECT p_partkey, p_brand AS base, CASE WHEN p_size = 50 THEN 'latest' WHEN p_size = 49 THEN 'previous' ELSE '2026-' || lpad(CAST(p_size % 12 + 1 AS {str}), 2, '0') END AS stamp FROM {part}),
k AS (SELECT *, CASE stamp WHEN 'latest' THEN 999912 WHEN 'previous' THEN 999812 ELSE CAST(replace(stamp, '-', '') AS INT) END AS ord FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord DESC, p_partkey DESC) AS nth, count(*) OVER (PARTITION BY base) - 1 AS hidden FROM k) SELECT base, p_partkey, stamp, hidden FROM r WHERE nth = 1"""


def latest_per_package(spark, sf):
    return sql(spark, sf, _LATEST.replace("{str}", "STRING"), "part")


_SYNC = """SELECT coalesce(d.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN d.id IS NULL THEN 'missing' WHEN s.st = 'F' THEN 'retry' ELSE 'same' END AS act
FROM (SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 5 <> 0) d FULL OUTER JOIN (SELECT o_orderkey AS id, o_orderstatus AS st FROM {orders} WHERE o_orderkey % 7 <> 0) s ON d.id = s.id"""
_MERGE = """SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 END AS price FROM {orders} WHERE o_orderkey % 4 <> 1) n
FULL OUTER JOIN (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM {orders} WHERE o_orderkey % 4 <> 2) o ON n.id = o.id"""
_SLIDE = """SELECT user_id, event_id, CAST(n AS BIGINT) AS n, n >= 3 AS locked FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 432000 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')"""
_SESSION = """WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 86400 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds FROM s GROUP BY user_id, session"""

QUERIES = {
    "schema_frequency": (schema_frequency, f"WITH {_MENTIONS} SELECT schema, count(*) AS frequency FROM mentions GROUP BY schema"),
    "fact_table": (fact_table, f"WITH {_MENTIONS}, {_FACTS} SELECT * FROM facts"),
    "ontology_filter": (ontology_filter, f"WITH {_MENTIONS} SELECT seq, schema, fact FROM mentions QUALIFY count(*) OVER (PARTITION BY schema) >= 5"),
    "fact_adjacency": (fact_adjacency, f"WITH {_ADJ} SELECT src, count(*) AS degree, min(dst) AS first FROM adj GROUP BY src"),
    "graph_bfs": (graph_bfs, BFS_SQL),
    "graph_seed_match": (graph_seed_match, "SELECT word, 'n' || n_nationkey AS id, n_name AS name FROM nation JOIN (VALUES ('an'), ('uni'), ('zzz'), ('nation_1')) w(word) ON contains(lower(n_name), word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY 'n' || n_nationkey) <= 10"),
    "ppr_scores": (ppr_scores, PPR_SQL),
    "passage_from_facts": (passage_from_facts, f"{_PASS} SELECT passage, round(score, 9) AS score FROM pp"),
    "memgraph_retrieve": (memgraph_retrieve, f"{_PASS} SELECT row_number() OVER (ORDER BY round(score, 9) DESC, passage) AS rank, passage, round(score, 9) AS score FROM pp ORDER BY rank LIMIT 5"),
    "cascade_prune": (cascade_prune, PRUNE_SQL),
    "orphan_sources": both("SELECT source, count(*) AS n FROM {documents} WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT concat('src', s_suppkey % 15) AS known FROM {supplier}) k WHERE known = source) GROUP BY source", "documents", "supplier"),
    "audit_by_source": (audit_by_source, AUDIT_SQL),
    "smell_totals": (smell_totals, _smell_totals_sql()),
    "leftover_sources": both("SELECT coalesce(nullif(source, ''), '(empty)') AS src, count(*) AS n, sum(CASE WHEN length(text) < 100 THEN 1 ELSE 0 END) AS tiny FROM {documents} WHERE source NOT IN ('src1', 'src2') GROUP BY 1", "documents"),
    "status_counts": both("SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus", "orders"),
    "queue_stats": both(f"SELECT sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS running, sum(CASE WHEN status = 'running' AND updated_at < {NOW} - INTERVAL '30' DAY THEN 1 ELSE 0 END) AS stalled, sum(CASE WHEN status = 'indexed' THEN 1 ELSE 0 END) AS indexed, sum(chunks) AS total_chunks, sum(CASE WHEN status <> 'indexed' THEN chunks ELSE 0 END) AS queue_chunks FROM {_QUEUE}", "orders"),
    "queue_visible": both(f"SELECT id, status, priority, status = 'running' AND updated_at < {NOW} - INTERVAL '30' DAY AS is_stalled FROM {_QUEUE} WHERE NOT (status = 'indexed' AND updated_at < {NOW} - INTERVAL '90' DAY)", "orders"),
    "queue_order": (queue_order, f"SELECT id, row_number() OVER (ORDER BY band, size DESC, updated_at, id) AS place FROM {_PENDING}"),
    "queue_order_by_name": (queue_order_by_name, f"SELECT id, row_number() OVER (ORDER BY band, file_name, updated_at, id) AS place FROM {_PENDING}"),
    "claim_next": both(f"SELECT id, priority, updated_at FROM {_QUEUE} WHERE status = 'pending' ORDER BY band, updated_at, id LIMIT 1", "orders"),
    "pending_topn": both(f"SELECT id, priority, size FROM {_QUEUE} WHERE status = 'pending' ORDER BY updated_at DESC NULLS LAST, id LIMIT 10", "orders"),
    "status_transition": both(f"SELECT status, new_status, count(*) AS n FROM (SELECT status, CASE WHEN status = 'running' AND updated_at < {NOW} - INTERVAL '30' DAY THEN 'pending' WHEN status = 'indexed' AND size % 10 = 0 THEN 'pending' ELSE status END AS new_status FROM {_QUEUE}) t GROUP BY status, new_status", "orders"),
    "throughput_rates": (throughput_rates, THROUGHPUT_SQL),
    "stratified_alloc": (stratified_alloc, f"WITH {_ALLOC} SELECT source, n, take FROM al"),
    "stratified_sample": (stratified_sample, f"WITH {_ALLOC}, d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id)) AS nth FROM documents) SELECT source, doc_id FROM d JOIN al USING (source) WHERE nth <= take"),
    "dedupe_consecutive": (dedupe_consecutive, "SELECT conv_id, turn, role, text FROM (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(text) OVER w IS NOT DISTINCT FROM text AND row_number() OVER w > 1 AS again FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE NOT again"),
    "export_finetune": (export_finetune, rf"WITH t AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(text) OVER w IS NOT DISTINCT FROM text AND row_number() OVER w > 1 AS again FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, count(*) AS messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS example_md5 FROM t WHERE NOT again AND {TRIM.format('text')} <> '' AND role IS NOT NULL GROUP BY conv_id HAVING count(*) >= 2"),
    "promote_qa": (promote_qa, PROMOTE_SQL),
    "latest_per_package": (latest_per_package, _LATEST.replace("{str}", "VARCHAR").replace("{part}", "part")),
    "latency_histogram": (latency_histogram, "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events CROSS JOIN (VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0)) b(le) GROUP BY event_type, le"),
    "outcome_counts": both("SELECT CASE WHEN event_type IN ('signup') THEN 'skip' WHEN event_type IN ('purchase', 'click') THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM {events} GROUP BY 1", "events"),
    "knee_pick": both("SELECT min(c) AS concurrency, max(CASE WHEN nth = 1 THEN rate END) AS rate FROM (SELECT c, rate, row_number() OVER (ORDER BY c) AS nth FROM (SELECT c, rate, max(rate) OVER () AS best FROM (VALUES (1, 6505.0), (2, 15082.0), (3, 14400.0)) AS r(c, rate)) t WHERE rate >= 0.9 * best) k"),
    "capacity_min_caps": both("SELECT host, greatest(1, least(cpu, ram, gpu)) AS files, CASE WHEN cpu <= ram AND cpu <= gpu THEN 'cpu' WHEN ram <= gpu THEN 'ram' ELSE 'gpu' END AS why FROM (SELECT host, CAST(floor(cores / 2) AS INT) AS cpu, CAST(floor(ram_mib / 4096) AS INT) AS ram, CAST(floor(gpu_mib / 1024) AS INT) AS gpu FROM (VALUES ('a', 16, 32768, 20480), ('b', 6, 53248, 32768), ('c', 64, 8192, 4096), ('d', 1, 1024, 0)) AS h(host, cores, ram_mib, gpu_mib)) x"),
    "merge_pages": (merge_pages, "SELECT conv_id, count(*) AS pages, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS BIGINT) AS chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY conv_id"),
    "missing_pages": (missing_pages, MISSING_SQL),
    "chunk_stats": (chunk_stats, f"WITH {_WINDOWS} SELECT doc_id, count(*) AS chunks, min(token_count) AS least, max(token_count) AS most, count(*) FILTER (WHERE token_count < 64) AS small FROM chunks GROUP BY doc_id"),
    "upsert_lww": (upsert_lww, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "rolling_memory": (rolling_memory, "WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'user') SELECT conv_id, max_by(text[1:500], turn) AS summary, max(nth) AS turns FROM u WHERE nth % 2 = 0 GROUP BY conv_id"),
    "merge_coalesce": both(_MERGE, "orders"),
    "sync_diff": both(_SYNC, "orders"),
    "index_reconcile": both("SELECT lang, docs, vecs, docs <> vecs AS rebuild FROM (SELECT lang, count(*) AS docs, count(vec_id) AS vecs FROM {documents} LEFT JOIN {embeddings} ON vec_id = doc_id GROUP BY lang) t", "documents", "embeddings"),
    "sliding_failures": (sliding_failures, _SLIDE),
    "session_gaps": (session_gaps, _SESSION),
    "tumbling_counts": (tumbling_counts, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
}

#: Names that some of these had while others took subsets.
QUERIES |= {f"{name}_all": QUERIES[name] for name in ("schema_frequency", "fact_table", "ontology_filter", "cascade_prune", "graph_bfs", "queue_order")}
QUERIES["dedupe_consecutive_text"] = QUERIES["dedupe_consecutive"]
