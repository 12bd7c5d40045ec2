"""Chat messages and completions: clean-up before capture, parsing of response bodies, capture records, renderings for agents. All inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import none_if_blank, trimmed
from siltstone.operators.context import PREFIX
from siltstone.operators.text import is_real_query

#: What a proxy puts before the first system message, besides retrieved context (fixed value).
MEMORY_PREFIX = "Operational memory (session):\n"
NOTHING_FOUND = "No matching passages found in the knowledge base."
PREVIEW = 300

_CALLS = "array<struct<index:int,id:string,type:string,function:struct<name:string,arguments:string>>>"
_CALL = "struct<id:string,type:string,name:string,arguments:string>"


def _without_block(content: Column, prefix: str) -> Column:
    """A prefixed block goes with all up to the first blank line after it."""
    rest = F.substring(content, F.lit(len(prefix) + 1), F.length(content))
    at = F.instr(rest, F.lit("\n\n"))
    return F.when(content.startswith(prefix), F.when(at > 0, F.substring(rest, at + 2, F.length(rest))).otherwise("")).otherwise(content)


def clean(messages: Column, strip: bool = True) -> Column:
    """messages: array of struct(role, content). Blocks that a proxy added to a first system message go, then system messages without text."""
    def first(m: Column, i: Column) -> Column:
        content = m["content"]
        for prefix in (PREFIX, MEMORY_PREFIX):
            content = trimmed(_without_block(content, prefix))
        own = (i == 0) & (m["role"] == "system") & m["content"].isNotNull()
        return F.struct(m["role"].alias("role"), F.when(own, content).otherwise(m["content"]).alias("content"))

    out = F.transform(messages, first) if strip else messages
    return F.filter(out, lambda m: ~(m["role"].eqNullSafe(F.lit("system")) & (trimmed(m["content"]) == "")))


def exportable(query: Column, answer: Column) -> Column:
    return F.coalesce((trimmed(query) != "") & (trimmed(answer) != "") & is_real_query(query), F.lit(False))


def _json(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def _object(x: Column, path: str) -> Column:
    """The object at path as JSON text; null if it is something else."""
    found = _json(x, path)
    return F.when(found.startswith("{"), found)


def _last(values: Column) -> Column:
    full = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(full) > 0, F.element_at(full, -1))


def parsed(path: Column, body: Column, stream: Column) -> Column:
    """struct(content, tool_calls, finish_reason, usage, error) of a completion: one JSON body, server-sent events or JSON lines.
    Deltas are joined in order, fragments of a tool call by its index; a line that is no JSON, or a body without its message, is an error."""
    route = F.regexp_replace(path, r"/+$", "")
    text = lambda c: c.cast("string")
    none, no_calls = text(F.lit(None)), F.array().cast(f"array<{_CALL}>")

    def result(content, calls=None, finish=None, usage=None, error=None):
        return F.struct(content.alias("content"), (calls if calls is not None else no_calls).alias("tool_calls"), (finish if finish is not None else none).alias("finish_reason"), (usage if usage is not None else none).alias("usage"), (error if error is not None else none).alias("error"))

    def failed(why: str) -> Column:
        return result(none, error=F.lit(why))

    def merged(calls: Column) -> Column:
        numbers = F.array_sort(F.array_distinct(F.transform(calls, lambda c: F.coalesce(c["index"], F.lit(0)))))

        def one(i: Column) -> Column:
            own = F.filter(calls, lambda c: F.coalesce(c["index"], F.lit(0)) == i)
            return F.struct(
                _last(F.transform(own, lambda c: c["id"])).alias("id"), _last(F.transform(own, lambda c: c["type"])).alias("type"), _last(F.transform(own, lambda c: c["function"]["name"])).alias("name"),
                F.array_join(F.transform(own, lambda c: F.coalesce(c["function"]["arguments"], F.lit(""))), "").alias("arguments"),
            )

        return F.transform(numbers, one)

    rows = F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), trimmed), lambda x: x != "")
    data = F.filter(F.transform(F.filter(rows, lambda x: x.startswith("data:")), lambda x: trimmed(F.substring(x, 6, 1 << 30))), lambda x: x != "[DONE]")
    bad = lambda lines: F.exists(lines, lambda x: _json(x, "$").isNull())
    joined = lambda lines, at: F.array_join(F.transform(lines, lambda x: F.coalesce(_json(x, at), F.lit(""))), "")
    calls = F.flatten(F.transform(data, lambda x: F.coalesce(F.from_json(_json(x, "$.choices[0].delta.tool_calls"), _CALLS), F.array().cast(_CALLS))))
    events = result(joined(data, "$.choices[0].delta.content"), merged(calls), _last(F.transform(data, lambda x: _json(x, "$.choices[0].finish_reason"))), _last(F.transform(data, lambda x: _object(x, "$.usage"))))
    whole_calls = F.coalesce(F.from_json(_json(body, "$.choices[0].message.tool_calls"), _CALLS), F.array().cast(_CALLS))
    whole = result(_json(body, "$.choices[0].message.content"), F.transform(whole_calls, lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments"))), _json(body, "$.choices[0].finish_reason"), _object(body, "$.usage"))
    done = lambda x: F.when(_json(x, "$.done") == "true", F.lit("stop"))
    lines = result(joined(rows, "$.message.content"), finish=done(F.element_at(rows, -1)))
    return (
        F.when((route == "v1/chat/completions") & stream, F.when(bad(data), failed("invalid JSON")).otherwise(events))
        .when(route == "v1/chat/completions", F.when(_json(body, "$").isNull(), failed("invalid JSON")).when(_object(body, "$.choices[0].message").isNull(), failed("missing choices[0].message")).otherwise(whole))
        .when((route == "api/chat") & stream, F.when(bad(rows), failed("invalid JSON")).when(F.size(rows) == 0, result(F.lit(""))).otherwise(lines))
        .when(route == "api/chat", F.when(_json(body, "$").isNull(), failed("invalid JSON")).when(_object(body, "$.message").isNull(), failed("missing message")).otherwise(result(_json(body, "$.message.content"), finish=done(body))))
        .otherwise(result(none, error=F.concat(F.lit("unsupported chat path: "), route)))
    )


def sampled(trace: Column, rate: float) -> Column:
    """Whether a request is captured: by hash of its trace, so that a repeated run takes the same ones."""
    return F.pmod(F.xxhash64(trace), F.lit(1_000_000)) < int(max(0.0, min(1.0, rate)) * 1_000_000)


def capture(requests: DataFrame, rate: float = 1.0, preview: int = PREVIEW) -> DataFrame:
    """requests (trace_id, conversation_id, ts, path, stream, model, query_text, retrieval_query, messages, hits: array of struct(id, score, source, text), body) ->
    (record_type, trace_id, record): a rag_turn for each, and a finetune_turn where the turn is worth training on."""
    rows = requests.where(sampled(F.col("trace_id"), rate)).withColumn("p", parsed(F.col("path"), F.col("body"), F.col("stream"))).withColumn("sent", clean(F.col("messages")))
    answer, question = F.coalesce("p.content", F.lit("")), F.coalesce(none_if_blank("retrieval_query"), F.col("query_text"))
    head = ["ts", "trace_id", "conversation_id", F.regexp_replace("path", r"/+$", "").alias("path"), "model", "stream"]
    hits = F.transform("hits", lambda h: F.struct(h["id"].alias("id"), F.round(h["score"], 3).alias("score"), h["source"].alias("source"), F.substring(h["text"], 1, preview).alias("text_preview")))
    pair = F.when((question != "") & (answer != ""), F.struct(question.alias("question"), answer.alias("answer")))
    rag = F.struct(
        F.lit("rag_turn").alias("record_type"), *head, "query_text", "retrieval_query", F.size("hits").alias("chunks_injected"), F.transform("hits", lambda h: F.round(h["score"], 3)).alias("scores"), hits.alias("hits"),
        answer.alias("assistant_text"), pair.alias("qa_pair"), F.col("sent").alias("messages"), F.col("p.error").alias("parse_error"),
    )
    said = F.struct(F.lit("assistant").alias("role"), F.col("p.content").alias("content"), F.col("p.tool_calls").alias("tool_calls"))
    tuned = F.struct(F.lit("finetune_turn").alias("record_type"), *head, F.col("sent").alias("messages"), said.alias("assistant"), F.col("p.finish_reason").alias("finish_reason"), F.col("p.usage").alias("usage"))
    both = F.array(F.struct(F.lit("rag_turn").alias("record_type"), F.to_json(rag).alias("record")), F.when(F.col("p.error").isNull() & exportable(F.col("query_text"), F.col("p.content")), F.struct(F.lit("finetune_turn").alias("record_type"), F.to_json(tuned).alias("record"))))
    return rows.select("trace_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("r")).select("r.record_type", "trace_id", "r.record")


def for_agent(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """queries (query_id), hits (query_id, rank, title, source, score, retrieval, text) -> (query_id, shown): numbered passages in one text."""
    one = lambda h: F.format_string("### [%d] %s (score %.3f, %s)\nSource: `%s`\n\n%s\n", h["rank"], F.coalesce(none_if_blank(h["title"]), F.lit("Untitled")), h["score"], h["retrieval"], F.coalesce(none_if_blank(h["source"]), F.lit("unknown")), h["text"])
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "source", "score", "retrieval", "text"))).alias("hs"))
    body = F.concat(F.format_string("Found %d passage(s):\n\n", F.size("hs")), F.array_join(F.transform("hs", one), "\n"))
    return queries.join(ordered, "query_id", "left").select("query_id", F.coalesce(body, F.lit(NOTHING_FOUND)).alias("shown"))


def fact_hits(scores: DataFrame, facts: DataFrame, passages: DataFrame, k: int, excerpt: int = 2000) -> DataFrame:
    """scores (query_id, fact, score), facts (fact, triple), passages (fact, position, text): the k best facts above 0 of each query, with the first passage."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "fact"))
    best = scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= max(1, min(k, 20)))
    first = passages.join(best.select("fact").distinct(), "fact", "left_semi").groupBy("fact").agg(F.min_by(F.substring("text", 1, excerpt), "position").alias("excerpt"))
    rows = best.join(facts, "fact").join(first, "fact", "left")
    text = F.concat_ws("\n\n", "triple", none_if_blank("excerpt"))
    return rows.select("query_id", "rank", F.col("triple").alias("title"), F.lit("memory").alias("source"), "score", F.lit("facts").alias("retrieval"), text.alias("text"), "fact")


def latest_examples(records: DataFrame) -> DataFrame:
    """records (conversation_id, trace_id, ts, messages, assistant; a message has role and content) -> (key, messages): the latest record by ts (as text, null first; of ties the greatest) of each conversation, or of each trace
    where there is none, or by itself where there is neither. A message that repeats the one before goes, then those without role or content; two have to be left."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = records.select(F.coalesce(named("conversation_id"), named("trace_id"), F.expr("uuid()")).alias("key"), F.coalesce(F.col("ts").cast("string"), F.lit("")).alias("ts"), F.concat(F.coalesce("messages", F.array().cast(records.schema["messages"].dataType)), F.array("assistant")).alias("said"))
    rows = rows.groupBy("key").agg(F.max(F.struct("ts", "said")).alias("last")).select("key", "last.said")
    same = lambda a, b: a["role"].eqNullSafe(b["role"]) & a["content"].eqNullSafe(b["content"])
    kept = F.filter("said", lambda m, i: (i == 0) | ~same(m, F.get("said", i - 1)))
    kept = F.filter(kept, lambda m: (F.coalesce(m["role"], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != ""))
    return rows.select("key", kept.alias("messages")).where("size(messages) >= 2")
