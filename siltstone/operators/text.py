"""Cleaning, classifying and cutting texts: row-wise operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import col, count_of, holds_any, let, lines, none_if_blank, split_words, trimmed, word_overlap

# Patterns and word lists of the retrieval policy (fixed values).
GREETING = r"(?i)^(hi|hello|hey|howdy|thanks|thank you|good morning|good afternoon|good evening|good night)\b"
ACKNOWLEDGED = r"(?i)^(ok(?:ay)?|k{1,2}|sure|yep|yup|cool|great|perfect|got\s+it|noted|understood|cheers|np|no\s+problem|thx|ty)[.!]*$"
INFRA = (
    r"(?i)(/[\w.-]+|\\\\[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|"
    r"\b(error|exception|failed|traceback|kubectl|docker|systemctl|qdrant|llama|nomad|compose)\b|\b[A-Z]{2,}\d+\b|v?\d+\.\d+\.\d+)"
)
LOG_LINE = r"(?im)^\d{4}-\d{2}-\d{2}|ERROR|WARN|FATAL|traceback"
CODE_FILE = r"(?i)\.(py|rs|go|ts|js|yaml|yml|toml|md)\b"
BOILERPLATE = (
    r"(?i)(cookie(s)?|subscribe|newsletter|sign[\s-]?up|accept all|privacy policy|terms of (service|use)|all rights reserved|"
    r"skip to (main )?content|enable javascript|we use cookies|manage preferences|gdpr|do not sell)"
)
CODE_LINE = r"^\s*(def |class |import |from |function |const |var |#include |package )"
NAMESPACE = r"(?i)\b(Category|File|Image|Template|Special|User|Wikipedia|Help|Portal|Talk|Module|MediaWiki|Draft):"
PATH_HINTS = ("/wiki/", "a/category:", "a/file:", "a/template:", "a/special:")
ACADEMIC = ("abstract", "introduction", "arxiv:", "doi:", "proceedings", "figure ", "theorem", "references\n")
CONSTRAINT = r"(?i)\b(ERROR|FATAL|failed|must not|dependency)\b"
GLOSSARY = {"k8s": "kubernetes", "omv": "openmediavault"}
LITERAL = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|v?\d+\.\d+\.\d+(?:[-+][\w.]+)?|/[\w./-]+|\\[\w.\\-]+"
#: Start and end markers of a digitised book, in order of preference (fixed values).
BOOK_START = ("*** START OF THE PROJECT GUTENBERG EBOOK", "*** START OF THIS PROJECT GUTENBERG EBOOK", "***START OF THE PROJECT GUTENBERG EBOOK")
BOOK_END = (
    "*** END OF THE PROJECT GUTENBERG EBOOK",
    "*** END OF THIS PROJECT GUTENBERG EBOOK",
    "***END OF THE PROJECT GUTENBERG EBOOK",
    "End of the Project Gutenberg",
    "End of Project Gutenberg",
)


def file_type(path: str | Column) -> Column:
    """What an ingest makes of a path: zim, text, pdf, corpus_jsonl or unknown."""
    name = F.element_at(F.split(col(path), "/"), -1)
    low = F.lower(name)
    stem = F.regexp_replace(low, r"\.[^.]*$", "")
    return (
        F.when(name == "kiwix-library.xml", "unknown")
        .when(low.rlike(r".\.jsonl$") & stem.contains("corpus"), "corpus_jsonl")
        .when(low.rlike(r".\.zim$"), "zim")
        .when(low.rlike(r".\.(txt|md)$"), "text")
        .when(low.rlike(r".\.pdf$"), "pdf")
        .otherwise("unknown")
    )


def normalize_plain(text: str | Column) -> Column:
    """One space for each run of white space; null below 80 characters."""
    t = trimmed(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(t) >= 80, t)


def is_wiki_namespace(title: Column, url: Column) -> Column:
    return title.rlike(NAMESPACE) | url.rlike(NAMESPACE)


def looks_like_wiki(title: Column, url: Column) -> Column:
    return is_wiki_namespace(title, url) | holds_any(F.lower(F.concat(title, F.lit("\n"), url)), PATH_HINTS)


def strip_tags(html: str | Column) -> Column:
    """Flat text: scripts, styles and tags become a space, common entities are decoded, white space is collapsed."""
    t = F.regexp_replace(col(html), r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return trimmed(F.regexp_replace(t, r"\s+", " "))


def between_markers(text: str | Column, starts: tuple[str, ...] = BOOK_START, ends: tuple[str, ...] = BOOK_END) -> Column:
    """From the line after the first start marker that occurs to the first end marker that occurs."""
    t = col(text)
    begin, end = F.lit(0), F.length(t)
    for m in reversed(starts):
        at = F.instr(t, F.lit(m))
        newline = F.instr(F.substring(t, at, F.length(t)), F.lit("\n"))
        begin = F.when(at > 0, F.when(newline > 0, at + newline - 1).otherwise(at - 1 + len(m))).otherwise(begin)
    for m in reversed(ends):
        at = F.instr(t, F.lit(m))
        end = F.when(at > 0, at - 1).otherwise(end)
    return trimmed(F.when(end > begin, F.substring(t, begin + 1, end - begin)).otherwise(""))


def drop_boilerplate(text: str | Column) -> Column:
    """Without short lines of consent, sign-up and rights notices; at most one blank line in a row."""
    def keep(line: Column) -> Column:
        bare = trimmed(line)
        return (bare == "") | (F.length(bare) >= 200) | ~bare.rlike(BOILERPLATE)

    kept = F.transform(F.filter(lines(text), keep), lambda x: F.when(trimmed(x) == "", "").otherwise(x))
    return trimmed(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def chunk_strategy(kind: Column, path: Column, text: Column, trim: bool = True) -> Column:
    """How a text should be cut: recursive, sentence, semantic, token or code. The text is trimmed (unless it is already) and split into lines once."""
    def of_lines(t: Column, rows: Column) -> Column:
        head = F.slice(rows, 1, 120)
        code_share = F.size(F.filter(head, lambda x: x.rlike(CODE_LINE))) / F.size(head)
        return let(F.filter(rows, lambda x: x.rlike(r"\S")), lambda full: decide(t, code_share, full))

    def decide(t: Column, code_share: Column, full: Column) -> Column:
        mean = F.aggregate(full, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.size(full)
        junk = lambda breaks: ((breaks == 0) & (mean > 160)) | ((breaks <= 1) & (F.size(full) > 40) & (mean > 120))
        table = t.rlike(r"(?m)^\|.+\|\s*$") & t.rlike(r"(?m)^\|[\s\-:|]+\|\s*$")
        marked = lambda breaks: (breaks >= 3) | t.rlike(r"(?m)^---\s*\n") | t.rlike(r"(?m)^#{1,6}\s+\S") | table
        low_path, head_text = F.lower(path), F.lower(F.substring(t, 1, 4000))
        stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
        markers = sum(head_text.contains(m).cast("int") for m in ACADEMIC)
        academic = (kind == "pdf") & (low_path.contains("arxiv") | stem.rlike(r"(?i)^\d{4}\.\d{4,5}(v\d+)?$") | (markers >= 2))
        return let(
            count_of(t, "\n\n"),
            lambda breaks: F.when((t == "") | (kind == "corpus_jsonl"), "recursive")
            .when((count_of(t, "```") >= 2) | (code_share >= 0.25), "code")
            .when(junk(breaks), "token")
            .when(low_path.endswith(".md") | marked(breaks), "recursive")
            .when(academic, "semantic")
            .when(kind.isin("pdf", "zim", "text"), "sentence")
            .otherwise("recursive"),
        )

    return let(trimmed(text) if trim else text, lambda t: let(lines(t), lambda rows: of_lines(t, rows)))


def windows(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """One row for each window of white-space tokens: chunk_idx, chunk_id, token_count, chunk."""
    step = size - overlap if size > overlap else size
    words = df.withColumn("_words", split_words(text)).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step))
    cut = words.select("*", F.posexplode(starts).alias("chunk_idx", "_at"))
    piece = F.slice("_words", F.col("_at") + 1, F.lit(size))
    out = cut.select("*", F.array_join(piece, " ").alias("chunk"), F.size(piece).cast("long").alias("token_count")).drop("_words", "_at")
    return out.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("chunk_idx"), F.lit("_"), F.substring(F.md5("chunk"), 1, 16)))


def merge_small(pieces: Column, least: int, most: int) -> Column:
    """Neighbours joined by a blank line while the buffer has fewer than ``least`` words and both fit into ``most``."""
    words = lambda x: F.size(split_words(x))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def joined(s: Column, x: Column, n: Column) -> Column:
        joins = (s["n"] < least) & (s["n"] + n <= most)
        return (
            F.when(s["held"] == "", F.struct(s["out"].alias("out"), x.alias("held"), n.alias("n")))
            .when(joins, F.struct(s["out"].alias("out"), F.concat(s["held"], F.lit("\n\n"), x).alias("held"), (s["n"] + n).alias("n")))
            .otherwise(F.struct(F.array_append(s["out"], s["held"]).alias("out"), x.alias("held"), n.alias("n")))
        )

    def step(s: Column, x: Column) -> Column:
        return let(words(x), lambda n: joined(s, x, n))

    if least <= 0:
        return pieces
    return F.when(F.size(pieces) <= 1, pieces).otherwise(F.aggregate(pieces, start, step, lambda s: F.when(s["held"] != "", F.array_append(s["out"], s["held"])).otherwise(s["out"])))


def last_paragraph(text: str | Column) -> Column:
    """The last paragraph that is not blank, trimmed; null without one."""
    full = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n\n"), trimmed), lambda x: x != "")
    return let(full, lambda x: F.when(F.size(x) > 0, F.element_at(x, -1)))


def chunk_prefix(prefix: Column, citation: Column, court: Column, year: Column, topics: Column) -> Column:
    named = F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(F.slice(topics, 1, 8), "; ")))
    place = none_if_blank(F.concat(trimmed(court), F.lit(" "), F.coalesce(year.cast("string"), F.lit(""))))
    built = F.when(none_if_blank(citation).isNotNull(), F.concat_ws(" | ", trimmed(citation), place, named))
    return F.coalesce(none_if_blank(prefix), built, F.lit(""))


def title_and_source(rows: DataFrame, file_path: Column) -> DataFrame:
    """Records with the title and source of their chunks."""
    stem = F.regexp_replace(F.element_at(F.split(file_path, "/"), -1), r"\.[^.]*$", "")
    title = F.coalesce(none_if_blank("citation"), none_if_blank("title"), none_if_blank("path"), stem)
    source = F.coalesce(none_if_blank("source_url"), none_if_blank("doc_id"), none_if_blank("citation"), none_if_blank("path"), file_path)
    return rows.withColumns({"chunk_title": title, "chunk_source": source})


def point_id(source: Column, index: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", source, index.cast("string"), F.substring(text, 1, 100)))


def is_real_query(text: Column) -> Column:
    """Not a prompt that a chat client makes by itself."""
    head = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 400))
    return ~(head.startswith("### task:") | (head.contains("follow-up") & head.contains("suggest")) | head.contains("relevant follow-up questions"))


def skips_retrieval(query: Column, header: Column, most: int = 80) -> Column:
    """Whether greetings and acknowledgements may skip retrieval; a header of force or off decides first."""
    q = trimmed(query)
    return (
        F.when(header == "force", False).when(header == "off", True).when(q == "", True).when(q.contains("?") | q.rlike(INFRA) | (F.length(q) > most), False).otherwise(q.rlike(GREETING) | q.rlike(ACKNOWLEDGED))
    )


#: Keyword rules of intent in order: words (any of them), label, confidence (fixed values).
INTENT_WORDS = {
    "infra_debug": (("kubectl", "docker", "systemctl", "compose", "qdrant", "systemd"), 0.8),
    "code_generation": (("implement", "write a function", "refactor", "fix this bug"), 0.75),
    "summarization": (("summarize", "summary", "tl;dr"), 0.75),
    "planning": (("plan", "roadmap", "architecture"), 0.7),
    "research": (("research", "compare", "explain in depth"), 0.7),
    "troubleshooting": (("troubleshoot", "not working", "broken", "why does"), 0.75),
    "creative": (("write a story", "poem", "creative"), 0.7),
    "retrieval_heavy": (("document", "docs", "knowledge"), 0.65),
    "reasoning_heavy": (("step by step", "reason", "prove"), 0.65),
    "question": (("what is", "what's", "who is", "tell me about", "how does", "explain", "describe"), 0.7),
}


def intent(query: Column) -> Column:
    """struct(label, confidence) by ordered rules."""
    q = F.lower(query)

    def said(name: str) -> Column:
        return holds_any(q, INTENT_WORDS[name][0])

    def is_(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    def by(name: str) -> Column:
        return is_(name, INTENT_WORDS[name][1])

    file = query.rlike(CODE_FILE)
    return (
        F.when(query.rlike(LOG_LINE) | (q.contains("log") & (q.contains("analyze") | q.contains("parse"))), is_("log_analysis", 0.85))
        .when(said("infra_debug"), by("infra_debug"))
        .when(q.contains("review") & (q.contains("pr") | q.contains("code") | file), is_("code_review", 0.8))
        .when(said("code_generation"), by("code_generation"))
        .when(file, is_("code_generation", 0.7))
        .when(said("summarization"), by("summarization"))
        .when(said("planning"), by("planning"))
        .when(said("research"), by("research"))
        .when(said("troubleshooting"), by("troubleshooting"))
        .when(said("creative"), by("creative"))
        .when((F.length(query) > 200) & said("retrieval_heavy"), by("retrieval_heavy"))
        .when(said("reasoning_heavy"), by("reasoning_heavy"))
        .when(said("question"), is_("research", 0.7))
        .when(F.length(query) < 60, is_("simple_chat", 0.6))
        .otherwise(is_("unknown", 0.0))
    )


def sure_intent(found: Column, least: float = 0.55) -> Column:
    return F.when(found["confidence"] < least, "unknown").otherwise(found["label"])


def gate(label: Column, confidence: Column, query: Column) -> Column:
    """skip, light or full retrieval."""
    full = ("infra_debug", "troubleshooting", "log_analysis", "retrieval_heavy", "research", "planning", "code_review")
    return (
        F.when(label.isin(*full), "full")
        .when(label.isin("simple_chat", "creative") & (confidence >= 0.6), "skip")
        .when((label == "code_generation") & (F.length(query) < 120), "light")
        .when((F.length(query) < 40) & (confidence < 0.5), "skip")
        .otherwise("full")
    )


def rewrite(query: Column) -> Column:
    """Glossary expansion, given up if it grows too much, drifts or loses a literal."""
    out = trimmed(query)
    for short, long in GLOSSARY.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", long)
    kept = F.forall(F.regexp_extract_all(query, F.lit(LITERAL), F.lit(0)), lambda x: out.contains(x))
    return F.when((F.length(out) <= F.length(query) * 1.5) & (word_overlap(query, out) >= 0.3) & kept, out).otherwise(query)


def format_size(n: Column) -> Column:
    n = n.cast("long")
    return (
        F.when(n.isNull(), "")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2))
        .otherwise(F.format_string("%.2f GB", n / 1024**3))
    )


def parse_size(x: Column) -> Column:
    """Bytes of "1.2 GiB" and the like; null if there is no size."""
    unit = F.upper(F.regexp_extract(x, r"(?i)([\d.]+)\s*([KMGT]?i?B)", 2))
    scale = F.lit(1)
    for k, prefix in enumerate("KMGT", 1):
        scale = F.when(unit == f"{prefix}IB", 1024**k).when(unit == f"{prefix}B", 1000**k).otherwise(scale)
    return F.when(unit != "", (F.regexp_extract(x, r"(?i)([\d.]+)\s*([KMGT]?i?B)", 1).cast("double") * scale).cast("long"))


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def smells(text: Column) -> dict[str, Column]:
    """Traces of scripts and styles in a chunk."""
    low = F.lower(text)
    styled = low.contains("background-image") | (low.contains("external-link") & text.contains("{"))
    return {
        "wayback_js": low.contains("wombat") | low.contains("_____wb$"),
        "json_ld": text.contains("@context") & text.contains("schema.org"),
        "css_leak": styled & (count_of(text, "{") > 3),
    }


def canonical_id(x: Column) -> Column:
    return F.lower(F.replace(F.trim(x), F.lit("-"), F.lit("")))


def sample_each(rows: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Of rows (id, source), target rows: the first of each source in the order of a hash, the largest sources first, then the first of all others. Aggregates and
    a top k; a hot source is never one task."""
    keyed = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    first = keyed.groupBy("source").agg(F.count("*").alias("n"), F.min("h").alias("h")).orderBy(F.desc("n"), "source").limit(target).select(F.col("source").alias("s"), F.col("h").alias("first"))
    picked = keyed.join(F.broadcast(first), F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("first")), "left")  # target rows at most
    return picked.orderBy(F.col("first").isNull(), "h").limit(target).select("id", "source")
