"""Catalogue rows: what kind an entry is and how it is shown, Atom feeds to rows, the pages of a story and its markdown, one line on how an ingest goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import title_case, trimmed

PAGE_SIZE = 50
ATOM = "STRUCT<totalResults: STRING, entry: ARRAY<STRUCT<id: STRING, title: STRING, published: STRING, updated: STRING>>>"


def kind() -> Column:
    """Of rows (source_id, name, href, external_url, is_directory, subscribable); the first that holds (fixed values)."""
    low, at = F.lower("name"), lambda source, prefix: (F.col("source_id") == source) & F.startswith("href", F.lit(prefix))
    folder = F.when(at("archive", "collection/"), "collection").when(at("archive", "search/"), "search").when(at("archive", "item/"), "item").when(at("arxiv", "cat/"), "category").when(at("arxiv", "prefix/"), "prefix").otherwise("folder")
    file = F.when(low.endswith(".zim"), "zim").when(low.endswith(".pdf"), "pdf").when(low.endswith(".txt") | low.endswith(".md"), "text").when(F.col("source_id") == "arxiv", "paper").otherwise("file")
    outside = F.coalesce(F.col("external_url") != "", F.lit(False))
    return F.when(F.startswith("name", F.lit("[Next page]")), "pagination").when(outside, "external").when(F.col("is_directory"), folder).when(F.col("subscribable"), file).otherwise("file")


def described(rows: DataFrame) -> DataFrame:
    """rows (source_id, name, href, external_url, is_directory, subscribable, modified) with kind, kind_label, title and subtitle. An archive named corpus_language_topic_date
    shows its topic; a paper named id: title shows the title; the date follows, but for links outside and further pages."""
    rows = rows.withColumn("kind", kind())
    parts = F.split(F.regexp_extract("name", r"^(.*)_\d{4}-\d{2}\.zim$", 1), "_")
    dated = F.regexp_extract("name", r"_(\d{4}-\d{2})\.zim$", 1)
    many = F.size(parts) >= 3
    words = lambda c: title_case(F.replace(c, F.lit("_"), F.lit(" ")))
    topic = words(F.when(many, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "_")).otherwise(F.array_join(parts, "_")))
    corpus, language = words(F.when(many, parts[0]).otherwise(F.array_join(parts, "_"))), F.when(many, F.upper(F.get(parts, F.lit(1)))).otherwise("")
    stamp = F.date_format(F.to_date(F.concat(dated, F.lit("-01"))), "MMM yyyy")
    archive, paper = (F.col("kind") == "zim") & (dated != ""), (F.col("kind") == "paper") & F.contains("name", F.lit(":"))
    after = F.expr("substr(name, instr(name, ':') + 1)")
    title = F.when(F.col("kind") == "pagination", "Next page").when(archive, topic).when(paper, F.substring(trimmed(after), 1, 100)).otherwise(F.regexp_replace("name", "/+$", ""))
    about = F.when(archive, F.concat_ws(" · ", corpus, language, stamp)).when(paper, trimmed(F.substring_index("name", ":", 1))).when(F.col("kind") == "collection", "Collection").when(F.col("kind") == "category", F.split_part("href", F.lit("/"), F.lit(2)))
    day = F.when((F.col("modified") != "") & ~F.col("kind").isin("pagination", "external"), F.substring("modified", 1, 10))
    subtitle = F.regexp_replace(F.concat_ws(" · ", F.when(about != "", about), day), "^[ ·]+|[ ·]+$", "")
    return rows.withColumns({"kind_label": F.upper(F.replace("kind", F.lit("_"), F.lit(" "))), "title": title, "subtitle": subtitle})


def papers(feeds: DataFrame, pdf_base: str) -> DataFrame:
    """feeds (feed, href_prefix, page, body) of Atom text -> (feed, name, href, url, is_directory, modified): a row for each entry, one for the next page if there
    are more results. Feeds that are no XML give none."""
    read = feeds.withColumn("f", F.from_xml("body", ATOM, {"mode": "PERMISSIVE"}))
    one = read.select("feed", F.explode("f.entry").alias("e"))
    where = F.coalesce("e.id", F.lit(""))
    own = F.regexp_extract(where, r"arxiv\.org/abs/(.+)$", 1)
    paper = F.when(own != "", F.regexp_replace(own, r"v\d+$", "")).otherwise(F.substring_index(where, "/", -1))
    stamp = F.coalesce(F.when(F.col("e.updated") != "", F.col("e.updated")), F.col("e.published"))
    title = trimmed(F.regexp_replace(F.coalesce("e.title", F.lit("")), r"\s+", " "))
    items = one.select(
        "feed", F.concat(paper, F.lit(": "), F.substring(title, 1, 100)).alias("name"), F.concat(F.lit("paper/"), paper).alias("href"), F.concat(F.lit(f"{pdf_base}/"), paper, F.lit(".pdf")).alias("url"),
        F.lit(False).alias("is_directory"), F.when(stamp != "", F.substring(stamp, 1, 10)).alias("modified"),
    )
    total = F.when(F.col("f.totalResults").rlike(r"^\d+$"), F.col("f.totalResults").cast("long"))
    more = read.where((F.col("page") + 1) * PAGE_SIZE < total).select(
        "feed", F.lit("[Next page]").alias("name"), F.concat("href_prefix", F.lit("/page/"), (F.col("page") + 1).cast("string")).alias("href"), F.lit("").alias("url"), F.lit(True).alias("is_directory"), F.lit(None).cast("string").alias("modified")
    )
    return items.unionByName(more)


def story_index(entries: DataFrame) -> DataFrame:
    """entries (slug, url) -> (slug, pages, missing): the pages of each story by number, from ?page= or 1, and those before the first."""
    page = F.coalesce(F.regexp_extract("url", r"[?&]page=(\d{1,9})", 1).try_cast("int"), F.lit(1))
    pages = entries.groupBy("slug").agg(F.sort_array(F.collect_set(page)).alias("pages"))  # as many as a story has pages
    return pages.withColumn("missing", F.when(F.col("pages")[0] > 1, F.sequence(F.lit(1), F.col("pages")[0] - 1)).otherwise(F.array().cast("array<int>")))


def quoted(c: Column) -> Column:
    """As a JSON string; characters outside ASCII stay as they are."""
    for mark, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(mark), F.lit(shown))
    return F.concat(F.lit('"'), c, F.lit('"'))


def markdown(body: Column) -> Column:
    """Of rows (slug, title, author, category, views, favorites, pages, missing): front matter, heading and body. What is null or empty leaves no line."""
    text = lambda key, c: F.when(F.col(c) != "", F.concat(F.lit(f"{key}: "), quoted(F.col(c))))
    number = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f"{key}: "), c.cast("string")))
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("slug"))
    rate = F.when(F.col("views") > 0, F.format_string("%.6f", F.col("favorites") / F.col("views")))
    missing = F.when(F.size("missing") > 0, F.concat(F.lit("missing_pages: ["), F.array_join("missing", ", "), F.lit("]")))
    author = F.when(F.col("author") != "", F.concat(F.lit("\n*by "), F.col("author"), F.lit("*")))
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), quoted(shown)), text("author", "author"), text("category", "category"), number("views", F.col("views")), number("favorites", F.col("favorites")),
        number("favorite_rate", F.when(F.col("favorites").isNotNull(), rate)), text("slug", "slug"), number("pages", F.when(F.col("pages") > 0, F.col("pages"))), missing, F.lit("---\n"), F.concat(F.lit("# "), shown), author, F.lit(""), body, F.lit(""),
    )


def velocity() -> Column:
    """Of rows (active, indexed, total_chunks, running, pending, rate_now, rate_5m): one line on how the ingest goes."""
    n = lambda shown, c: F.format_string(shown, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    primary = F.when(F.col("rate_now") > 0, n("%,d chunks/min", "rate_now")).when(F.col("running") > 0, "measuring…").when(F.col("pending") > 0, "waiting")
    busy = F.concat_ws(" · ", n("%d in queue", "active"), n("%,d corpus chunks", "total_chunks"), F.when(F.col("running") > 0, n("%d embedding", "running")), primary, F.when(F.col("rate_5m") > 0, n("5m avg %,d chunks/min", "rate_5m")))
    return F.when(F.coalesce(F.col("active"), F.lit(0)) > 0, busy).otherwise(F.concat_ws(" · ", n("%,d indexed", "indexed"), n("%,d corpus chunks", "total_chunks")))
