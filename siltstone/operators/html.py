"""Archive pages to text: the content root of a page, block breaks, and the gates that skip a page.

A page is read once into a flat list of events. Regions (content roots, parts to leave out) are folds over that list; the rest of
a region becomes one marked string, which is cut at its headings and joined by blocks. Runs per Arrow batch; the gates stay native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.text import NAMESPACE, PATH_HINTS

# Element sets, ids, classes and titles of the sanitiser (fixed values).
SKIPPED = frozenset("script style noscript svg template nav header footer".split())
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tbody td th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOT_IDS = frozenset("mw-content-text content main-content maincontent main".split())
ROOT_CLASSES = frozenset("mw-parser-output content _content main-content post-text answer question s-prose".split())
ROOT_TAGS = frozenset("main article".split())
CHROME_IDS = frozenset(["toc"])
CHROME_CLASSES = frozenset("navbox vertical-navbox hatnote mw-editsection toc".split())
ENDING_SECTIONS = frozenset(["references", "external links", "see also", "further reading", "notes", "bibliography", "citations"])
LEAST_CHARS, LEAST_SHARE = 80, 0.35

_BLANKS = re.compile(r"[ \t\f\v]+")
#: Marks in a region's string: a block break, white space between tags, and a heading's start (with its level) and end.
_BREAK, _GAP, _OPEN, _CLOSE = "\x00", "\x01", "\x02", "\x03"
_MARKS = str.maketrans("", "", _BREAK + _GAP + _OPEN + _CLOSE)
_HEADING = re.compile(f"{_OPEN}(\\d)([^{_OPEN}{_CLOSE}]*)({_CLOSE}|(?={_OPEN})|\\Z)")


class Event(NamedTuple):
    kind: int  # 1 opens, -1 closes, 0 neither
    tag: str  # empty: text
    text: str = ""
    id: str = ""
    classes: frozenset[str] = frozenset()
    start: int = 0
    end: int = 0


class _Reader(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.lines = [0]
        for line in html.splitlines(keepends=True) if "\r" not in html else re.findall(r"[^\n]*\n|[^\n]+", html):
            self.lines.append(self.lines[-1] + len(line))
        self.feed(html)
        self.close()

    def _tag(self, kind: int, tag: str, attrs: list) -> None:
        named = {k.lower(): v or "" for k, v in attrs}
        row, column = self.getpos()
        at = self.lines[min(row - 1, len(self.lines) - 1)] + column
        self.events.append(Event(kind, tag, "", named.get("id", ""), frozenset(named.get("class", "").split()), at, at + len(self.get_starttag_text() or "") * (kind >= 0)))

    def handle_starttag(self, tag, attrs):
        self._tag(1, tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._tag(0, tag, attrs)

    def handle_endtag(self, tag):
        self._tag(-1, tag, [])

    def handle_data(self, data):
        self.events.append(Event(0, "", data.translate(_MARKS)))


def regions(events: list[Event], begins: Callable[[Event], bool]) -> list[tuple[int, int | None]]:
    """(first, last) event of each outermost region that an opening tag begins; last is None if it never closes. Every opening tag counts, void ones too."""
    out, first, depth = [], 0, 0
    for i, e in enumerate(events):
        if depth:
            depth += e.kind
            if not depth:
                out.append((first, i))
        elif e.kind == 1 and begins(e):
            first, depth = i, 1
    return out + [(first, None)] if depth else out


def marked(events: list[Event], wiki: bool) -> str:
    """The visible text of events with marks for blocks and headings."""
    def left_out(e: Event) -> bool:
        return e.tag in SKIPPED or wiki and (e.id in CHROME_IDS or bool(e.classes & CHROME_CLASSES))

    out, at = [], 0
    for first, last in [*regions(events, left_out), (len(events), None)]:
        for e in events[at:first]:
            if not e.tag:
                text = _BLANKS.sub(" ", e.text)
                out.append(text if text.strip() else _GAP)
            elif e.tag in HEADINGS and e.kind:
                out.append(f"{_OPEN}{e.tag[1]}" if e.kind > 0 else _CLOSE)
            elif e.tag in BLOCKS:
                out.append(_BREAK)
        at = len(events) if last is None else last + 1
    return "".join(out)


def _pieces(body: str) -> Iterator[str]:
    for piece in body.replace(_CLOSE, _BREAK).split(_BREAK):
        piece = re.sub(f"(?<=[ \n]){_GAP}+", "", piece.lstrip(_GAP))
        if piece:
            yield re.sub(f"{_GAP}+", " ", piece)


def to_text(events: list[Event], wiki: bool) -> str:
    """Blocks, a blank line between them. In a wiki page the sections that end an article go, up to the next heading of level 1 or 2."""
    body, *sections = _HEADING.split(marked(events, wiki))
    out, ended = list(_pieces(body)), False
    for level, title, closed, body in zip(*(iter(sections),) * 4, strict=True):
        title = _BLANKS.sub(" ", title.replace(_BREAK, "").replace(_GAP, " ")).strip()
        if closed == _CLOSE:
            ending = wiki and title.lower().rstrip(":") in ENDING_SECTIONS
            ended = ending or ended and level not in "12"
            out += [title] if title and not ending else []
        out += [] if ended else _pieces(body)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)).strip()


def content_root(html: str, events: list[Event], wiki: bool) -> tuple[str, str, str]:
    """(text, fragment, label) of the root with most text, or of the whole page if that keeps too little."""
    whole = to_text(events, wiki)
    best = ("", html, "")
    for first, last in regions(events, lambda e: e.id in ROOT_IDS or bool(e.classes & ROOT_CLASSES) or e.tag in ROOT_TAGS):
        if last is not None:
            e, text = events[first], to_text(events[first + 1 : last], wiki)
            if len(text) > len(best[0]):
                best = (text, html[e.end : events[last].start], f"#{e.id}" if e.id else f".{min(e.classes)}" if e.classes else e.tag)
    return best if len(best[0]) >= max(LEAST_CHARS, int(LEAST_SHARE * len(whole))) else (whole, html, "")


def sanitize(html: str | None, title: str, url: str) -> dict:
    html, both = html or "", f"{title}\n{url}"
    space = bool(re.search(NAMESPACE, title) or re.search(NAMESPACE, url))
    wiki = space or any(h in both.lower() for h in PATH_HINTS)
    try:
        text, fragment, label = content_root(html, _Reader(html).events, wiki)
    except AssertionError:  # a declaration that the parser refuses: the page is stripped flat
        text, fragment, label = _BLANKS.sub(" ", unescape(re.sub(r"<[^>]+>", " ", html))).strip(), html, ""
    return {"wiki": wiki, "root": label or "(document)", "raw_chars": len(html), "fragment_chars": len(fragment), "text": text if len(text) >= LEAST_CHARS and not space else None}


def sanitize_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): wiki, root, raw_chars, fragment_chars and text (null: the page is skipped)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = pd.DataFrame([sanitize(h, "", u or "") for h, u in zip(rows["html"], rows["url"], strict=True)], columns=["wiki", "root", "raw_chars", "fragment_chars", "text"])
            yield pd.concat([rows[["page_id", "url"]].reset_index(drop=True), got], axis=1)

    out = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, wiki boolean, root string, raw_chars long, fragment_chars long, text string")
    return out.withColumn("text_chars", F.length("text").cast("long"))
