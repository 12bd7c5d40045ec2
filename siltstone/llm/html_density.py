"""Main text of web pages by composite text density.

A page becomes a tree of elements (unclosed and misnested tags are closed as browsers do for the common cases). For each node,
with C characters, T tags, LC characters in links and LT link tags below it, and lc / c the share of link text in the body,

    density = C / T * log base ln(C / notLC * LC + lc / c * C + e) of (C / LC * T / LT)

(tags, link tags and characters outside links of 0 taken as 1, link characters of 0 as a half), as in the published method. A node's score is the sum of its
children's densities; text that stands in the node itself, with its text-level elements (``b``, ``a``, ``br`` ...), counts as one child. What says of itself that it
is no part of an article (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, comments of readers
and hidden parts, told by tag, role, class or id) is no candidate, adds to no score and is left out of the text.

The threshold is the least density on the path from the body to the densest node; the subtree with the largest score among
nodes that reach the threshold is the main content (of equal scores an ``article`` or ``main``, then the longer text). It widens to its parent below
the body as long as most of the text that this adds is the article's own kind: headings and paragraphs, or parts that reach the
threshold and have a score of ``ALIKE`` of the main content's at least, such as its other sections.

Text is read block by block: white space inside a block becomes one space, blocks are trimmed and joined by one space.

Defined cases: null and empty pages, pages without text and pages whose text is all in links give an empty text; without a body the whole page is the body;
plain text is its own article; character references are decoded once; an unclosed script or style ends with the page; very long and very deep pages are
read whole; rows that repeat give the same text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of HTML by kind (fixed values of the language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these, if no element of the second set is between.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), (frozenset(["p"]), frozenset("button table td th caption li div article section body".split()))),
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu body".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset("dt dd p".split()), frozenset("dl body".split()))),
    **dict.fromkeys(("td", "th"), (frozenset("td th".split()), frozenset("tr table body".split()))),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot body".split())),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot tr td th".split()), frozenset("table body".split()))),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: An end tag of these does not reach past them.
SCOPE = frozenset("table td th body html article section div main aside nav header footer".split())
#: Never part of an article.
APART = frozenset("aside button datalist dialog footer form head input menu nav select".split()) | RAW
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
_APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|breadcrumbs?|comments?|comment-?list|commentary|disqus|respond|replies|cookies?\w*|consent|gdpr|notice|popup|modal|overlay|"
    r"footer|foot|header|masthead|menu|nav\w*|sidebar|side|rail|widget|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|pagination|pager|skip|toolbar|hidden)(?:$|[\s_-])|sidebar|navbar|advert|newsletter",
    re.I,
)
#: Children of a widened part that are taken at their word (fixed values of the language).
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl blockquote pre table figure".split())
#: The share of the main content's score that another part has to reach to be its like.
ALIKE = 0.2
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"(?:[^\"]*+\")?+|'(?:[^']*+')?+)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "chars", "tags", "link_chars", "link_tags", "line", "density", "score")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list = []  # texts and nodes, in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.line = False  # text-level, without blocks below
        self.density = self.score = 0.0


class Open:
    """The open elements, innermost last, with the places of each tag, so that no tag walks through them: a page takes time in proportion to its length."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the innermost element with one of these tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        """Close the element at place and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def parse(html: str) -> Node:
    root = Node("html", {}, None)
    open_ = Open(root)
    at = 0
    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            open_.nodes[-1].items.append(html[at:])
            break
        if m.start() > at:
            open_.nodes[-1].items.append(html[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            k = open_.last((tag,))
            if k and (tag in SCOPE or open_.last(SCOPE) < k):
                open_.cut(k)
            continue
        if tag == "html":
            continue
        if rule := CLOSES.get(tag):
            while (k := open_.last(rule[0])) and k >= open_.last(rule[1]):
                open_.cut(k)
                if tag not in ("li", "dt", "dd", "tr", "tbody", "thead", "tfoot"):
                    break
        attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[3])} if m[3].strip(" \t\r\n\f/") else {}
        node = Node(tag, attrs, open_.nodes[-1])
        open_.nodes[-1].items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.items.append(html[at : close.start()] if close else html[at:])
            at = close.end() if close else n
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(node)
    return root


def apart(node: Node) -> bool:
    """Whether a node is no part of an article, by what it says of itself."""
    if node.tag in APART or node.attrs.get("role", "").lower() in APART_ROLES:
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return node.tag not in ("html", "body", "article", "main") and bool(_APART_NAMES.search(f"{a.get('class', '')} {a.get('id', '')}"))


def apart_in(node: Node) -> bool:
    """The same for a node inside an article, whose own header belongs to it."""
    return apart(node) and not (node.tag == "header" and node.parent.tag in ("article", "main"))


def measure(root: Node) -> list[Node]:
    """Counts of every node, children before parents; the nodes in that order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and x.tag not in RAW]
    order.reverse()
    for node in order:
        node.line = node.tag not in BLOCKS or node.tag in ("br", "hr")
        for x in node.items:
            if not isinstance(x, Node):
                node.chars += len("".join(x.split()))
            elif x.tag not in RAW:
                node.line &= x.line
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    links, t = link_chars or 0.5, max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * links + share * chars + math.e)
    return chars / t * math.log(max(chars / links * t / max(link_tags, 1), 1.0)) / math.log(base)


def densities(order: list[Node], body: Node) -> None:
    """Density and score of each node; order: children before parents."""
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        parts = [x for x in node.items if isinstance(x, Node) and x.tag not in RAW and not x.line]
        own = (node.chars, node.tags, node.link_chars, node.link_tags)
        if parts:
            below = [sum(c) for c in zip(*((x.chars, x.tags + 1, x.link_chars, x.link_tags + (x.tag == "a")) for x in parts), strict=True)]
            own = tuple(a - b for a, b in zip(own, below, strict=True))
        node.score = density(*own, share) + sum(x.density for x in parts if not apart(x))


def content(root: Node) -> Node | None:
    """The subtree with the largest density sum above the threshold of the body's path; None if nothing has a density."""
    order = measure(root)
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    inside, stack = [], [body]
    while stack:
        node = stack.pop()
        inside.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.line and not apart(x)]
    densities(order, body)
    node = max(inside, key=lambda x: x.density)
    least = node.density
    while node is not body:
        node = node.parent
        least = min(least, node.density)
    best = max((x for x in inside if x.density >= least), key=lambda x: (x.score, x.tag in ("article", "main"), x.chars))
    if best.score <= 0:
        return None
    while best is not body and best.parent is not body and best.parent is not None:
        others = [x for x in best.parent.items if isinstance(x, Node) and x is not best and x.tag not in RAW and not apart_in(x)]
        alike = sum(x.chars for x in others if x.tag in PROSE or x.tag == "header" or x.density >= least and x.score >= ALIKE * best.score)
        if 2 * alike < sum(x.chars for x in others):
            break
        best = best.parent
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order, without what is apart from the article."""
    out, now = [], []

    def flush() -> None:
        if now:
            text = _SPACE.sub(" ", unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif not isinstance(x, Node):
            now.append(x)
        elif x is node or not apart_in(x):
            block = x.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    found = content(parse(html))
    return " ".join(blocks(found)) if found else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each; other columns pass through, one called like the new one is replaced."""
    df = pages if text == html else pages.drop(text)
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = pa.array([main_text(x) for x in column.slice(a, 256).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i, f in enumerate(part.schema) if f.name != text] + [out], names=schema.names)

    return df.mapInArrow(run, schema)


def result(out: DataFrame) -> DataFrame:
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
