"""What must not grow: time with hostile pages, the fit's rows with repeated documents, memos with texts that have no spaces."""

import time

import pytest

from siltstone.llm import bpe, html_density, queries, toxicity

MB = 1 << 20
PAGES = {
    "end tags that match nothing": "<b>" * (MB // 8) + "</i>" * (MB // 8) + "text",
    "deep blocks": "<div>x" * (MB // 6),
    "deep inline": "<p>" + "<span>" * (MB // 12) + "</em>" * (MB // 12) + "words",
    "unclosed paragraphs": "<p>word " * (MB // 8),
    "deep lists": "<ul><li>" * (MB // 8) + "</p>" * 1000,
    "deep tables": "<table><tr><td>" * (MB // 15) + "</b>" * 5000,
    "a quote that never ends": "<a " * (MB // 3) + '"',
    "quotes": "<a '" * (MB // 4),
    "comments": "<!--" * (MB // 4),
    "scripts": "<script>" * (MB // 8),
    "brackets": "<" * MB,
    "attributes": "<a " + "x " * (MB // 2) + ">",
    "space": "<a x=" + " " * MB + ">",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_a_megabyte(name):
    began = time.process_time()
    html_density.main_text(PAGES[name])
    assert time.process_time() - began < 12  # 0 to 3 s on an idle machine; quadratic work would take minutes


def test_scopes_and_implied_ends():
    text = html_density.main_text
    assert text("<article><p>One two three four.<p>Five six seven eight.</b></i></div></article>") == "One two three four. Five six seven eight."
    tree = html_density.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>x</p><td>y<tr><td>z</table>e")
    shape = lambda n: [x if isinstance(x, str) else (x.tag, shape(x)) for x in n.items]
    assert shape(tree) == [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])])]), ("li", ["d"])]), ("table", [("tr", [("td", ["x"]), ("td", ["y"])]), ("tr", [("td", ["z"])])]), "e"]


def test_fit_of_repeated_documents(spark):
    """Limits bound the rows of the fit, however often a document or a label stands in the tables."""
    docs = spark.createDataFrame([(i % 4, f"text {i} of {i % 4}") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 4, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    used = [i for i in range(4) if not spark.sql(f"SELECT crc32('{i}') % 5 = 0").first()[0]]
    assert toxicity.sample(docs, labels, 1, 1).count() <= 2
    rows = sorted((r["text"], r["label"]) for r in toxicity.sample(docs, labels, 100, 100).collect())
    assert rows == sorted((min(f"text {j} of {i}" for j in range(i, 1000, 4)), i % 2) for i in used)


def test_memos_without_spaces(monkeypatch):
    """Long runs are not kept, and what is kept is bounded in bytes."""
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1 << 18)
    coder = bpe.Bpe(queries.tokenizer_path())
    texts = ["字" * 500 + str(i) + "語" * 500 for i in range(50)] + [" ".join(f"word{i}x{j}" for j in range(200)) for i in range(40)]
    for t in texts:
        assert coder.decode(coder.encode(t)) == t
    for memo in (coder.memo, coder.runs):
        for half in (memo, memo.old):
            assert sum(bpe.ENTRY_BYTES + 2 * len(k) + len(v) for k, v in half.items()) <= (1 << 16)
            assert max(map(len, half), default=0) <= bpe.LONGEST
    list(toxicity.features(["x" * 5000, "字" * 5000]))
    scores = toxicity._Scores(__import__("numpy").zeros(1 << toxicity.BITS, "float32"))
    assert scores["x" * 5000] == 0 and scores["abc"] == 0 and list(scores) == ["abc"]
