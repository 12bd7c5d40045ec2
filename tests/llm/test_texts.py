"""BPE, chat, HTML, toxicity, PII and the pipeline."""

import collections
import hashlib
import html as stdlib
import itertools
import math
import random
import re
import string
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat, html_density, mixing, pii, queries, toxicity
from siltstone.llm.common import table
from tests.llm.test_near import brute_texts

ODD = ["<|endoftext|>a<|endoftext|><|endoftext|> b", "a\x1cb  \x85 c d\n\n  x ", "", "'S 's I'LL don't", " ​foo bar 你好 مرحبا ½²³", "x" * 5000 + "\n" * 300, "áé 🙂🙂 <|endoftext", "\r\n\t ", "a   b\n \nc", "ab" * 4000]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_bpe(spark, sf):
    from tokenizers import Tokenizer

    rows = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + [(9000 + i, t) for i, t in enumerate(ODD)] + [(9999, None), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("old"), "decoded": F.lit(1)})
    out = bpe.encode(df, queries.tokenizer_path(), decoded="decoded")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(out).collect()}
    ref = Tokenizer.from_file(queries.tokenizer_path())
    for i, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(ref.decode(ids, skip_special_tokens=False).encode())), t
    back = bpe.decode(out.select("doc_id", "ids"), queries.tokenizer_path())
    assert {r["doc_id"]: r["text"] for r in back.collect()}[9005] == ODD[5]
    assert bpe.encode(df.limit(0), queries.tokenizer_path()).count() == 0


def test_chat_is_reversible(spark):
    rows = [(1, 0, "user", "</s>[INST] x \\l \\ <|end|>"), (1, 1, "assistant", "<|turn|>a\nb\\n"), (1, 2, "assistant", ""), (2, 5, "us\ner", None), (2, None, None, "first"), (None, 0, "assistant", "n"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.from_turns(df))).collect()}
    turns = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((r or "", x or ""))
    assert got.keys() == turns.keys()
    for c, said in turns.items():
        loss = "".join(x for r, x in said if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said).encode()))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss.encode()))
    assert chat.format_trees(chat.from_turns(df.limit(0))).count() == 0


def test_reply_trees(spark):
    #     1 - 2 - 4 (2.0)      7 - 8: a cycle; 9's parent is missing
    #       \ 3 (5.0) - 5
    rows = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 2.0), (5, 3, None), (7, 8, 1.0), (8, 7, 1.0), (6, 8, 9.0), (9, 99, 1.0)]
    nodes = spark.createDataFrame([("t", n, p, "assistant" if n % 2 else "user", f"m{n}", s) for n, p, s in rows], "tree string, node long, parent long, role string, text string, score double")
    got = sorted((r["leaf"], r["branch"], [t["text"] for t in r["turns"]]) for r in chat.format_trees(nodes, None).withColumn("turns", chat.read_back(F.col("formatted"))).collect())
    assert got == [(4, None, ["m1", "m2", "m4"]), (5, None, ["m1", "m3", "m5"]), (9, None, ["m9"])]
    best = chat.format_trees(nodes, 2).orderBy("branch").collect()
    assert [(r["leaf"], r["branch"]) for r in best] == [(5, 1), (4, 2)]


PAGE = """<html><body><header><a href=/>Site</a></header><div class="sidebar"><p>side text here</p></div><div class=cookie-notice>We use cookies</div><div id="content"><h1>Title &amp; more</h1>
<p>First para with <a href=x>link</a> text and words in it, long enough.<p>Second&nbsp;para<br>line two<ul><li>one<li>two</ul><form><input><label>name</label></form><div class="comments"><p>nice post</p></div></div>
<footer>foot</footer><script>var a='<p>x</p>'</script></body></html>"""


def drawn(rng, depth):
    """A random tree: tag, attributes, children (trees and texts)."""
    tag = rng.choice(["div", "section", "p", "ul", "span", "b", "a", "br"] if depth else ["div", "section"])
    if tag == "br":
        return (tag, "", [])
    inner = [rng.choice(["", "word ", "some longer text here. " * rng.randrange(1, 9)]) if rng.random() < 0.5 or depth > 3 else drawn(rng, depth + 1) for _ in range(rng.randrange(1, 5))]
    lines = ("span", "b", "a")
    return (tag, rng.choice(["", "", "", ' class="advert"']) if tag not in lines else "", inner if tag in ("div", "section") else [x for x in inner if isinstance(x, str) or x[0] in lines and tag != "a" or x[0] == "br"])


def written(x):
    return x if isinstance(x, str) else f"<{x[0]}>" if x[0] == "br" else f"<{x[0]}{x[1]}>{''.join(map(written, x[2]))}</{x[0]}>"


def brute_density(x, share, links=False):
    """(density, score) of a tree by its definition, each count taken anew."""
    all_ = lambda y: [y] + [z for c in y[2] if not isinstance(c, str) for z in all_(c)]
    text = lambda y: "".join(c if isinstance(c, str) else text(c) for c in y[2])
    size = lambda t: len(re.sub(r"\s", "", t))
    line = lambda y: all(z[0] in ("span", "b", "a", "br") for z in all_(y))

    def value(trees, texts, whole):
        c = sum(size(text(t)) for t in trees) + sum(map(size, texts))
        tags = sum(len(all_(t)) for t in trees)
        anchors = [z for t in trees for z in all_(t) if z[0] == "a"]
        lc = c if whole else sum(size(text(z)) for z in anchors)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * (lc or 0.5) + share * c + math.e)
        return c / max(tags, 1) * math.log(max(c / (lc or 0.5) * max(tags, 1) / max(len(anchors), 1), 1)) / math.log(base)

    trees, texts = [c for c in x[2] if not isinstance(c, str)], [c for c in x[2] if isinstance(c, str)]
    blocks = [t for t in trees if not line(t)]
    score = value([t for t in trees if line(t)], texts, False) + sum(brute_density(t, share)[0] for t in blocks if not t[1])
    return value(trees, texts, x[0] == "a"), score


def test_densities():
    rng = random.Random(5)
    for _ in range(150):
        tree = drawn(rng, 0)
        root = html_density.parse(f"<body>{written(tree)}</body>")
        order = html_density.measure(root)
        body = next(x for x in order if x.tag == "body")
        html_density.densities(order, body)
        share = body.link_chars / max(body.chars, 1)

        def same(node, x):
            if not node.line:
                assert (node.density, node.score) == pytest.approx(brute_density(x, share))
            below = [y for y in x[2] if not isinstance(y, str)]
            for a, b in zip([y for y in node.items if isinstance(y, html_density.Node)], below, strict=True):
                same(a, b)

        same(next(x for x in body.items if not isinstance(x, str)), tree)


def test_html_is_chosen_by_density(spark, sf, monkeypatch):
    """Pages that do not name their article give the same texts; without densities there are none."""
    pages = [r["html"] for r in table(spark, sf.replace("sf0.001", "sf0.01"), "pages").collect()]
    for h in pages:
        assert html_density.main_text(re.sub(r"<(/?)article\b", r"<\1div", h)) == html_density.main_text(h) != ""
    p = lambda w, n: f"<p>{w * n}</p>"
    parts = f"<h1>Title here</h1><section>{p('word ', 60)}{p('other ', 50)}</section><section>{p('third ', 40)}{p('fourth ', 40)}</section><p>end</p>"
    wrapped = f"<body><div><div>Buy our things</div><div>{parts}</div><div><a href=x>more</a> <a href=y>of this</a></div></div></body>"
    assert html_density.main_text(wrapped) == html_density.main_text(f"<article>{parts}</article>")
    monkeypatch.setattr(html_density, "density", lambda *a: 0.0)
    assert {html_density.main_text(h) for h in pages} == {""}


def test_html(spark, sf):
    def plain(h):
        a = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1]))
        return re.sub(r"\s+", " ", stdlib.unescape(a)).strip()

    pages = table(spark, sf, "pages")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_density.result(html_density.extract(pages)).collect()}
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert html_density.main_text(PAGE) == "Title & more First para with link text and words in it, long enough. Second para line two one two"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "plain  text"), (4, "<p>a"), (5, "<div"), (6, "<script>x"), (7, "<div>" * 3000 + "deep"), (None, "<p>&lt;b&gt;</p>"), (8, "<a href=x>all a link</a>"), (9, "<p>long " + "text " * 300_000), (4, "<p>a")], "page_id long, html string").withColumns({"url": F.lit("u"), "text": F.lit(5)})
    rows = html_density.extract(odd).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {1: "", 2: "", 3: "plain text", 4: "a", 5: "", 6: "", 7: "deep", None: "<b>", 8: "", 9: ("long " + "text " * 300_000).strip()}
    assert len(rows) == 11
    assert html_density.extract(odd.limit(0)).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    hits = collections.Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hits[1, 1] >= 0.9 * (hits[1, 1] + hits[1, 0]) and hits[0, 1] <= 0.01 * (hits[0, 0] + hits[0, 1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_by_hand(spark):
    """Counts, naive Bayes ratios and scores against plain Python over n-grams; the fit leaves no feature out and keeps none that chance explains."""
    def slots(text):
        found = collections.Counter()
        for word in {"".join(g) for letter, g in itertools.groupby((text or "").lower(), str.isalpha) if letter}:
            padded = f" {word} "
            found.update({zlib.crc32(padded[i:j].encode()) % 2**toxicity.BITS for i in range(len(padded)) for j in range(i + 3, min(i + 5, len(padded)) + 1)})
        return found

    known = [(f"You VILE, vile wretch number{chr(97 + i % 20)}" if i % 3 == 0 else f"a kind reader of number{chr(97 + i % 20)} " * 3, int(i % 3 == 0)) for i in range(240)]
    odd = [None, "", "vile", "kind reader", "Vile 李 vile", "unseen words here", "vile " * 50_000]
    got = list(toxicity.features([t for t, _ in known] + odd))
    assert [dict(zip(s.tolist(), n.tolist(), strict=True)) for s, n in got] == [dict(slots(t)) for t in [t for t, _ in known] + odd]

    weights, bias = toxicity.train(spark.createDataFrame(known, "text string, label int").repartition(5))
    assert (weights == toxicity.train(spark.createDataFrame(known[::-1], "text string, label int"))[0]).all()
    share = sum(label for _, label in known) / len(known)
    seen = [collections.Counter(s for t, label in known if label == v for s in slots(t)) for v in (0, 1)]
    for s in seen[0] | seen[1]:
        expected = (seen[0][s] + seen[1][s]) * share
        apart = abs(seen[1][s] - expected) >= toxicity.LEAST_SD * math.sqrt(expected * (1 - share) + 0.1)
        assert np.sign(weights[s]) == (np.sign(seen[1][s] - expected) if apart else 0)
    assert not weights[sorted(set(range(2**toxicity.BITS)) - set(seen[0]) - set(seen[1]))].any()

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd + odd)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, (weights, bias)).collect()}
    for i, t in enumerate(odd + odd):
        z = bias + sum(n * float(weights[s]) for s, n in slots(t).items())
        assert rows[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and rows[i]["predicted"] == int(z >= 0)
    assert rows[2]["predicted"] == 1 and rows[3]["predicted"] == 0 and rows[0]["score"] == rows[1]["score"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string").withColumn("score", F.lit("old"))
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.sample(docs, none))
    assert [r["predicted"] for r in toxicity.score(docs, model).collect()] == [0, 0, 0]
    assert toxicity.score(docs.limit(0), model).count() == 0


PERSON = "Mr. John Smith met Frau Anna Müller; Mr. John Smith (j.smith@Foo-Bar.org, +1 (212) 555-0100, 212-555-0100), SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1111, host 10.0.0.1, password=3da3a2ce706927ddf6; v1.2.3.4.5, 3.14159265, 2024-01-02"


KEY = b"tests"


def test_surrogates():
    new, spans = pii.replace(PERSON, {}, KEY)
    parts = [(k, new[a:b]) for k, a, b in spans]
    assert [k for k, _ in parts] == ["name", "name", "name", "email", "phone", "phone", "nid", "iban", "card", "ip", "secret"]
    assert parts[0] == parts[2] and parts[0][1].split()[0] in pii.NAMES["latin"]["m"] and parts[1][1].split()[0] in pii.NAMES["latin"]["f"]
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(parts[4][1])[-10:] == digits(parts[5][1]) and parts[4][1].startswith("+1 (")
    assert pii.luhn(digits(parts[8][1])) and parts[8][1][0] == "4"
    assert not any(x in new for x in ("Smith", "555-0100", "123-45-6789", "4111 1111", "3da3a2ce"))
    assert new.endswith("; v1.2.3.4.5, 3.14159265, 2024-01-02") and pii.replace(PERSON, {}, KEY) == (new, spans)


@pytest.mark.parametrize("n", [500, 800, 6000])
def test_long_secrets(n):
    rng = random.Random(n)
    draw = lambda k, abc=string.ascii_letters + string.digits: "".join(rng.choice(abc) for _ in range(k))
    body = "\n".join(draw(64) for _ in range(n // 64)) + "\n" + draw(9) + "=="
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    secrets = {
        "token = {}": draw(n), 'password: "{}"': draw(n), "api_key={}": f"{draw(n)}.{draw(n)}-{draw(n)}_{draw(9)}", "{}": "sk-" + draw(n),
        "x {} y": f"sk-{draw(n)}-{draw(n)}", "k {}": f"xoxb-{draw(n)}-{draw(n)}", "<{}>": pem, '{{"key": "{}"}}': pem.replace("\n", "\\n"), "secret: {}": pem, "cut {}": pem[: pem.rindex("\n")],
    }
    for frame, secret in secrets.items():
        text = "before " + frame.format(secret) + " after words"
        new, spans = pii.replace(text, {}, KEY)
        assert len(new) == len(text) and len(spans) == 1, frame
        _, a, b = spans[0]
        assert text[a:b] == secret and new[:a] == text[:a] and new[b:] == text[b:], frame
        assert not any(secret[i : i + 12] in new for i in range(40, len(secret) - 60)), frame
        assert new[a : a + 31] == pem[:31] or "BEGIN" not in secret
    assert [k for _, _, k, _ in pii.find(f"token=abcdefgh1{pem}{pem}")] == ["secret", "private_key", "private_key"]
    assert pii.find("password: ________________ -----BEGIN PRIVATE KEY----- ... -----END PRIVATE KEY-----") == []
    assert pii.find("-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----") == []


def test_pii_distinct(spark):
    rows = [(i, f"Mr. Aa{chr(97 + i % 26)}{chr(97 + i // 26)} wrote from 10.1.{i % 250}.{i // 250 + 1}") for i in range(600)] + [(900, None), (901, ""), (902, "clean text"), (0, "again Mr. Aaaa")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii", F.lit("old"))
    got = pii.pseudonymize(df, KEY).collect()
    assert len(got) == len(rows)
    made, back = {}, {}
    for r in got:
        old = dict(rows).get(r["doc_id"]) if r["doc_id"] else None
        if r["doc_id"] in (900, 901, 902):
            assert r["text"] == old and not r["pii"]
        elif old and r["doc_id"] > 0:
            for (a, b, k, _), s in zip(pii.find(old), r["pii"], strict=True):
                assert made.setdefault((k, old[a:b]), r["text"][s["start"] : s["end"]]) == r["text"][s["start"] : s["end"]]
                assert back.setdefault((k, r["text"][s["start"] : s["end"]]), old[a:b]) == old[a:b]
    assert len(made) > 1000 and not {x for _, x in made} & {x for _, x in back}


def test_pii_of_every_script():
    for text in ("mail 李@例子.com now", "αβγ@δελτα.gr", "_@_.com", "Mr 王小明 called", "Mr Γιώργος Παπαδόπουλος called", "г-жа Анна Иванова", "nid ۱۲۳-۴۵-۶۷۸۹", "Mr محمد called"):
        new, spans = pii.replace(text, {}, KEY)
        (_, a, b), (x, y, _, _) = spans[0], pii.find(text)[0]
        assert len(spans) == 1 and new[a:b] != text[x:y] and new[:a] == text[:x] and new[b:] == text[y:]
        scripts = lambda s: [unicodedata.name(c).split()[0] for c in s if c.isalpha()]
        assert set(scripts(new[a:b])) == set(scripts(text[x:y])) or text.startswith("_")
    assert pii.replace("Mr John Smith", {}, b"one") != pii.replace("Mr John Smith", {}, b"two")
    with pytest.raises(ValueError):
        pii.pseudonymize(None, b"")


def test_pii_people():
    """One person keeps one name, with a title or without, in capitals, and by either name alone."""
    text = "Mr John Smith met Frau Smith. John Smith left, Dr John Smith came, SMITH stayed, JOHN SMITH and john smith too; Smithson and a john did not. Mr. J. Smith and John\n Smith, John's"
    new, spans = pii.replace(text, {}, KEY)
    said = [new[a:b] for _, a, b in spans]
    first, last = said[0].split(" ")
    full = f"{first} {last}"
    assert said == [full, last, full, full, last.upper(), full.upper(), full.lower(), f"J. {last}", f"{first}\n {last}", first] and first in pii.NAMES["latin"]["m"]
    assert "; Smithson and a john did not" in new and new.endswith(f"{first}'s")
    assert pii.replace("Mr SMITH", {}, KEY)[0] == pii.replace("MR SMITH", {}, KEY)[0].replace("MR", "Mr") == f"Mr {last.upper()}"
    assert pii.replace("Ms Anna Petrova, later ANNA PETROVA and Anna", {}, KEY)[1][-1][0] == "name"
    found = {t: [t[a:b] for a, b, _, _ in pii.find(t)] for t in ("Mr. O'Brien, O’Brien, O’BRIEN", "Mr. de la Cruz", "Mrs van Dyke", "Mr Juan de la Cruz; JUAN DE LA CRUZ", "MS SQL, MS Word, SR LATCH", "MS. HALL, HALL", "mr smith")}
    assert list(found.values()) == [["O'Brien", "O’Brien", "O’BRIEN"], ["de la Cruz"], ["van Dyke"], ["Juan de la Cruz", "JUAN DE LA CRUZ"], [], ["HALL", "HALL"], []]
    assert pii.replace("Mrs van Dyke", {}, KEY)[0].startswith("Mrs van ") and "Cruz" not in pii.replace("Mr. de la Cruz", {}, KEY)[0]


def test_pii_phones():
    """Country code and trunk zero stay, and a number is one entity in its national and international spellings; times are no numbers."""
    digits = lambda x: re.sub(r"\D", "", x)
    said = [pii.replace(t, {}, KEY)[0] for t in ("+44 20 7946 0958", "020 7946 0958", "0044 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958")]
    assert len({digits(x)[-10:] for x in said}) == 1 and digits(said[0]) != "442079460958"
    assert [x[:4] for x in said] == ["+44 ", said[1][:4], "0044", "+44 ", "+44" + said[4][3]] and said[1][0] == "0" and "(0)" in said[3]
    assert pii.replace("+353 1 234 5678", {}, KEY)[0].startswith("+353 ") and pii.replace("+7 495 123 45 67", {}, KEY)[0].startswith("+7 ")
    assert pii.find("2024-01-02 12:30, 01.02.2024 12, 12:30:45") == []


def test_pii_more_kinds():
    new, spans = pii.replace("at 2001:db8::1, 2001:0DB8:0:0:0:0:0:1; ::1, a::b, std::vector; passport no. C01X00T47; x" + "y" * 90 + "@" + "a." * 12 + "com", {}, KEY)
    said = [new[a:b] for _, a, b in spans]
    assert [k for k, _, _ in spans] == ["ipv6", "ipv6", "passport", "email"] and said[0].upper() == said[1] and said[0].startswith("2001:") and "::" in said[0]
    assert re.fullmatch(r"[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d", said[2]) and "::1, a::b, std::vector" in new and "yyyyyyyyy" not in new


def test_pii_permutation():
    for n in (2, 3, 10, 1000):
        to = [pii._walk(x, n, KEY, "a") for x in range(n)]
        assert sorted(to) == list(range(n)) and [pii._walk(x, n, KEY, "a", back=True) for x in to] == list(range(n))
    octets = [f"10.{a}.0.{b}" for a in range(20) for b in range(100)]
    made = [pii.permuted("ip", x, KEY) for x in octets]
    assert len(set(made)) == len(made) and all(m.startswith("10.") and m != x for m, x in zip(made, octets, strict=True))
    assert pii.luhn(pii.permuted("card", "4111111111111111", KEY)) and len({pii.permuted("nid", f"{i:09d}", KEY) for i in range(500)}) == 500
    assert [k for _, _, k, _ in pii.find(pii.permuted("iban", "DE89370400440532013000", KEY))] == ["iban"] and pii.permuted("phone", "2079460958", KEY)[0] != "0"


def brute(texts, key):
    """Genders, surrogates and collisions over a list of texts, by plain loops."""
    full, first = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    found = [(kind, form) for t in texts for _, _, kind, form in pii.find(t or "")]
    for kind, form in found:
        if kind == "name":
            given, surname = form[2:].split("|")[:2]
            if given:
                full[given, surname][form[0]] += 1
                first[given][form[0]] += 1
    who = {}
    for (given, surname), n in full.items():
        for among in (n, first[given]):
            if n["n"] and ("who", f"{given}|{surname}") not in who and among["m"] != among["f"]:
                who["who", f"{given}|{surname}"] = 1 if among["m"] > among["f"] else 2
    entities = {p for kind, form in found for p in pii.parts(kind, form, who)}
    taken = {(k, pii.printed(k, f)) for k, f in entities}
    at, settled, rest = {}, {}, sorted(entities)
    for attempt in range(64):
        shown = collections.defaultdict(list)
        for p in rest:
            shown[p[0], pii.printed(p[0], pii.surrogate(*p, attempt, key))].append(p)
        rest = []
        for s, among in shown.items():
            free = s not in taken and s not in settled.values()
            at |= dict.fromkeys(among, attempt)
            if free:
                settled[min(among)] = s
            rest += [p for p in among if not free or p != min(among)]
    return [pii.replace(t, at | who, key)[0] if t else t for t in texts]


def test_pii_brute_force(spark, monkeypatch):
    """Documents that share people, numbers and addresses: one surrogate for a person over titles, cases and documents."""
    rng = random.Random(7)
    given, last = ["John", "Anna", "Andrea", "Kim", "Jo", "Ivan", "Mia"] + [f"{a}{b}an" for a in "BCDFG" for b in "aeiou"], [f"{a}{b}{c}ner" for a in "BCDFG" for b in "aeiou" for c in "kl"]
    texts = [None, "", "plain", "Mr John Smith", "Dr John Smith", "Prof. Andrea Rossi", "Ms Andrea Rossi", "Mr Andrea Weber", "Mr Andrea Wolf", "Dr Andrea Wolf and Andrea", "Dr Kim Lee"]
    for _ in range(400):
        g, s, t = rng.choice(given), rng.choice(last), rng.choice(["Mr", "Ms", "Dr", "Prof.", "Frau"])
        texts.append(rng.choice([f"{t} {g} {s} wrote. {g.upper()} {s.upper()} and {g}", f"{t} {s} at 10.0.0.{rng.randrange(9)}", f"{t} {g} {s}: +44 20 7946 {rng.randrange(20):04d}, 020 7946 {rng.randrange(20):04d}", f"a{rng.randrange(30)}@b.org"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = brute(texts, KEY)
    assert [r["text"] for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()] == want
    assert want[4] == want[3].replace("Mr", "Dr") and want[5].removeprefix("Prof. ") == want[6].removeprefix("Ms ") and want[9].split()[1] == want[8].split()[1]
    monkeypatch.setattr(pii, "MOST_RETRIED", 0)
    assert [r["text"] for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()] == want


def test_pii_full_format(spark, monkeypatch):
    """Where a format is used up, all of its kind go by the permutation; other kinds keep their surrogates."""
    real = pii.surrogate
    monkeypatch.setattr(pii, "MOST_TRIES", 2)
    monkeypatch.setattr(pii, "surrogate", lambda kind, form, attempt, key: "123456789" if kind == "nid" and attempt >= 0 else real(kind, form, attempt, key))
    rows = [(i, f"ssn {i:03d}-11-2222, write to a{i}@b.org") for i in range(100)]
    for most in (20_000, 0):
        monkeypatch.setattr(pii, "MOST_RETRIED", most)
        got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
        assert len({t[4:15] for t in got}) == 100 and all(t[:15] != old[:15] and re.fullmatch(r"ssn \d{3}-\d\d-\d{4}, .*", t) for t, (_, old) in zip(got, rows, strict=True))


def checked(spark, rows):
    """The surrogates of rows are stable, distinct as printed, and none is an entity of rows; returns how many there are."""
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), KEY).collect()}
    made, back = {}, {}
    for i, t in rows:
        for (a, b, kind, _), s in zip(pii.find(t), got[i]["pii"], strict=True):
            was, now = t[a:b], got[i]["text"][s["start"] : s["end"]]
            for old, new in zip(was.split(" "), now.split(" "), strict=True) if kind == "name" else [(was, now)]:
                assert made.setdefault((kind, old), new) == new and back.setdefault((kind, new), old) == old
    assert not {x for _, x in made} & {x for _, x in back}
    return len(made)


def test_pii_small_spaces(spark):
    """All e-mail addresses of one letter at one letter, and many more people than given names, get surrogates of their own."""
    abc = string.ascii_lowercase
    assert checked(spark, [(i, f"write to {abc[i // 26]}@{abc[i % 26]}.com") for i in range(676)]) == 676
    rng = random.Random(3)
    name = lambda: rng.choice(abc).upper() + "".join(rng.choice(abc) for _ in range(5))
    rows = [(i, f"{rng.choice(['Mr', 'Frau'])} {name()} {name()} wrote from {rng.randrange(1, 250)}.{i % 250}.{i // 250}.7, +1 212 555 {i:04d}") for i in range(2600)]
    assert checked(spark, rows) > 10_000


def test_pii_without_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_TRIES", 3)
    monkeypatch.setattr(pii, "surrogate", lambda kind, form, attempt, key: "same")
    with pytest.raises(ValueError, match="email"):
        pii.pseudonymize(spark.createDataFrame([(1, "a@b.com c@d.com")], "doc_id long, text string"), KEY)


def test_pii_long_text(spark):
    text = "word " * 400_000 + "a@b.com " + "x" * 1_000_000 + " c@d.com"
    df = spark.createDataFrame([(1, text), (1, text), (None, None)], "hash long, text string").withColumn("tries", F.lit(7))
    rows = pii.pseudonymize(df, KEY).collect()
    assert [len(r["pii"]) for r in rows if r["text"]] == [2, 2] and {r["tries"] for r in rows} == {7} and rows[0]["text"][:9] == "word word"


def test_pii_by_join_equals_broadcast(spark, monkeypatch):
    rows = [(i, f"Mr. Bb{chr(97 + i % 26)}{chr(97 + i // 26)} is here") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "tries": F.lit(2)})
    one = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, KEY).collect()}
    monkeypatch.setattr(pii, "MOST_RETRIED", 0)
    joined = pii.pseudonymize(df, KEY)
    assert joined.columns == [*df.columns, "pii"] and {r["doc_id"]: r["text"] for r in joined.collect()} == one


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(toxicity.sample(docs, table(spark, sf, "labels")))
    memo = toxicity._Scores(model[0])
    clean = {i: t for i, t in rows.items() if model[1] + sum(memo[w] for w in toxicity.words(t or "")) < 0}
    near = brute_texts(list(clean.items()))
    kept = {i: t for i, t in clean.items() if near[i][1] == i}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == kept.keys()
    for r in out:
        want = pii.replace(kept[r["doc_id"]], {}, queries.pii_key(spark))[0]
        assert r["decoded"] == want and r["n_tokens"] * 4 == len(r["ids"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name


def test_pipeline_keeps_the_mix(spark, sf, tmp_path, monkeypatch):
    """place follows the schedule, though the files of the mixed table are of very unequal size and are read largest first."""
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    many = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = corpus_pipeline.run(spark, sf).select("place", "doc_id", "source").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", many)
    want = [(r["doc_id"], r["source"]) for r in mixing.mix(table(spark, sf, "documents")).orderBy("mix_place").collect()]
    assert sorted(r["place"] for r in out) == list(range(len(want)))
    assert [(r["doc_id"], r["source"]) for r in sorted(out, key=lambda r: r["place"])] == want
    path = str(tmp_path / "t")
    for a, b in ((0, 10), (10, 5000), (5000, 5001), (5001, 60_000)):
        spark.range(a, b, numPartitions=1).write.parquet(f"{path}/{a}")
    files = sorted((f for d in (0, 10, 5000, 5001) for f in (tmp_path / "t" / str(d)).glob("*.parquet")), key=lambda f: int(f.parent.name))
    for i, f in enumerate(files):
        f.rename(tmp_path / "t" / f"part-{99_998 + i:05d}-x.parquet")
    assert corpus_pipeline.placed(spark.read.parquet(f"{path}/*.parquet")).where("place <> id").count() == 0
