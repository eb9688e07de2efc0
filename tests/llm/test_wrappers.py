"""Main text of hand-made and given pages."""

import html
import random
import re
import time

import pytest

from framewright.llm import wrappers as W

PAGES = {
    "": "",
    "plain &lt; 5 text &amp more": "plain < 5 text & more",
    "<p>a  b\n c<br>d<p>e": "a b c d\n\ne",
    "<article><h1>T</h1><p>x<script>y</p></script>z</p><!-- c --><div class='reader-comments'>no</div></article><p>out": "T\n\nxz",
    "<body><header><h1>Site</h1></header><div class=menu>m</div><div id=content><h2>T</h2><p>A &#233; &eacute;</p><ul><li>one<li>two</ul></div>"
    "<aside>s</aside><div class='cookieNotice'>c</div><form>f</form><footer>f</footer>": "T\n\nA é é\n\none\n\ntwo",
    "<main><p>kept</p><nav>menu</nav></main><div>left</div>": "kept",
    "<table><tr><td>a<td>b</table>": "a\n\nb",
    "<div>" * 3000 + "deep": "deep",
    "<p>cut <b": "cut",
    "<p hidden>no</p><p>yes</p>": "yes",
}


@pytest.mark.parametrize("source", list(PAGES))
def test_single_pages(source):
    assert W.extract_group([source]) == [PAGES[source]]


def test_deep_nesting_ends_where_it_ends():
    deep = "<div>" * 130 + "in" + "</div>" * 130
    page = f"<body><div><article><p>first</p><div>{deep}</div><p>rest</p></article></div><p>out</p></body>"
    assert W.extract_group([page]) == ["first\n\nin\n\nrest"]
    page = "<body>" + "<div>" * 130 + "a<p>b</p><nav>menu</nav><p>c" + "</div>" * 130 + "<p>d</p></body>"
    assert W.extract_group([page]) == ["a\n\nb\n\nc\n\nd"]


def test_constant_slots_are_template():
    page = "<body><div class='box'><h4>All rights of this site</h4></div><div class='text'><h1>{0}</h1><p>{0} has words of its own {0}</p></div>" \
           "<div><p>Read our terms</p></div></body>"
    texts = W.extract_group([page.format(f"story{k}" * 9) for k in range(6)])
    assert texts == [f"{s}\n\n{s} has words of its own {s}" for s in (f"story{k}" * 9 for k in range(6))]
    copies = W.extract_group([page.format("same") for _ in range(6)])
    assert len(set(copies)) == 1 and "same has words" in copies[0]


def varied(rng, k, extra=""):
    """An article page of its own shape and words."""
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    parts = [f"<{t}>{words(8)}</{t}>" for t in rng.choices(("p", "h2", "blockquote", "pre"), k=rng.randint(3, 7))]
    return f"<body><div class='top'>Our site</div><article><h1>Page {k} {words(2)}</h1>{''.join(parts)}{extra}</article></body>"


def test_copies_are_no_template():
    rng = random.Random(3)
    pages = [varied(rng, k) for k in range(29)]
    copy = "<body><article><h1>Copy</h1><p>Its own words</p><ul><li>one<li>two</ul></article></body>"
    texts = W.extract_group([*pages, copy, copy, copy])
    assert texts[29:] == ["Copy\n\nIts own words\n\none\n\ntwo"] * 3
    # Near copies, one word each apart, speak once as well.
    long = "<body><article><h1>Copy</h1><p>" + " ".join(f"word{i}" for i in range(60)) + " {0}</p><ul><li>one<li>two</ul></article></body>"
    texts = W.extract_group([*pages[:5], *(long.format(f"x{k}") for k in range(20))])
    assert all(t.startswith("Copy\n\nword0") and t.endswith("one\n\ntwo") for t in texts[5:])


def test_what_half_of_the_families_hold_is_template():
    rng = random.Random(4)
    note = "<div class='tools'>Print this story<p>of its own {0}</p></div>"
    texts = W.extract_group([varied(rng, k, note.format(f"n{k}")) for k in range(12)])
    assert all("Print this" not in t and t.endswith(f"of its own n{k}") for k, t in enumerate(texts))
    texts = W.extract_group([varied(rng, k, "<div class='tools'>Print this story</div>" if k < 4 else "") for k in range(12)])
    assert sum("Print this" in t for t in texts) == 4


def test_all_that_varies_beside_the_body_of_text_stays():
    page = "<body><div class='brand'>The Paper</div><div class='lead'>Standfirst {0}</div><div class='story'><h1>T {0}</h1><p>{1}</p></div>" \
           "<div class='after'>Closing {0}</div><div class='related-stories'><p>More {0}</p></div></body>"
    pages = [page.format(f"s{k}", " ".join(f"a{k}b{i}" for i in range(80))) for k in range(12)]
    for k, text in enumerate(W.extract_group(pages)):
        assert text == f"Standfirst s{k}\n\nT s{k}\n\n{' '.join(f'a{k}b{i}' for i in range(80))}\n\nClosing s{k}"


@pytest.mark.parametrize("name, kept", [
    ("related-work", True), ("search-engine-history", True), ("notice-of-decision", True), ("promotion-to-captain", True), ("entry-header", True),
    ("reader-comments", False), ("cookieNotice", False), ("ad-slot-2", False), ("sidebar left", False), ("commentList", False), ("promo-box", False)])
def test_names_of_sections(name, kept):
    page = f"<body><article><h1>T {{0}}</h1><p>text {{0}}</p><section class='{name}'><p>section {{0}}</p></section></article></body>"
    texts = W.extract_group([page.format(f"v{k}" * 20) for k in range(9)])
    assert all(("section v" in t) == kept and "text v" in t for t in texts)


def test_scripts_and_odd_tags():
    assert W.extract_group(["<p>a<script>var x = '<!--';</script><p>b"]) == ["a\n\nb"]
    assert W.extract_group(["<p title='a > b'>x</p><p title=\"open>y<p>z</p>"]) == ["x\n\ny\n\nz"]
    assert W.extract_group(["<svg/><p>after"]) == ["after"]


@pytest.mark.parametrize("piece", [
    "<div>", "</div>", "</i>", "<i><div>", "<p><span>", "<li><div>", "<a", "<a ", "<a \">", "<a '\">", "<svg/>", "<!-", "<b><p></b>", "<td><p>",
    "<p>x<ul>y</ul>", "<dt><span>"])
def test_hostile_html_takes_linear_time(piece):
    times = []
    for size in (50_000, 400_000):
        begun = time.process_time()
        W.extract_group([piece * (size // len(piece))])
        times.append(time.process_time() - begun)
    assert times[1] < 10 and times[1] < 30 * times[0] + 0.5, times


def test_many_slots_are_matched_from_both_ends():
    a, b = (W.Shape([W.parse("<h1>t</h1>" + "<p>x<ul><li>y</ul>" * n + "<hr><table><td>z</table>")]) for n in (900, 901))
    size, pairs = W.tree_matching(a, b)
    names = [x.name[0] for x, _ in pairs]
    assert size == len(pairs) and names[0] == "html" and {"h1", "hr", "table", "li"} <= set(names)


def test_tree_matching():
    a, b = (W.Shape([W.parse(s)]) for s in ("<ul><li>1</ul><p>x<div><h1>h</h1></div>", "<p>x<div><h1>h</h1><p>y</div><hr>"))
    size, pairs = W.tree_matching(a, b)
    assert size == 4 == len(pairs) and [x.name[0] for x, _ in pairs] == ["html", "div", "h1", "p"]


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = W.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, "https://a.example/x", None, 1), (1, "https://a.example/x", "<p>t", 1), (None, None, "<p>u", 1), (3, "no url", "", 1)]
    rows += [(10 + k, "https://hot.example/", f"<article><p>page {k}</article>", 1) for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumnRenamed("host", "text")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in W.extract(pages).collect())
    assert got == sorted([("1", "", 0), ("1", "t", 1), ("None", "u", 1), ("3", "", 0)] + [(str(10 + k), f"page {k}", len(f"page {k}")) for k in range(100)])
    assert W.extract(pages.where("1 = 0")).count() == 0


def test_a_hot_host_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(W, "PIECE_PAGES", 50)
    pages = spark.range(0, 700).selectExpr(
        "id page_id", "if(id % 3 = 0, 'http://hot.example/', concat('http://h', id % 20, '.example/')) url",
        "concat('<body><div class=x>Motto of the house</div><div><p>', repeat(concat(md5(string(id)), ' '), 5), '</p></div></body>') html")
    got = {r.page_id: r.text for r in W.extract(pages).collect()}
    assert len(got) == 700 and not any("Motto" in t for t in got.values()) and all(len(t) == 164 for t in got.values())
