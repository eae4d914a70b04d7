"""Wrapper induction: reading, tree matching against brute force, and whole pages."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest

from headcount.llm import html

SCHEMA = "page_id long, url string, html string, text string, host string, n long"


def texts(source):
    return [t for _, _, t in html.read(source)[1]]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, []),
        ("", []),
        ("plain  text &amp; more", ["plain text & more"]),
        ("<p>one<p>two <b>bold</b>\n x<br>y", ["one", "two bold x y"]),
        ("<head><title>t</title><body><article><h1>a</h1>b</article>", ["a", "b"]),
        ("<html><head><meta x><body>a</body>", ["a"]),
        ("<script>var t='<p>x</p>';</script><style>p{}</style>a<!-- <p>no</p> -->b", ["ab"]),
        ("<SCRIPT>never closed <p>x", []),
        ("<nav><ul><li>x</li></ul></nav><p>a</p><footer>y</footer><aside>z</aside>", ["a"]),
        ("<header>site</header><article><header><h1>Title</h1></header><p>a</p></article>", ["Title", "a"]),
        ("<div class='side-bar ad'>x</div><p class=lead>a <span class=\"ad\">buy</span> b</p>", ["a b"]),
        ("<p>a <span class=ad>x <span>y</span> z</span> b</p><p>c", ["a b", "c"]),
        ("<p>a <span class=ad>x</p><p>c", ["a", "c"]),
        ("<form>x<article><p>a</p></article></form>", ["a"]),
        ("<div id='comments'><article><p>spam</p></article></div><p>a</p>", ["a"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("a < b and c <3 <p title='x>y'>d", ["a < b and c <3", "d"]),
        ("<p hidden>x</p><div aria-hidden=true>y</div><p>&#233;&eacute;&nbsp;z", ["éé z"]),
        ("</div></p>a</b></article>", ["a"]),
        ("<" * 5000, ["<" * 5000]),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, ["deep"]),
    ],
)
def test_read(source, want):
    assert texts(source) == want


def test_very_long_page():
    source = "<article>" + "<p>word &amp; word</p><h2>x</h2>" * 20_000 + "<a href='" * 2000
    assert len(texts(source)) >= 40_000
    assert len(html.main_texts([html.read(source)] * 2)) == 2


def random_tree(draw, depth=0):
    node = html.Node(draw.choice("ab") if depth else "root")
    if depth < 3:
        node.children = [random_tree(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    node.form = hash((node.label, *[c.form for c in node.children]))
    return node


def plain(a, b):
    """The best order-preserving matching, over all ways to pair the children."""
    if a.label != b.label:
        return 0

    @lru_cache(None)
    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        return max(best(i + 1, j), best(i, j + 1), plain(a.children[i], b.children[j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_matching_equals_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        a, b = random_tree(draw), random_tree(draw)
        assert html.matching(a, b, {}) == plain(a, b)
        pairs = html._pairs(a.children, b.children, {})
        gain = sum(plain(a.children[i], b.children[j]) for i, j in pairs)
        assert gain == plain(a, b) - 1 and pairs == sorted(pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def page(i, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        "<html><body><div><span>All rights with nobody</span></div>"
        f"<div><p>Topic of the day</p></div>{extra}<div class=x{i % 2}>{body}</div><div>Back to the top</div>"
    )


def rows():
    out = []
    for i in range(30):
        extra = "<div><p>Only some have this</p></div>" if i % 3 == 0 else ""
        out.append((i, f"http://A.example/{i}", page(i, [f"First {i} of page", "Shared by two" if i < 2 else f"Second {i}"], extra)))
    for i in range(10):
        out.append((100 + i, "https://u@b.example:80/x", "<main><p>Copied &amp; copied again</p></main><p>out</p>"))
    out += [(200, None, None), (201, "", ""), (202, "nothing", "<p>alone"), (None, "http://c.example", "<p>x")]
    out += [(300, "http://d.example/1", "<p>twice")] * 2
    return [(*r, "clash", "clash", 9) for r in out]


@pytest.mark.parametrize("chunk", [64, 8])
def test_extract(spark, monkeypatch, chunk):
    monkeypatch.setattr(html, "CHUNK", chunk)
    got = html.extract(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows())
    text = {r.page_id: r.text for r in got}
    if chunk == 64:
        for i in range(30):
            some = ["Only some have this"] if i % 3 == 0 else []
            assert text[i].split("\n\n") == [*some, f"First {i} of page", "Shared by two" if i < 2 else f"Second {i}"]
    # copies alone make no template
    assert all(text[100 + i] == "Copied & copied again" for i in range(10))
    assert text[200] == text[201] == "" and text[202] == "alone" and text[None] == "x" and text[300] == "twice"
    assert all(r.n_chars == len(r.text) for r in got)


def test_broadcast_or_not(spark, monkeypatch):
    frame = spark.createDataFrame(rows(), SCHEMA)
    first = sorted(map(str, html.extract(frame).collect()))
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(str, html.extract(frame.repartition(2)).collect())) == first


def test_empty(spark):
    assert html.extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div class='content no-sidebar'><p>text</p></div>", ["text"]),
        ("<div class='post-related-notice'><p>text</p></div><p>b</p>", ["text", "b"]),
        ("<div style='overflow:hidden'>a</div><div data-hidden='false'>b</div><p><a href='/hidden-valley'>c</a>", ["a", "b", "c"]),
        ("<div class='page widget'><p>x</p><article><p>a</p></article></div><p>bbbbbbbb</p>", ["x", "a", "bbbbbbbb"]),
        ("<div class=widget><p>most of the text</p><div class=menu>m</div></div><p>b</p>", ["most of the text", "b"]),
        ("<div class=sidebar><p>x</p></div><p>long enough</p>", ["long enough"]),
        ("<div title='class=ad'>a</div>", ["a"]),
    ],
)
def test_words_name_furniture_only_as_whole_classes(source, want):
    assert texts(source) == want


def test_region_with_most_varying_text():
    teasers = [
        f"<div class=text><p>A long story number {i} that goes on for a while</p></div>"
        f"<article><p>More {i}</p></article>"
        for i in range(6)
    ]
    got = html.main_texts([html.read(t) for t in teasers])
    assert got == [f"A long story number {i} that goes on for a while" for i in range(6)]
    leads = [f"<p>Lead {i}</p><article><p>A long story number {i} that goes on</p></article>" for i in range(6)]
    got = html.main_texts([html.read(t) for t in leads])
    assert got == [f"Lead {i}\n\nA long story number {i} that goes on" for i in range(6)]


def test_template_of_one_layout_among_several():
    one = [f"<div class=a><h1>Shop {i}</h1><p>Buy it now</p></div>" for i in range(9)]
    two = [f"<section><h2>Post {i}</h2><ul><li>Read our rules</ul></section>" for i in range(6)]
    got = html.main_texts([html.read(p) for p in one + two])
    assert got == [f"Shop {i}" for i in range(9)] + [f"Post {i}" for i in range(6)]


def test_long_lists_of_siblings_are_matched_as_short_ones(monkeypatch):
    draw = random.Random(9)
    for _ in range(200):
        a, b = random_tree(draw).children, random_tree(draw).children
        monkeypatch.setattr(html, "CELLS", 250_000)
        short = html._pairs(a, b, {})
        monkeypatch.setattr(html, "CELLS", 0)
        assert html._pairs(a, b, {}) == short
