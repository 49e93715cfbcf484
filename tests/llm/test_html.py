"""HTML extraction: rules, templates of hosts, hostile markup, and the alignment against brute force."""

import random
import time
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import pytest

from tessera.llm import html_extract
from tessera.llm.html_extract import Matching, Node, Reference, Tree, page_text, parse

CASES = {
    "plain": ("<p>a  b\n c</p><p>d", "a b c\nd"),
    "entities": ("<article><p>a &amp; b &lt;c&gt; &#233;&#x1F600; &copy x &am y</p></article>", "a & b <c> é\U0001f600 © x &am y"),
    "inline": ("<div>a<b>b</b><i> c</i> <a href='x>y'>d</a></div>", "ab c d"),
    "breaks": ("<article><p><b>Title<br><p>one<br>two</p></article>", "Title\none two"),
    "raw": ("<script>var t='</p><p>x';</script><style>p{}</style><p>ok</p><noscript>no</noscript><textarea>no</textarea>", "ok"),
    "comments": ("a<!-- <p>no</p> --><p>b<!-- x > y --></p><!-- open <p>c", "a\nb"),
    "chrome": (
        "<header>h</header><nav><ul><li>m</ul></nav><main><h1>T</h1><p>x</p><aside>s</aside><form>f<input></form></main><footer>f</footer>",
        "T\nx",
    ),
    "classes": ('<div class="main-nav">n</div><div id=cookieNotice>c</div><div class="post">x</div><div role="banner">b</div><div class="ad">a</div>', "x"),
    "inline advert": ('<article><p>a <span class="ad">buy</span> b</p></article>', "a b"),
    "reader comments": ('<article><p>x</p><section class="comments"><article><p>no</p></article></section></article>', "x"),
    "lists and tables": ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><th>e</table><dl><dt>f<dd>g</dl>", "a\nb\nc\nd\ne\nf\ng"),
    "cut off in a tag": ("<article><p>a</p><p cla", "a"),
    "cut off in a quote": ('<article><p>a</p><p class="b', "a"),
    "cut off in text": ("<article><p>a</p><p>b &am", "a\nb &am"),
    "stray": ("<p>1 < 2 > 0</p></div></b><p>x</p>", "1 < 2 > 0\nx"),
    "hidden": ('<p hidden>no</p><div style="display: none">no</div><p aria-hidden="true">no</p><p>x</p>', "x"),
    "doctype": ('<!DOCTYPE html><?xml version="1.0"?><html><head><title>no</title><meta charset=x></head><body>x</body></html>', "x"),
    "header in article": ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
    "header of a post": ('<div class="site-header">s</div><div class="post"><div class="post-header"><h1>T</h1></div><p>x</p></div>', "T\nx"),
    "spaces": ("<p>a&nbsp;&nbsp;b c</p><p> </p><p>&#32;</p>", "a b c"),
    "empty": ("", ""),
    "upper case": ("<ARTICLE><P>x</P><NAV>n</NAV></ARTICLE>", "x"),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    html, want = CASES[name]
    assert page_text(html) == want


def test_long_and_deep():
    assert page_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert page_text("<b>" * 50_000 + "x") == "x"
    assert page_text("<" * 50_000) == "<" * 50_000
    assert page_text("<p>x</p>" * 20_000).count("\n") == 19_999


HOSTILE = {
    "quotes": "<a '" * 20_000,
    "open quotes": "<p>x</p>" + '<a href="' * 20_001 + "<p>y</p>",
    "spaces": "<a " + "b " * 50_000 + "=" * 50_000 + ">x",
    "stray ends": "<b>" * 20_000 + "<i>" + "<div>" + "<b>" * 20_000 + "x</i></p></div>" * 20_000,
    "paragraphs": "<p><div>" + "<b>" * 20_000 + "<p>x" * 20_000,
    "raw": "<script>" * 20_000 + "<title" * 20_000,
    "comments": "<!--" * 20_000 + "<!" * 20_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_page(name):
    began = time.perf_counter()
    page_text(HOSTILE[name])
    assert time.perf_counter() - began < 10


def test_names_never_empty_an_article():
    for html in (
        '<article class="post comments-open"><p>Hello</p></article>', '<main class="has-sidebar"><p>Hello</p></main>',
        '<div class="wrap with-footer"><article><p>Hello</p></article></div>', '<div class="sidebar"><article class="ad"><p>Hello</p></article></div>',
        '<article><div class="related-work"><p>Hello</p></div></article>', '<header class="site"><main><p>Hello</p></main></header>',
    ):
        assert page_text(html) == "Hello", html
    assert page_text('<div class="post"><p>x</p></div><section class="comments"><article>no</article></section>') == "x"
    assert page_text('<main><p>x</p><div id="reader-comments"><article>no</article></div></main>') == "x"


def random_page(rng, depth, kinds="ab"):
    kind = rng.choice(kinds)
    return f'<div class="{kind}">' + "".join(random_page(rng, depth - 1) for _ in range(rng.randrange(4)) if depth) + "x</div>"


def shape(tree, k=0):
    return tree.labels[k], tuple(shape(tree, x) for x in tree.kids[k])


@lru_cache(None)
def most_pairs(x, y):
    """The size of the largest match by its definition."""
    if x[0] != y[0]:
        return 0

    @lru_cache(None)
    def best(i, j):
        if i == len(x[1]) or j == len(y[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), most_pairs(x[1][i], y[1][j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_alignment_is_the_largest():
    rng = random.Random(1)
    for _ in range(300):
        a = Tree(parse("".join(random_page(rng, 3) for _ in range(rng.randrange(4))))[0])
        b = Tree(parse("".join(random_page(rng, 3) for _ in range(rng.randrange(4))))[0])
        r = Reference(b.labels, [len(k) for k in b.kids])
        assert shape(a) == shape(Reference(a.labels, [len(k) for k in a.kids])) and b.shapes == r.shapes
        pairs = Matching(a, r).pairs()
        assert len(pairs) == len(set(pairs.values())) == Matching(a, r).score(0, 0) == most_pairs(shape(a), shape(b))
        up = {x: k for t in (a, r) for k, kids in enumerate(t.kids) for x in kids if t is a}
        over = {x: k for k, kids in enumerate(r.kids) for x in kids}
        assert all(a.labels[x] == r.labels[y] and (x == 0 or pairs[up[x]] == over[y]) for x, y in pairs.items())
        assert sorted(pairs.values()) == [pairs[x] for x in sorted(pairs)]


def test_runs_collapse():
    nodes, blocks = parse("<ul><li>a<li>b<li>c</ul><p>x</p><p>y</p>")
    tree = Tree(nodes)
    assert tree.labels == ["#", "ul", "li", "p"] and tree.kids == [[1, 3], [2], [], []]
    assert [tree.of[id(n)] for n, _ in blocks] == [2, 2, 2, 3, 3]


# --- the whole extraction by brute force, on well-formed pages ---


class Dom(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.root = {"label": "#", "kids": [], "texts": [], "names": "", "tag": "#"}
        self.stack, self.blocks = [self.root], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        kind = dict(attrs).get("class", "")
        node = {"label": f"{tag}.{kind}" if kind else tag, "kids": [], "names": kind, "tag": tag}
        self.stack[-1]["kids"].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.blocks.append((list(self.stack), " ".join(data.split())))


def collapsed(node, home):
    """(label, kids) with runs of equal shapes as one; home maps nodes to paths in it."""
    kids, members = [], []
    for kid in node["kids"]:
        mine = {}
        t = collapsed(kid, mine)
        if not kids or kids[-1] != t:
            kids.append(t)
        for k, path in mine.items():
            home[k] = (len(kids) - 1, *path)
    home[id(node)] = ()
    return node["label"], tuple(kids)


def paired(x, y, at=(), to=()):
    """One largest match, by paths."""
    out, i, j = {at: to}, 0, 0
    best = lru_cache(None)(lambda i, j: 0 if i == len(x[1]) or j == len(y[1]) else max(best(i + 1, j), best(i, j + 1), most_pairs(x[1][i], y[1][j]) + best(i + 1, j + 1)))
    while i < len(x[1]) and j < len(y[1]):
        pair = most_pairs(x[1][i], y[1][j])
        if pair and best(i, j) == pair + best(i + 1, j + 1):
            out |= paired(x[1][i], y[1][j], (*at, i), (*to, j))
            i, j = i + 1, j + 1
        elif best(i, j) == best(i + 1, j):
            i += 1
        else:
            j += 1
    return out


def nodes_of(t):
    return 1 + sum(nodes_of(k) for k in t[1])


def brute_extract(pages):
    """pages: {id: (host, html)}. Rules: nav, aside, class ad; inside article where there is one."""
    doms, texts, told = {}, {}, {}
    for i, (host, html) in pages.items():
        dom, home = Dom(html), {}
        tree = collapsed(dom.root, home)
        inside = [any(n["tag"] == "article" for n in path) for path, _ in dom.blocks]
        dropped = [any(n["tag"] in ("nav", "aside") or n["names"] == "ad" for n in path) for path, _ in dom.blocks]
        marked = any(w and not d for w, d in zip(inside, dropped))
        keep = [not d and (w or not marked) for w, d in zip(inside, dropped)]
        doms[i] = (host, tree, [(home[id(path[-1])], t) for path, t in dom.blocks], keep, inside)
    layouts = {}
    for host, tree, blocks, _, _ in doms.values():
        if blocks:
            layouts.setdefault(host, Counter())[tree] += 1
    assert all(len(c) <= html_extract.LAYOUTS for c in layouts.values())
    for i, (host, tree, blocks, keep, _) in doms.items():
        refs = list(layouts.get(host, ()))
        if not refs:
            continue
        ref = max(refs, key=lambda r: most_pairs(tree, r) / (nodes_of(tree) + nodes_of(r)))
        pairs = paired(tree, ref)
        told[i] = [(ref, pairs[p]) if p in pairs else None for p, _ in blocks]
    have, same, seen = Counter(), Counter(), set()
    for i, slots in told.items():
        host, _, blocks, keep, _ = doms[i]
        article = "\n".join(t for (_, t), k in zip(blocks, keep) if k)
        if (host, article) in seen:
            continue
        seen.add((host, article))
        have.update({(host, s) for s in slots if s})
        same.update({(host, s, t) for s, (_, t) in zip(slots, blocks) if s})
    for i, (host, _, blocks, keep, inside) in doms.items():
        constant = [s is not None and have[host, s] >= 4 and same[host, s, t] >= 0.9 * have[host, s] for s, (_, t) in zip(told.get(i, [None] * len(blocks)), blocks)]
        article = [k for k, ok in enumerate(keep) if ok and inside[k]]
        if 2 * sum(len(blocks[k][1]) for k in article if constant[k]) > sum(len(blocks[k][1]) for k in article):
            constant = [c and k not in article for k, c in enumerate(constant)]
        texts[i] = "\n".join(t for k, (_, t) in enumerate(blocks) if keep[k] and not constant[k])
    return texts


def site_page(rng, site, k):
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(99)) for _ in range(n))
    body = "".join(f"<p>{words(rng.randrange(3, 9))}</p>" for _ in range(rng.randrange(1, 5)))
    notice = "<p>Read us every day</p>" if site % 2 else ""
    story = f'<div class="s{site}"><h1>{words(3)}</h1>{body}{notice}</div>'
    if site % 3 == 0:
        story = f"<article>{story}</article>"
    top = f'<div class="t{site}"><div class="u">Home of {site}</div><div class="v">Today: {words(1)}</div></div>'
    banner = f'<div class="b{site}">Sale at {site}</div>' if rng.random() < 0.5 else ""
    extra = f'<nav>{words(2)}</nav><div class="ad">{words(4)}</div>' if rng.random() < 0.5 else ""
    return f'<html><body>{top}{banner}{extra}{story}<div class="f{site}">Call site {site}</div></body></html>'


def test_extract_against_brute_force(spark):
    rng = random.Random(11)
    pages = {}
    for site in range(6):
        for k in range(rng.randrange(1, 30)):
            pages[len(pages)] = (f"h{site}.example", site_page(rng, site, k))
        pages[len(pages)] = (f"h{site}.example", pages[len(pages) - 1][1])  # a copy
    pages[len(pages)] = ("h1.example", "")
    rows = [(i, f"http://{h}/{i}", t) for i, (h, t) in pages.items()]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_extract(pages)
    assert got == want
    # the alignment does the work here: on most pages the marks alone leave constant blocks in
    assert sum(page_text(t) != want[i] for i, (_, t) in pages.items()) > 0.6 * len(pages)


def test_deep_and_wide_pages(spark):
    wide = "".join(f"<h3>t{k}</h3>" + f"<p>x{k}</p>" * (k % 7 + 1) for k in range(900))
    rows = [(0, "<div>" * 100_000 + "deep"), (1, "<div>" * 100_000 + "deeper"), (2, wide), (3, wide + "<ul><li>y</ul>" + wide), (4, None)]
    rows += [(k, "<ul><li>" * 3000 + f"n{k}") for k in range(5, 10)]
    pages = spark.createDataFrame([(k, "http://d.example/", t) for k, t in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[0] == "deep" and got[1] == "deeper" and got[4] == "" and [got[k] for k in range(5, 10)] == [f"n{k}" for k in range(5, 10)]
    assert got[2] == page_text(wide) and got[3].count("\n") == 2 * got[2].count("\n") + 2


def test_wrappers(spark):
    def page(k, body):
        return f'<html><body><div class="top">Same line</div><div class="story"><h2>Title {k}</h2><p>{body}</p></div><div class="end">Call us</div></body></html>'

    rows = [(k, f"http://h.example/{k}", page(k, f"body {k}"), "x") for k in range(8)]
    rows += [(100 + k, "https://copies.example:80/x?y", page(0, "one text"), "x") for k in range(5)]  # copies tell nothing about the template
    rows += [(200, "http://one.example", page(9, "alone"), "x"), (201, None, page(9, "no url"), "x"), (202, "http://h.example/null", None, "x"), (203, "", "", "x")]
    rows += [(300 + k, "http://a.example/", f"<article><p>Fixed intro</p><p>own {k}</p></article><div>Sub</div>", "x") for k in range(4)]
    rows += [(0, "http://h.example/0", page(0, "body 0"), "x"), (None, "http://h.example/", page(77, "odd"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in html_extract.extract(pages).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Title 3\nbody 3"] and got[0] == ["Title 0\nbody 0"] * 2 and got[None] == ["Title 77\nodd"]
    assert got[102] == ["Same line\nTitle 0\none text\nCall us"] and got[200] == ["Same line\nTitle 9\nalone\nCall us"]
    assert got[201] == ["Same line\nTitle 9\nno url\nCall us"] and got[202] == [""] and got[203] == [""]
    assert got[301] == ["Fixed intro\nown 1"]
    assert html_extract.extract(pages.limit(0)).count() == 0
