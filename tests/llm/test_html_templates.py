"""Templates inside marked articles, and of layouts that the page with the smallest id lacks."""

from tessera.llm import html_extract

LONG = "a text of its own that is longer than the line, number"


def extracted(spark, htmls):
    rows = [(k, f"http://h.example/{k}", h) for k, h in enumerate(htmls)]
    return [r.text for r in sorted(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_constant_blocks_inside_an_article(spark):
    got = extracted(spark, [f"<article><h1>T {k}</h1><p>{LONG} {k}</p><p>Read us daily</p></article>" for k in range(6)])
    assert got == [f"T {k}\n{LONG} {k}" for k in range(6)]


def test_near_copies_keep_their_text(spark):
    got = extracted(spark, [f"<article><p>Seen {k} times</p><p>{LONG}</p></article>" for k in range(6)])
    assert got == [f"Seen {k} times\n{LONG}" for k in range(6)]


def test_the_smallest_page_does_not_decide(spark):
    other = [f'<div class="x1">Menu</div><div class="x2">{LONG} {k}</div><div class="x3">Call us</div>' for k in range(8)]
    banner = [f'<div class="x0">Sale</div>{h}' for h in (h.replace("number ", "number 1") for h in other)]
    got = extracted(spark, [None, '<table class="front"><tr><td>Front</td></tr></table>', *other, *banner[:4]])
    assert got == ["", "Front", *[f"{LONG} {k}" for k in range(8)], *[f"{LONG} 1{k}" for k in range(4)]]
