from __future__ import annotations

import html
import random
import re
import time

from postmill.llm.pages import Weights, extract_pages, fit, main_text, op8_html_extraction, region

SF = "/root/testdata/sf0.01"


def test_query_gives_the_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op8_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_region_is_the_best_stretch():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randrange(-4, 5) for _ in range(rng.randrange(0, 12))]
        a, b = region([(s, True) for s in scores])
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[a:b]) == best


STORY = " ".join(["A sentence of the story with <b>bold</b> and <a href='x'>linked</a> words."] * 4)
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p > b {{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies and more cookies to make this page work for you today.</div>
<div id="content" class="page with-sidebar"><h1>Head &amp; line</h1><p>{STORY}
<div class="ad-box">Buy it now, buy it here, buy it soon, buy it all.</div><p>Second&nbsp;&#233;&eacute; {STORY}</p>
<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>no</p> --><p>Third {STORY}</div>
<section id="comments"><p>I liked it very much and want to tell you so at length, dear people.</p></section>
<form><label>Name</label><input name=a></form><footer>&copy; Site</footer></body></html>"""


def test_a_page_without_landmarks():
    got = main_text(PAGE, Weights()).split("\n")
    story = re.sub("<[^>]*>", "", STORY)
    assert got == ["Head & line", story, f"Second éé {story}", f"Third {story}"]


def test_odd_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>" + "word " * 300_000, "x"), (5, "u", "<article><p>a<!-- open", "x"), (6, "u", "plain < text > here", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.n_chars) for r in extract_pages(pages, fit(pages)).collect()}
    assert {k for k, _ in got} == {1, 2, 3, None, 5, 6} and {(2, 0), (3, 0), (5, 1), (None, 1_499_999)} <= got
    assert extract_pages(pages.limit(0), fit(pages.limit(0))).count() == 0


def test_tags_are_read_by_their_quotes_and_nesting():
    def text(inner):
        return main_text(f"<html><body><article>{inner}</article></body></html>", Weights())

    assert text("<p data-x=it's>words of it</p><p class='a\">b'>more</p><p title=\"5 > 3\">last</p>") == "words of it\nmore\nlast"
    assert text("<p>one <span class=ad><span>x</span> BUY NOW</span> two</p>") == "one two"
    assert text("<p>one or some more words <span class=ad><div><span>x</span> BUY</div> NOW</span> two as long as the one before</p><p>three</p>") == "one or some more words two as long as the one before\nthree"
    assert text("<p>one <span class=ad>never closed</p><p>two</p>") == "one\ntwo"
    assert text("<p>as <math><mi>a</mi> + <mi>b</mi></math> shows</p>") == "as a + b shows"
    assert text("<p>an <svg><text>drawn</text></svg> icon <svg class=x /> here</p><svg-note>kept as no such drawing</svg-note>") == "an icon here\nkept as no such drawing"
    assert text("<p class=related-work>work</p><p class='promoted-story'>story</p><p class='x ad'>buy</p><div class=ad-box>buy</div>") == "work\nstory"
    assert text("<p>a < b and c > d, x=\"y</p>") == "a < b and c > d, x=\"y"


def test_unclosed_quotes_and_tags_take_linear_time():
    for piece in ("<p a=\"", "<p a='x", "<span class=ad>", "</span>", "<svg ", "<p =", "<a href=x="):
        began = time.time()
        main_text("<article>words " + piece * 20_000, Weights())
        assert time.time() - began < 20, piece
