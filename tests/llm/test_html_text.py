import html
import re

import pyarrow.parquet as pq

from fabula.llm.html_text import extract, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, all of them, on every page, always and everywhere.</p></div>
<div class="content"><h1>Head &amp; line</h1><p>First paragraph, with <b>bold</b>,
 and <a href=y>a link</a>.<p>Second one has &lt;tags&gt; &#233;, and more, and more.<br>Same block.<script>var x = "</p>";</script>
<form><input value=1>Sign up</form><aside>Side</aside><div class="comments"><p>I disagree, strongly, with all of this, as I always do.</p></div></div>
<footer>&copy; nobody</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Head & line First paragraph, with bold, and a link. Second one has <tags> é, and more, and more. Same block."


def test_broken_and_odd_pages():
    assert main_text(None) == main_text("") == main_text("<div></div>") == ""
    assert main_text("plain, text") == "plain, text"
    assert main_text("<p>open <i>tags <p>next</i></b></div>") == "open tags next"
    assert main_text("<div>" * 30_000 + "deep, text") == "deep, text"
    assert main_text("<script>never closed") == ""
    assert main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    long = "<article>" + "<p>Words, and words, and more of them here.</p>" * 20_000 + "</article>"
    assert main_text(long).count("more of them") == 20_000


def test_links_lose_to_text():
    links = "<div>" + "".join(f"<p><a href=x>A long link label, with commas, number {i}</a></p>" for i in range(30)) + "</div>"
    assert main_text(links + "<div><p>The text, which is short, but no link, is what counts here.</p></div>").startswith("The text")


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r.page_id or 0), r.n_chars == len(r.text)) for r in got) == [(0, True), (1, True), (1, True)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain(source):
    """The text of the page's only article by substitutions, without white space."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", source, re.S | re.I)[1]
    for drop in (r"<!--.*?-->", r"<(script|style|nav|aside|form|footer|header)\b.*?</\1>", r'<div class="(?:ad|comments?|share|related|promo)[^"]*">.*?</div>', r"<[^>]+>"):
        inner = re.sub(drop, " ", inner, flags=re.S | re.I)
    return re.sub(r"\s+", "", html.unescape(inner))


def test_every_page_gives_the_text_of_its_article():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(pages) > 200
    for p in pages:
        assert re.sub(r"\s+", "", main_text(p["html"])) == plain(p["html"]), p["page_id"]
