import html
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="sidebar">A side bar that is long enough to count as running text here.</div>
<div class="post-12 entry-content"><p>Long text a < b and <a href=y>link</a> &amp; more to make it count.<p>Second   para<br>
line with enough text so that it counts as well.<ul><li>one<li>two</ul><form>Your name</form><div class="ads">Buy</div></div>
<div class="comments"><p>A reader comment that is long enough to count for something here, indeed it is.</p></div></div>
<footer>&copy; f</footer></body></html>"""


def test_page():
    assert H.best_path(PAGE).endswith("div.entry-content.post-")
    want = "Long text a < b and link & more to make it count.\nSecond para line with enough text so that it counts as well.\none\ntwo"
    assert H.main_text(PAGE) == want
    assert H.main_text(PAGE, ["no/such/path"]) == want


def test_odd_pages():
    for page, want in {None: "", "": "", "<a<b>": "", "plain text": "plain text", "</div></p><b>x": "x", "<script>x": "", "<p>&#x41;&nbsp;&lt;b&gt;</p>": "A <b>", "<div>" * 3000 + "deep": "deep", "<!-- a": "", "<p>a<!-- b --> c</p><hr>d": "a c\nd", "a < b > c <3 <": "a < b > c <3 <", "<p title='a>b'>x": "x", "<p title='a>b>x": "b>x", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<p>a <button>no</button>b": "a b"}.items():
        assert H.main_text(page) == want


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_hosts_vote(spark, clash, size):
    body = "<p>Running text that is long enough to count for this page, number {i}.</p>"
    rows = [(i, f"https://Host.example/{i}", f"<div class='x'><div class='story{i}'>{body.format(i=i)}</div></div>") for i in range(6)]
    # On this page alone the long list would win; its host knows better.
    rows.append((6, "https://host.example/6", "<div class='list'><p>" + "Another text that goes on for a very long time. " * 9 + "</p></div><div class='x'><div class='story6'><p>Short.</p></div></div>"))
    rows += [(7, None, rows[0][2]), (8, "no address", None), (None, None, None), (6, *rows[6][1:])]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    paths = {r.host: r.paths for r in H.host_paths(pages).collect()}
    assert paths["host.example"] == ["div.x/div.story", "div.list"]
    pages = pages.withColumn("text", F.lit("own"))
    out = H.extract_text(pages, broadcast_bytes=size)
    assert out.columns == [*(c for c in pages.columns if c != "html"), "_text"]
    got = sorted((r.page_id is None, r.page_id or 0, r["_text"]) for r in out.collect())
    want = [(False, i, f"Running text that is long enough to count for this page, number {i}.") for i in range(6)]
    want += [(False, 6, "Short."), (False, 6, "Short."), (False, 7, want[0][2]), (False, 8, ""), (True, 0, "")]
    assert got == sorted(want)
    assert H.extract_text(pages.limit(0)).collect() == []


def test_query_finds_the_articles(spark, sf_dir):
    truth = {}
    for i, page in duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        truth[i] = "\n".join(b for b in blocks if b)
    got = H.op3_html(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == truth
    assert all(r.n_chars == len(r.text) for r in got)


def test_names_that_only_sound_like_noise():
    words = "Words that run on for long enough to be the text of this page, and then some."
    for kept in ("notice-period", "share-price", "header-of-state"):
        assert H.main_text(f"<article><p>{words}</p><div class='{kept}'>{words}</div></article>") == f"{words}\n{words}"
    for out in ("notice", "site-notice", "cookie-law", "ad", "ad-top", "reader-comments", "share-buttons", "Sidebar left", "related-posts"):
        assert H.main_text(f"<article><p>{words}</p><div class='{out}'>{words}</div></article>") == words
    assert H.main_text(f"<body><header>Site</header><article><header><h1>Head</h1><p>Standfirst.</p></header><p>{words}</p></article>") == f"Head\nStandfirst.\n{words}"


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<a " * 350_000 + ">", "<a \"" * 250_000, "<a \"><" * 150_000, "<a title='" * 100_000 + ">", "<div>" * 200_000 + "deep", "<div class='x1'>" * 60_000 + "a running text that counts as such" + "</div>" * 60_000,
        "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "<table>" + "<tr><td>x" * 100_000, "<ul><li>" * 100_000, "<span>" * 100_000 + "<p>words of a paragraph that is text" * 1000, "<!--" * 250_000, "&" * 1_000_000, "<p>" * 300_000, "<script>" * 125_000,
    ],
)
def test_long_odd_pages_take_linear_time(page):
    began = time.process_time()
    H.main_text(page, ["no/such/path", H.best_path(page) or ""])
    assert time.process_time() - began < 12


WORDS = "Words that run on for long enough to be the text of this page, and then some."


@pytest.mark.parametrize("open_", ["<div class='cookie-recipe'>", "<section class='newsletter-history'>", "<p class='comments-on-policy'>", "<section id='search'>", "<div id='related'>", "<div class='user-feedback'>"])
def test_what_one_page_names_is_kept(open_):
    tag = open_[1:].split()[0]
    page = f"<body><article><p>{WORDS}</p>{open_}{WORDS}</{tag}></article></body>"
    assert H.main_text(page) == f"{WORDS}\n{WORDS}"


def test_an_anchor_outside_of_an_article_is_a_part_of_the_frame():
    assert H.main_text(f"<body><div class='x'><p>{WORDS}</p><div id='search'>Find {WORDS}</div></div></body>") == WORDS


def test_a_form_around_the_page():
    field = "<label>Name</label><input name=x>"
    for body in (f"<h1>Head</h1><p>{WORDS}</p>", f"<p>{WORDS}</p>" * 3, f"<article><p>{WORDS}</p></article>"):
        got = H.main_text(f"<body><form id='aspnetForm'>{field}<div class='post'>{body}</div></form></body>")
        assert WORDS in got and "Name" not in got
    assert H.main_text(f"<body><div class='post'><p>{WORDS}</p><form>{field}<p>Write to us</p></form></div></body>") == WORDS


def test_the_header_of_a_post():
    page = f"<body><header><h1>Site</h1></header><div class='post'><header><h1>Head</h1></header><p>{WORDS}</p></div></body>"
    assert H.main_text(page, ["body/div.post"]) == f"Head\n{WORDS}"
    assert H.main_text(f"<body><div class='post'><header class='site-header'>Site</header><p>{WORDS}</p></div></body>", ["body/div.post"]) == WORDS


def test_a_host_tells_its_template_from_what_one_page_has(spark):
    body = lambda i, more: f"<body><div class='story'><p>{WORDS} {i}</p>{more}</div></body>"
    comments = "<div class='user-feedback'><p>A reader says that number {i} is rather long for a page like this.</p></div>"
    rows = [(i, f"https://a.example/{i}", body(i, comments.format(i=i))) for i in range(10)]
    rows += [(10, "https://a.example/10", body(10, f"<div class='cookie-recipe'>{WORDS}</div>")), (11, "https://b.example/", body(11, comments.format(i=11)))]
    out = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"{WORDS} {i}" for i in range(10))
    assert out[10] == f"{WORDS} 10\n{WORDS}"
    assert "A reader says" in out[11]  # one page tells nothing about its host
