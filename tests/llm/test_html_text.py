"""Page texts: templates found by recurrence, rules, references, broken markup, and whole tables against a plain pattern."""

import html
import re

import duckdb
import pytest
from loamline.llm import html_text

SCHEMA = "page_id long, url string, html string, text int, lang string"
SF = "/root/testdata/sf0.001"


def texts(spark, rows):
    found = html_text.extract(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA))
    assert found.columns == ["page_id", "url", "html", "lang", "text", "n_chars", "n_template"]
    return [(r.page_id, r.text) for r in found.collect() if r.n_chars == len(r.text)]


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_templates_without_names_recur(spark):
    """Menus and notices that no name tells are deleted on hosts with many pages; prose that recurs stays."""
    body = "<div class='c1'><span>Home</span> <span>Shop</span></div><div id='x'><h2>Story {n}</h2><p>One {n} two.</p><p>Same passage.</p><div class='q'>Mind the gap.</div></div><div class='c9'>Terms of use</div>"
    rows = [(i, f"http://a.example/{i}", page(body.format(n=i))) for i in range(6)] + [(9, "http://b.example/", page(body.format(n=9)))]
    got = dict(texts(spark, rows))
    assert got[3] == "Story 3 One 3 two. Same passage."
    assert got[9] == "Home Shop Story 9 One 9 two. Same passage. Mind the gap. Terms of use"


def test_copies_are_no_templates(spark):
    same = page("<article><h1>A</h1><ul><li>one</li><li>two</li></ul><p>b</p></article>")
    assert {t for _, t in texts(spark, [(i, "http://a.example/", same) for i in range(20)])} == {"A one two b"}
    other = [(i, "http://a.example/", page(f"<article><p>{i}</p><ul><li>follow</li><li>us</li></ul></article>")) for i in range(20)]
    assert sorted(t for _, t in texts(spark, other)) == sorted(map(str, range(20)))


def test_rules_and_references(spark):
    parts = """<header>Site</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><div class="page has-sidebar"><main><article class="post no-ads">
    <header><h1>Title &amp; more</h1></header><p>A&nbsp;b <i>c</i>d&eacute;&#233;&#x41;<br>e &lt;tag&gt; &am</p><script>var x = "</p><p>no";</script><style>p{}</style><!-- <p>no</p> -->
    <div class="adBox ad">Buy</div><form><input value="x"><label>Mail</label></form><aside>Side</aside><section id="comments"><article class="comment"><p>First!</p></article></section>
    <table><tr><td>x<td>y</table></article></main><div role="complementary">Right</div></div><footer>&copy;</footer>"""
    assert texts(spark, [(1, None, page(parts))]) == [(1, "Title & more A b cdééA e <tag> &am x y")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p><div></div>", ""),
        ("plain  text & more", "plain text & more"),
        ("<p>one<p>two<li>three", "one two three"),
        ("<p><b>one<br><p>two</b> three", "one two three"),
        ("<article><p>cut off <a href='", "cut off"),
        ("<article><p>a < b <3 c</p></article>", "a < b <3 c"),
        ('<article><p title="a > b">x</p><p class=ad>y</p></article>', "x"),
        ("<article>a</article>x<article>b</article>", "a b"),
        ("<script>never ends <p>x", ""),
        ("<form><article>in a form</article></form>", "in a form"),
    ],
)
def test_broken_pages(spark, raw, want):
    assert html_text.Parsed("http://x/", raw).text(lambda key: 0)[0] == want


def test_edges(spark):
    long = page("<article>" + "".join(f"<p>word {i}</p>" for i in range(200_000)) + "</article>")
    deep = page("<article>" + "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "</article>")
    rows = [(None, "http://x/", long), (1, None, deep), (1, None, deep), (2, "no address", None)]
    got = texts(spark, rows)
    assert sorted(((str(i), len(t)) for i, t in got)) == [("1", 4), ("1", 4), ("2", 0), ("None", 2_288_889)]
    assert texts(spark, []) == []
    assert html_text.host_of("HTTP://u:p@A.Example:80/x") == "a.example" and html_text.host_of(None) == html_text.host_of("x/y") == ""


def test_counts_and_files(spark, monkeypatch):
    monkeypatch.setattr(html_text, "FILE_KEYS", 3)
    counts = spark.createDataFrame([(k * k * (-1) ** k, k) for k in range(40)], "key long, n long")
    paths = html_text.write_counts(counts, html_text.shared_dir(spark, "t"))
    assert len(paths) == 14
    found = html_text.Counts(paths).of({k * k * (-1) ** k for k in range(45)} | {5, -7})
    assert found == {k * k * (-1) ** k: k for k in range(40)}


def test_query_against_plain_pattern(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    plain = lambda h: " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1]))).split())
    want = sorted((i, u, plain(h), len(plain(h))) for i, u, h in rows)
    assert sorted(tuple(r)[:4] for r in html_text.op12_html_text(spark, SF).collect()) == want
