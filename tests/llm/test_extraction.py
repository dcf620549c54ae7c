import html as entities
import re

import pytest
from conftest import SMALL, as_dicts

from hearthline.llm import entry, extraction

PROSE = "The rivers ran high that spring, and the mills along the bank stood idle for a month while men carried sand."


def text(page):
    return " ".join(extraction.main_lines(page))


def by_template(page):
    """The tables' pages by their template: all blocks of the article, by patterns, with cut-off ends."""
    body = page.partition("<article>")[2].partition("</article>")[0]
    body = re.sub(r"<[^<>]*\Z", "", body)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body))
    blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.1"])
def test_query_equals_the_template(spark, sf):
    rows = as_dicts(entry.op12_html_extraction(spark, sf))
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == by_template(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_boilerplate_goes_and_short_lines_stay():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="with-sidebar"><header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div>
    <nav><a href=/>Home</a></nav><main><article><header><h1>Title&nbsp;of it</h1></header><p>{PROSE}</p><p>So.</p><form><label>Mail</label><input></form>
    <div class="advert">Buy now</div><ul><li>One</li><li>Two</ul><script>var a = "<p>no</p>";</script><table><tr><td>a<td>b</table><p>caf&eacute; &lt;b&gt; x<sub>2</sub></p></article>
    <section id="comments"><h3>Comments</h3><article><p>{PROSE} I think so too.</p></article></section></main><aside><p>{PROSE}</p></aside><footer>&copy; us</footer></body></html>"""
    assert text(page) == f"Title of it {PROSE} So. One Two a b café <b> x2"


def test_pages_without_article_elements():
    links = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(8))
    page = f"<body><div><ul>{links}</ul></div><div id=content><h1>Head</h1><p>{PROSE}<p>Be.<p>{PROSE}</div><div><p><a href=/x>{PROSE[:20]}</a></p></div></body>"
    assert text(page) == f"Head {PROSE} Be. {PROSE}"
    assert text(f"<p>{PROSE}") == PROSE and text(PROSE) == PROSE and text("<p>a<p>b") == "a b"


def test_wrappers_and_cut_offs():
    assert text(f"<div class='page has-ads sidebar-left'><article><p>{PROSE}</p></article></div>") == PROSE
    assert text(f"<article><p>{PROSE} a &amp; b &am") == f"{PROSE} a & b &am"
    for end in ("<", "</", "</p", "<a href='x", "<!-- gone <p>x</p>", "<!-", "<script>x", "<style>p"):
        assert text(f"<article><p>{PROSE}{end}") == PROSE
    assert text("<article><p>1 < 2 and <![odd[ x ]]> 3 <? php ?></p><p hidden>no</p><p style='display: none'>no</p></article>") == "1 < 2 and 3"


def test_ratios_are_smoothed():
    lines = [extraction.Line((0,), 0, "x" * n, 1, 0) for n in (3, 2, 3, 2, 300, 4, 400, 350, 2, 3, 2, 3)]
    content = extraction.content_cluster(lines).tolist()
    assert content[4:8] == [True] * 4 and not content[0] and not content[-1]
    assert extraction.content_cluster(lines[:1]).tolist() == [True]


def test_nulls_repeats_long_pages_and_clashes(spark):
    long_page = "<article>" + "<p>word and word</p>" * 50_000
    rows = [(1, None, None, 0), (2, "u", "", 0), (None, "u", "<article><p>a</p></article>", 0), (4, "u", "<nav>menu</nav>", 0), (4, "u", "<nav>menu</nav>", 0), (5, "u", long_page, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"][:3], r["n_chars"]) for r in as_dicts(extraction.extract_pages(pages)))
    assert got == [("1", "None", "", 0), ("2", "u", "", 0), ("4", "u", "", 0), ("4", "u", "", 0), ("5", "u", "wor", 50_000 * 14 - 1), ("None", "u", "a", 1)]
    assert extraction.extract_pages(pages.limit(0)).count() == 0
    assert extraction.extract_pages(pages.where("page_id = 5"), keep=("page_id",), with_lines=True).selectExpr("size(lines)").first()[0] == 50_000
