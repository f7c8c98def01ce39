"""Main text of pages, on the test table, on pages of other makes and on damaged ones."""

import re
import time
from html import unescape

import pytest
from pyspark.sql import types as T

from dugout.llm import queries
from dugout.llm.main_text import extract_main_text, main_text
from tests.conftest import SF

LONG = "The river runs under the old stone bridge and past the mill, where it slows down before the town. " * 4
PARTS = [LONG.strip(), "It was quiet, all in all.", LONG.strip() + " Then it turns.", "A last line about the water."]
ARTICLE = "\n\n".join(["A title", *PARTS])
BODY = "".join(f"<p>{p}</p>" for p in PARTS)


def test_every_page_of_the_test_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op11_main_text(spark, SF).collect()
    assert len(found) == len(pages) > 0
    for r in found:
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        parts = re.split("</?(?:h1|p)>", inner.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        blocks = [" ".join(unescape(p).split()) for p in parts]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


MADE = {
    "plain": f"<html><body><h1>A title</h1>{BODY}</body></html>",
    "no end tags": "<h1>A title</h1>" + "".join(f"<p>{p}" for p in PARTS),
    "sections": f"<div id=page><div class=site-header><a href=/>Home</a> My site</div><div class=content><h1>A title</h1>"
                f"<div class=text>{BODY}</div></div><div class='sidebar-right'>{LONG}</div></div>",
    "nested blocks": "<main><article><header><h1>A title</h1></header><section><p>" + PARTS[0] + "</p><p>" + PARTS[1] +
                     "</p></section><section><p>" + PARTS[2] + "</p><p>" + PARTS[3] + "</p></section></article></main>",
    "two divs": f"<div><h1>A title</h1></div><div><p>{PARTS[0]}</p><p>{PARTS[1]}</p><p>{PARTS[2]}</p><p>{PARTS[3]}</p></div>",
    "around": f"<header><h1>Site</h1><ul><li><a href=/a>{LONG}</a></ul></header><nav>{LONG}</nav><aside>{LONG}</aside>"
              f"<div class='cookie-notice'><p>{LONG}</p></div><form><p>{LONG}</p><input></form><article><h1>A title</h1>{BODY}"
              f"<div class='ad'>{LONG}</div><footer>{LONG}</footer></article><section id=comments><p>{LONG}</p><p>{LONG}</p>"
              f"</section><div class='advert top'>{LONG}</div><footer><p>{LONG}</p></footer><script>p('{LONG}')</script>",
    "reader comments": f"<article><h1>A title</h1>{BODY}<div class='comment-list'><article class=comment><p>{LONG}</p>"
                       f"</article></div></article><div id=disqus_thread><p>{LONG}</p></div>",
    "list of links": f"<div><h1>A title</h1>{BODY}</div><div>" + "".join(
        f"<p><a href=/{k}>Read on about stones, rivers and the people of the town number {k}</a></p>" for k in range(60)) + "</div>",
    "raw text": f"<style>p>a{{}}</style><textarea><p>{LONG}</textarea><script>if (a<b) x='</p>'</script><!-- <p>{LONG}</p> -->"
                f"<article><h1>A title</h1>{BODY}</article><noscript><p>{LONG}</p></noscript>",
    "hidden": f"<article><h1>A title</h1>{BODY}<p hidden>{LONG}</p><div style='display: none'>{LONG}</div>"
              f"<div aria-hidden=true>{LONG}</div><ul role=navigation><li>{LONG}</ul></article>",
    "form around all": f"<form id=aspnetForm><div class=menu>{LONG}</div><h1>A title</h1>{BODY}</form>",
}


@pytest.mark.parametrize("name", MADE)
def test_articles_of_other_makes(name):
    assert main_text(MADE[name]) == ARTICLE


def test_blocks_white_space_and_references():
    page = ("<article><p>one\n two&nbsp;&amp;&lt;b&gt; &#233;&#x1F389; &am &copy 3<br>line <b>bo</b>ld<i>,</i> 1 < 2</p>"
            "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre> e\n  f</pre>tail <!-- x -->end</article>")
    assert main_text(page) == "one two &<b> é🎉 &am © 3 line bold, 1 < 2\n\na\n\nb\n\nc\n\nd\n\ne f\n\ntail end"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("  \n", ""), ("word", "word"), ("<p", ""), ("<!-- a", ""), ("<script>x", ""), ("</p></div>", ""),
    ("<nav>a</nav>", ""), ("<p>a</b></i></p>b", "a\n\nb"), ("<title>t</title>x", "x"), ("<a href='x'>only</a>", "only"),
    ("<p class=\"a>b</p>", "b"), ("<![CDATA[x]]>y", "y"), ("<html><head><body>z", "z"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part,tail", [
    ("<div>", "x"), ("<p>", "x"), ("<b>", "x"), ("<", "x"), ("<a b='", ""), ("</div>", "x"), ("<!--", ""), ('<x ="', ""),
    ("<td><table><b></td>", "x"), ("&", ""), ("<li><ul>", "x"), ("<!", ""), ("<script>", ""),
])
def test_time_grows_with_the_page(part, tail):
    start = time.process_time()
    main_text(part * 60_000 + tail)
    assert time.process_time() - start < 15


def test_tables_with_nulls_repeated_rows_and_more_columns(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("text", T.StringType()),
        ("n_chars", T.StringType()))])
    rows = [(1, None, "<p>a</p>", "q", "z"), (1, None, "<p>a</p>", "q", "z"), (None, "u", None, None, None),
            (2, "v", "<article>" + "<p>word</p>" * 50_000, None, None), (3, "w", "", "q", None)]
    df = spark.createDataFrame(rows, schema)
    got = extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got.collect())
    assert found == [(0, "u", 0), (1, "", 1), (1, "", 1), (2, "v", 6 * 50_000 - 2), (3, "w", 0)]
    assert extract_main_text(df.limit(0)).count() == 0
