"""Elements of pages as spans of their source."""

import pytest

from quorumlake.functions import zones


def test_spans_and_selectors():
    page = zones.Page('<div id=a><p>x<p>y</div><ul><li>1<li>2</ul><br>t<title>q</title>')
    found = [(x.tag, page.source(x), page.selector_of(x)) for x in page.all]
    assert found[:3] == [("div", "<div id=a><p>x<p>y</div>", "#a"), ("p", "<p>x", "#a > p:nth-of-type(1)"), ("p", "<p>y", "#a > p:nth-of-type(2)")]
    assert found[3:6] == [("ul", "<ul><li>1<li>2</ul>", "ul:nth-of-type(1)"), ("li", "<li>1", "ul:nth-of-type(1) > li:nth-of-type(1)"), ("li", "<li>2", "ul:nth-of-type(1) > li:nth-of-type(2)")]
    assert page.raw(page.root) == "xy12t"


@pytest.mark.parametrize(
    "selector, want",
    [("#m .x", "<b class='y x'>1</b>"), ("div > i", "<i>2</i>"), ("[role='main']", "<u role='main'>3</u>"), ("#m > b.y", "<b class='y x'>1</b>"), ("#q", None), ("", None), ("#a\\.b", "<s id='a.b'></s>")],
)
def test_find(selector, want):
    page = zones.Page("<div id='m'><b class='y x'>1</b><i>2</i></div><u role='main'>3</u><s id='a.b'></s>")
    x = page.find(selector)
    assert (page.source(x) if x else None) == want


@pytest.mark.parametrize("html", [None, "", "text", "</div></x>", "<a><b", "<!--", "<p" * 50, "<div>" * 2000 + "x", "<![CDATA[x]]>&amp;"])
def test_odd_pages(html):
    page = zones.Page(html)
    assert all(0 <= x.begin <= x.end <= len(html or "") for x in page.all)
    assert page.find("#nothing") is None


def test_null_rows(spark):
    from pyspark.sql import functions as F

    from quorumlake.operators import content

    docs = spark.createDataFrame([(1, None, None, None), (2, "", "", ""), (3, "<p>x</p>", None, "x"), (4, None, "<p>x</p>", "x")], "id int, html string, home string, needle string")
    rows = content.content_selectors(docs).select("id", "selector", content.content_text(F.col("html"), F.col("selector")).alias("text"), content.anchored_text(F.col("html"), F.lit("a")).alias("all")).orderBy("id").collect()
    assert [r.selector for r in rows] == [None] * 4
    assert [r.text for r in rows] == [None] * 4
    assert rows[2]["all"] == "x"
    assert content.content_selectors(docs.limit(0)).count() == 0
