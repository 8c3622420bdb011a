"""Index runs, rewriting, titles and numbering against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import chunk, statutes, titles
from quorumlake.operators import indexing, ordinances, rewrite, upkeep, versions
from quorumlake.providers import models
from quorumlake.sources import store


@pytest.fixture(scope="module")
def values(spark):
    return lambda column, rows, names: [r[0] for r in spark.createDataFrame(rows, names).select(column).collect()]


def test_titles(values):
    pages = [
        ("<title> A &amp; B&nbsp;&#167;&#xA7;1 &mdash; <b>x</b></title><h1>no</h1>",), ("<title> \n</title><meta content='Og' property='og:title'><h1>no</h1>",), ('<meta name="twitter:title" content="T&#39;s"><h1>no</h1>',),
        ("<script>var x = '<title>no</title>'</script><!-- <title>no</title> --><h1 class=a>One <i>two</i></h1>",), ("<h2>Two</h2>",), ("<p>none</p>",), (None,), ("<title>" + "ab " * 200 + "</title>",), ("<title>&#128512; &#x1F600;é&#99999999;&#0;</title>",),
    ]
    assert values(titles.html_title(F.col("h")), pages, "h string") == ["A & B §§1 — x", "Og", "T's", "One two", "Two", None, None, ("ab " * 200)[:300], "😀 😀é&#99999999;&#0;"]
    urls = [("https://a.org/x/some_page-two.html?q",), ("https://www.a-b.org/",), ("no url",), ("https://a.org/été-x/",)]
    assert values(titles.slug_title(F.col("u")), urls, "u string") == ["Some Page Two.Html", "Www.A B.Org", "", "éTé X"]
    rows = [("<h1>cached</h1>", "<h1>given</h1>", "own", "https://a/b"), (None, "<h1>given</h1>", "own", "https://a/b"), ("<p>", "", " own ", "https://a/b"), (None, None, "https://a/b", "https://a/b"), (None, None, None, "https://a/b")]
    assert values(titles.document_title(*map(F.col, "cgou")), rows, "c string, g string, o string, u string") == ["cached", "given", "own", "B", "B"]


def test_titles_of_statutes_with_elements_inside(values):
    inner = lambda x: (f"<i>x</i><span class='a titleNumber'>§ 1-2</span><span class=\"titleTitle\">{x}</span> tail <span>z</span>",)
    pages = [inner("A <span>b</span> c"), inner("<SPAN>A</SPAN><span> <span>b</span></span>&#xA7; c."), inner("plain"), ("<div class='titleNumber'>§ 3</div><div class='titleTitle'>never <div>closed",), ("<p>none</p>",), ("<b class='titleNumber'></b><b class='titleTitle'></b>",)]
    got = values(statutes.number_and_title(F.col("h")), pages, "h string")
    assert [(r.number, r.title) for r in got] == [("§ 1-2", "A b c"), ("§ 1-2", "A b§ c"), ("§ 1-2", "plain"), ("§ 3", "never closed"), (None, None), (None, None)]


def test_texts_without_templates():
    page = "<header><p>top<header>in</header></p></header><p>one</p><div role='banner'><div>no</div>no</div><ul><li>two</ul><footer><p>end</footer><p>three</p>"
    assert rewrite.text_without(page, ["header", "footer"]) == "one\n\n- two\n\nthree"
    assert rewrite.text_without(page, ["[role='banner']"]) == "top\n\none\n\n- two\n\nend\n\nthree"
    assert rewrite.text_without("<div class='x site-header y'><p>no</p></div><p>a</p>", [".site-header"]) == "a"
    assert rewrite.text_without("<p>a</p><div id=footer><br><p>never closed", ["#footer"]) == "a"
    assert rewrite.text_without(None, ["header"]) == "" == rewrite.text_without("", [])


def test_rewriting_by_votes(spark):
    page = lambda i, body, foot: (i, f"https://h{i % 2}.org/{i}", f"<header>h</header><p>{body}</p>{foot}")
    pages = [page(i, f"text {i}", "<footer>f</footer>" if i < 3 else "<div id='footer'>f</div>") for i in range(6)] + [(9, "https://alone.org/", "<header>h</header><p>x</p>"), (10, "https://alone.org/2", None)]
    stored = [(0, "# https://h0.org/0 downloaded at d, converted at c\n\ntext 0"), (1, "old")]
    rows = rewrite.rewritten(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(stored, "page_id long, body string"), F.lit("d"), F.lit("c"))
    got = {r.page_id: r for r in rows.collect()}
    # of host 0 the pages 0 and 2 vote for footer, 4 for #footer; of host 1 only 3 and 5 agree
    assert {i: (r.header, r.footer) for i, r in got.items()} == {0: ("header", "footer"), 2: ("header", "footer"), 4: ("header", "footer"), 1: ("header", "#footer"), 3: ("header", "#footer"), 5: ("header", "#footer"), 9: (None, None), 10: (None, None)}
    text = {i: r.body.split("\n\n", 1)[1] for i, r in got.items()}
    assert text[0] == "text 0" and text[3] == "text 3" and text[10] == "" and not got[0].changed and got[1].changed and got[2].old_bytes is None
    report = {r.host: r for r in rewrite.rewrite_report(rows).collect()}
    assert (report["h0.org"].n_pages, report["h0.org"].n_changed, report["h0.org"].n_templates, report["alone.org"].n_templates) == (3, 2, 3, 0)


def test_index_run(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + "." * (rng.random() < 0.1) for _ in range(n))
    downloads = [(1, f"f{i}", ["x"] if i else [], text(700)) for i in range(6)] + [(2, "g", ["x"], None)]
    history = [(1, None, f"d/f{i}", f"https://{i}", "2024-01-01 00:00:00" if i != 2 else "2020-01-01 00:00:00", "PDF" if i == 3 else "HTML", i) for i in range(6)]
    embed = models.provider("hashed-64")
    run = indexing.index_run(
        spark.createDataFrame(downloads, "entity_id long, file string, domain_ids array<string>, content string"), spark.createDataFrame(history, "entity_id long, text_file string, file string, url string, ts string, file_type string, position long"),
        spark.createDataFrame([("1-shared/f4",)], "document string"), embed, f"file://{tmp_path}/run", F.lit("2024-01-02 00:00:00"), 48, 500,
    )
    assert {r.file: r.decision for r in run.decisions().collect()} == {"f0": "no domain", "f1": "index", "f2": "old", "f3": "pdf", "f4": "indexed", "f5": "index", "g": "index"}
    wanted = {f"1-shared/f{i}-{n}": c for i in (1, 5) for n, c in enumerate(chunk.chunks_of(downloads[i][3], 500))}
    assert {r.chunk_id: r.content for r in run.chunks().collect()} == wanted and len(wanted) > 8
    assert {r.url for r in run.chunks().collect()} == {"https://1", "https://5"} and run.index().size() == len(wanted)
    found = run.search(spark.createDataFrame(list(wanted.items()), "query_id string, content string"), embed, 1).collect()
    assert {r.query_id for r in found if r.score >= 0.999999} == set(wanted)


def test_numbers_over_all_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i * 7919 % 500, i) for i in range(500)], "k long, v long").repartition(7)
    got = upkeep.numbered_everywhere(rows, [F.desc("k")], f"file://{tmp_path}/n").collect()
    assert {(r.k, r.n) for r in got} == {(k, 500 - k) for k in range(500)} and len(got) == 500
    plan = upkeep.numbered_everywhere(rows, [F.desc("k")], f"file://{tmp_path}/m")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_orders_that_are_mended(spark):
    stored = spark.createDataFrame([(1, "x", [1, 2, 3]), (2, "x", [3, 1]), (3, "x", []), (4, "x", [1, 9]), (5, "y", [1])], "entity_id long, domain_id string, question_ids array<int>")
    asked = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 3, 3)], "domain_id string, question_id int, position int")
    assert {(r.entity_id, tuple(r.question_ids)) for r in versions.reordered(stored, asked).collect()} == {(2, (1, 3)), (4, (1,)), (5, ())}


def test_places_as_a_search_finds_them(spark):
    rows = [(1, "ny", "c", "Town of Bay", "k", "h", "park", True), (2, "New York", "c", "bayville", "k", "h", "park", True), (3, "NJ", "c", "Bay", "k", "h", "park", True), (4, "NY", "c", None, "k", "h", "park", True), (5, "NY", "c", "Bay", "k", "h", "other", True)]
    laws = spark.createDataFrame(rows, "doc_id long, state string, county string, city string, source_jurisdiction_type string, header string, content string, is_substantive boolean")
    people = [(1, "New York", "BAY"), (2, "nj", "bay"), (3, "NY", "nowhere"), (4, "NY", ""), (5, "NY", "ville")]
    got = {r.entity_id: r.n for r in ordinances.counts_for_entities(spark.createDataFrame(people, "entity_id long, state string, city string"), laws, ordinances.Search(words=("park",))).collect()}
    assert got == {i: ordinances.count(laws, ordinances.Search(state=s, city=c, words=("park",))).first().n if c else 0 for i, s, c in people} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 1}


def test_broken_documents_are_missing(spark):
    docs = spark.createDataFrame([("a", '{"x": 1}'), ("b", " \n"), ("c", "{"), ("d", None), ("e", '{"x": "no"}'), ("f", "[]"), ("g", '{"y": 2}')], "id string, content string")
    assert {(r.id, r.doc.x) for r in store.parsed(docs, "x int").collect()} >= {("a", 1), ("g", None)}
    assert not {"b", "c", "d", "e"} & {r.id for r in store.parsed(docs, "x int").collect()}
