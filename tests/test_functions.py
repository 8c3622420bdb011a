"""Functions and operators on small made-up inputs."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlake.functions import chunk, html, numbers, text, urls
from quorumlake.operators import history, pages, scoring, sources, vectors, versions
from quorumlake.streaming import incremental


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_mock_realm_scores(spark):
    given_ = {("E1", "D1"): (0.8, 0.6, 0.7), ("E2", "D1"): (0.5, 0.9, 0.4), ("E1", "D2"): (0.3, 0.7, 0.6), ("E2", "D2"): (0.9, 0.2, 0.8)}
    answers = spark.createDataFrame([(e, d, i + 1, s, 0.9, "x") for (e, d), ss in given_.items() for i, s in enumerate(ss)], "entity_id string, domain_id string, question_id int, score double, confidence double, answer string")
    questions = spark.createDataFrame([("D2", i, 1) for i in (1, 2, 3)], "domain_id string, question_id int, weight int")
    scores = {(r.entity_id, r.domain_id): round(r.score, 4) for r in scoring.entity_scores(answers, questions).collect()}
    assert scores == {("E1", "D1"): 0.7, ("E2", "D1"): 0.6, ("E1", "D2"): 0.5333, ("E2", "D2"): 0.6333}
    analyses = answers.select("entity_id", "domain_id").distinct()
    overall = {(r.entity_id, r.domain_id): r.overall for r in scoring.detailed_scores(analyses, questions, answers).collect()}
    assert overall == {("E1", "D2"): 5.3, ("E2", "D2"): 6.3}


def test_url_forms(spark):
    assert values(spark, urls.normalized, [" a.org ", "", None, "HTTP://x"]) == ["https://a.org", None, None, "HTTP://x"]
    assert values(spark, urls.match_form, ["https://A.org/x/?q=1#t", "a.org", "http://a.org/x/y//"]) == ["https://a.org/x", "https://a.org/", "http://a.org/x/y"]
    assert values(spark, urls.source_form, ["https://a.org/x/#t", "https://a.org/?q=1"]) == ["https://a.org/x", "https://a.org/?q=1"]
    assert values(spark, urls.hostname, ["https://A.b.ORG:80/x", None, "none"]) == ["a.b.org", "", ""]
    assert values(spark, urls.slug, ["Café au Lait!", "", None]) == ["cafe-au-lait", "source", "source"]
    assert values(spark, urls.title_of_slug, ["tree-care_rules McX"]) == ["Tree Care Rules McX"]


def test_names_and_references(spark):
    assert values(spark, text.name_part, ["Dobbs Ferry (Village)", "Mount Kisco (Town/Village)", " "]) == ["DobbsFerry-Village", "MountKisco-Town", None]
    told = "See Section 12.1 and § 12.1, then Section 4-2 of Section 9"
    assert values(spark, text.section_references, [told, "none"]) == [["Section 12.1", "§ 12.1", "Section 4-2"], []]


def test_numbers(spark):
    assert values(spark, numbers.threshold, ["20%", "20", "0.2", "x"]) == [0.2, 0.2, 0.2, None]
    assert values(spark, lambda x: numbers.colour_of(x, [(">=7", "green"), ("05-2", "#123"), ("-1-3", "red")]), [7.0, 1.0, 0.1, None], "double") == ["#22c55e", "#123", None, None]
    assert values(spark, numbers.green_hex, [0.0, 1.0, 2.0], "double") == ["#bbf7d0", "#22c55e", "#22c55e"]
    assert values(spark, lambda x: numbers.half_up(x), [0.5, -0.5, 1.49], "double") == [1.0, 0.0, 1.0]


def test_html_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><script>x</script><p>One<br>two<p>Three<ul><li>a <b>b</b><li>c</ul><blockquote><p>in</p></blockquote></body></html>"
    assert html.text_of(page) == "Head\n\nOnetwo\n\nThree\n\n- a b\n\n- c\n\nin\n\nin"
    assert html.text_of("just <b>bold</b> &amp; plain") == "just bold & plain"
    assert html.text_of(None) == html.text_of("") == ""


def test_normal_text(spark):
    assert values(spark, html.normal_text, ["a  b\n\n\n\nHome\nfooBar rest of a line that is long enough to be content of a page"]) == ["a b\n\nfoo Bar rest of a line that is long enough to be content of a page"]
    assert values(spark, html.normal_text, ["Home\nMenu\nshort"]) == ["Home\nMenu\nshort"]


def test_pages_of_index(spark):
    nav = " ".join(["Quick Links Departments Government"] * 20)
    assert values(spark, text.dense_index, [nav, "some plain words " * 40]) == [True, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Longer.", "§ 12", "Section 4", "1,200", "end.\n", "stop.\n\n", "é"]), max_size=400), st.integers(40, 400))
def test_chunks_keep_words(parts, most):
    whole = " ".join(parts)
    found = chunk.chunks_of(whole, most)
    assert "".join("".join(found).replace(".", "").split()) == "".join(whole.replace(".", "").split())
    assert all(chunk.tokens(c) <= chunk.MOST_TOKENS for c in found)


def test_chunks_of_little():
    assert chunk.chunks_of(None, 100) == chunk.chunks_of("", 100) == []
    assert chunk.chunks_of("short", 100) == ["short"]


def test_snippet(spark):
    told = "x" * 300 + " tree " + "y" * 400
    assert values(spark, lambda x: text.snippet(x, ["tree"]), [told, "tree"]) == ["..." + told[151:555] + "...", "tree"]


def test_sources(spark):
    df = spark.sql("SELECT array(named_struct('source_url','https://a.org/x/','title','A','type','code'), named_struct('source_url','https://b.org','title','B','type','ordinance')) s")
    new = F.struct(F.lit("https://a.org/x#y").alias("source_url"), F.lit("N").alias("title"), F.lit("form").alias("type"))
    other = F.struct(F.lit("https://c.org").alias("source_url"), F.lit("N").alias("title"), F.lit("form").alias("type"))
    row = df.select(sources.primary_source(F.col("s"), "statute")["title"].alias("p"), sources.upserted(F.col("s"), new)["title"].alias("u"), sources.upserted(F.col("s"), other)["title"].alias("v")).first()
    assert (row.p, row.u, row.v) == ("B", ["N", "B"], ["N", "A", "B"])


def test_history_status(spark):
    assert values(spark, history.normal_status, ["good", "irrelevant", "good-index", "404", "odd", None]) == ["related", "unrelated", "index", "404", "no-content", "no-content"]
    assert values(spark, history.error_status, ["HTTP 404", "403 Forbidden", "request timed out", "odd"]) == ["404", "blocked", "timeout", "no-content"]


def test_ancestors(spark):
    assert values(spark, history.ancestors, ["https://a.org/x/y"]) == [["https://a.org/", "https://a.org/x", "https://a.org/x/y"]]


def test_boards_score(spark):
    body = F.lit("the Conservation Advisory-Council met")
    score = pages.boards_score(F.lit("https://a"), F.col("x"), F.lit(""), body, "Conservation Advisory Council")
    assert values(spark, lambda _: score, ["Conservation / Advisory Council", "Parking"]) == [4.5, 1.5]
    assert values(spark, lambda _: pages.boards_score(F.lit(""), F.col("x"), F.lit(""), body, "Planning Board"), ["x"]) == [0.0]


def test_nearest_takes_many_queries(spark):
    chunks = spark.createDataFrame([("a", [1.0]), ("b", [-1.0])], "chunk_id string, vector array<double>")
    found = vectors.nearest(spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vector")), chunks, 1)
    assert found.where("chunk_id = 'a' AND score = 1 AND rank = 1").count() == 10_001


def test_question_actions(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "q int, wording string")
    old = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "q int, wording string")
    assert {r.q: r.action for r in versions.compare(new, old, ["q"]).collect()} == {1: "analyze", 2: "keep", 3: "analyze", 4: "remove"}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    start = dt.datetime(2026, 1, 1)
    for i, hours in enumerate((0, 100, 300)):
        rows = [(1, "a", start + dt.timedelta(hours=hours))] if i != 1 else [(1, "b", start + dt.timedelta(hours=hours))]
        spark.createDataFrame(rows, "entity_id long, url string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("entity_id long, url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    due = incremental.run_available(incremental.due_recrawls(stream, 3), "append", str(tmp_path / "out"), str(tmp_path / "log"))
    assert {r.url for r in due.collect()} <= {"a", "b"} and due.count() >= 1
    target = str(tmp_path / "chunks")
    write = incremental.upsert_chunks(target, "k")
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    write(spark.createDataFrame([("b", 2)], "k string, v int"), 1)
    write(spark.createDataFrame([("b", 2)], "k string, v int"), 1)
    assert {r.k: r.v for r in incremental.read_upserted(spark, target, "k").collect()} == {"a": 1, "b": 2}
