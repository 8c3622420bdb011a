"""Nulls, empty and repeated rows, empty tables and clashing names for every operator."""

import pytest
from pyspark.sql import functions as F

from quorumlake.llm import chat, decontaminate, fingerprint, language, line_dedup, mixing, near_dedup, substring_dedup, token_count, url_filter
from quorumlake.llm.shared import word_count

SCHEMA = "doc_id long, text string, lang string, source string"
PLAIN = "one two three four five six seven eight"
ROWS = [(1, PLAIN, "en", "a"), (2, None, None, None), (3, "", "de", "a"), (None, PLAIN, "en", "b"), (1, PLAIN, "en", "a"), (4, "  \t\n ", "en", "b"), (5, "ends with\n" + PLAIN, "de", "b"), (6, "123 456", None, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_mix(docs, none):
    out = mixing.mix(docs, word_count(F.col("text"))).collect()
    assert len(out) == len(ROWS) and all(r.copies <= 3 and r.taken == r.copies * r.size for r in out)
    assert mixing.mix(none, word_count(F.col("text"))).count() == 0
    assert [r.target for r in out if r.source is None] == [0.0]


def test_fingerprints(docs, none):
    out = fingerprint.fingerprints(docs.withColumn("fingerprint", F.lit(1))).collect()
    assert len(out) == len(ROWS) and [len(r.fingerprint) for r in out if not r.text] == [0, 0]
    both = fingerprint.with_neighbour(docs).collect()
    assert len(both) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in both)
    assert fingerprint.with_neighbour(none).count() == 0
    alone = fingerprint.with_neighbour(docs.where("doc_id = 5")).first()
    text = ROWS[6][1]
    third = len(text) // 3
    assert alone.edited == text[: len(text) - third] + text[:third] and alone.near_next == 1


def test_lines(spark, docs, none):
    out = line_dedup.dedup_lines(docs.withColumn("kept", F.lit("x")).withColumn("key", F.lit("y")))
    rows = {(r.doc_id, r.n_lines, r.n_dropped, r.kept, r.key) for r in out.collect()}
    assert rows == {(1, 1, 0, PLAIN, "y"), (2, 1, 0, "", "y"), (3, 1, 0, "", "y"), (None, 1, 1, "", "y"), (4, 2, 0, "  \t\n ", "y"), (5, 2, 1, "ends with", "y"), (6, 1, 0, "123 456", "y")}
    assert out.count() == len(ROWS)
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(5):
        batch = spark.createDataFrame([(bytes([i]), i), (b"all", i)], "key binary, doc long")
        lost = {(bytes(r.key), r.doc) for r in runs.losers(batch).collect()}
        assert lost == ({(b"all", i)} if i else set())
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.seen().count() == 6


def test_language(spark, docs, none):
    out = {(r.doc_id, r.text): r for r in language.identify(docs.withColumn("score", F.lit("x"))).collect()}
    assert all(r.lang_pred == "und" and r.score == 0 for (_, t), r in out.items() if not (t or "").strip() or t == "123 456")
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(1, "FOUR five"), (2, None), (3, "...")], "item_id long, text string")
    out = decontaminate.find_contamination(docs, items).collect()
    hit = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out}
    assert len(out) == len(ROWS) and hit == {(1, 8, 2, 1, True), (None, 8, 2, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 10, 2, 1, True), (6, 2, 0, 0, False)}
    assert decontaminate.find_contamination(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.find_contamination(docs, items.limit(0)).collect()} == {0}


def test_tokens(docs, none):
    out = token_count.count_tokens(docs.withColumn("n_tokens", F.lit("x")), model())
    assert {(r.n_bytes, r.n_tokens) for r in out.collect() if r.doc_id in (2, 3)} == {(0, 0)} and out.count() == len(ROWS)
    assert token_count.count_tokens(none, model()).count() == 0


def test_near(docs, none):
    out = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out) == [(0, 4, 1, False), (1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 6, 5, True), (6, 1, 6, True)]
    assert near_dedup.near_duplicates(none).count() == 0


def test_substrings(docs, none):
    out = substring_dedup.dedup_substrings(docs, window=6).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in out) == [(0, 8, 8, ""), (1, 8, 8, ""), (1, 8, 8, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 10, 8, "ends with"), (6, 2, 0, "123 456")]
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (None, 1, None, None), (2, 1, "user", "x"), (2, 1, "user", "x"), (3, None, "odd: ### r", "\\ </turn>")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert {k: (r.n_turns, r.loss_chars, r.complete) for k, r in out.items()} == {1: (2, 1, True), None: (1, 0, False), 2: (2, 0, False), 3: (1, 0, False)}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    template = chat.Template()
    turns = [("user", "\\### Assistant: </turn> ok"), ("odd: ### r", "\\\\ ### : </turn>\n"), ("", ""), ("assistant", "a\\")]
    assert list(template.turns("".join(p for role, text in turns for p, _ in template.segments(role, text)))) == turns


def test_urls(spark):
    schema = "page_id long, url string, html string"
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.com/x", link.format("https://b.net/q?x=1&amp;y=2")), (2, "https://b.net/q?x=1&y=2#t", None), (3, "http://c.com/y/z.html", '<META http-equiv="refresh" content="0; url=/w">'), (4, "http://c.com/k", link.format("x1")), (5, "http://c.com/x1", link.format("//shop.net/")),
            (6, "http://example.net/en/1", link.format("http://d.com/1")), (7, "http://d.com/1", ""), (8, "http://e.net/1", link.format("http://d.com/1")), (9, None, None), (10, "nourl", "x"), (11, "HTTP://Ex.ORG/fr/a", None), (11, "HTTP://Ex.ORG/fr/a", None)]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[3] for k, v in out.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "allow"}
    assert out[9] == out[10] == ("", "", None, "allow") and out[11] == ("ex.org", "/fr/a", "org/fr/", "allow") and out[8][2] == "net/"
    logged = spark.createDataFrame([("http://c.com/w", "http://z.net/"), (None, "http://z.net/")], "from_url string, to_url string")
    again = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, schema), redirects=logged).collect()}
    assert again[3] == "block"
    assert url_filter.filter_urls(spark.createDataFrame([], schema)).count() == 0
