"""Operators and pipeline stages held against plain Python: long texts, hot rows, random links, exact sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlake.llm import decontaminate, fingerprint, language, line_dedup, mixing, near_dedup, substring_dedup, token_count, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of_text(texts, **more):
    return [(i, t, more.get("lang", "en"), "a" if (i or 0) % 3 else "b", len(t or "")) for i, t in texts]


def prose(rng, n, words=400):
    return " ".join(f"word{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def stage_docs(spark):
    rng = random.Random(5)
    own = [prose(rng, 60) for _ in range(40)]
    texts = list(enumerate(own)) + [(100, own[3]), (101, own[4] + " tail"), (102, None), (103, ""), (104, "12 34"), (105, "head line of ten\nthis line stands in two documents"), (106, "other\nThis line stands in two documents "), (7, own[8])]
    return spark.createDataFrame(rows_of_text(texts), DOCS), texts


def test_stages_keep_the_columns_and_take_effect(spark, small, stage_docs):
    docs, texts = stage_docs
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        after[name] = out.collect()
    rejected = [i for i, t in texts if not re.search("[a-z]", t or "")]
    assert sorted(r.doc_id for r in after["language ID"]) == sorted(i for i, _ in texts if i not in rejected)
    assert {r.text for r in after["line dedup"] if r.doc_id in (105, 106)} == {"head line of ten\nthis line stands in two documents", "other"}
    assert len(after["line dedup"]) == len(texts) and all(r.n_chars == len(r.text) for r in after["line dedup"])
    kept = [r.doc_id for r in after["MinHash near-dedup"]]
    assert not {8, 100, 101} & set(kept) and {3, 4, 7, 102, 103, 104} <= set(kept)


def test_contaminated_documents_go(spark, small):
    passage = next(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) >= 20)
    docs = spark.createDataFrame(rows_of_text([(1, "before " + passage + " after"), (2, "nothing of the kind is in here"), (None, passage), (3, None)]), DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, small).collect()) == [2, 3]


def test_run_is_the_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
    assert {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, small).collect()} == {(r.doc_id, r.copies) for r in docs.collect()}


LONG = " ".join(f"w{i * i % 7919}" for i in range(120_000))


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame(rows_of_text([(1, LONG), (2, LONG), (3, "short text of a few words"), (4, "x" * 3_000_000)]), DOCS)


def test_long_texts(spark, long_docs):
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(long_docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(long_docs).collect()}
    assert cut == {1: (120_000, 120_000), 2: (120_000, 120_000), 3: (6, 0), 4: (1, 0)}
    lines = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(long_docs).collect()}
    assert lines == {1: 0, 2: 1, 3: 0, 4: 0}
    said = {r.doc_id: r.lang_pred for r in language.identify(long_docs).collect()}
    assert len(said) == 4
    prints = {r.doc_id: r for r in fingerprint.with_neighbour(long_docs.select("doc_id", "text")).collect()}
    assert prints[1].n_chars == len(LONG) and prints[2].near_next == 1
    mixed = mixing.mix(long_docs, F.length("text")).collect()
    assert len(mixed) == 4
    public = pytest.importorskip("public_tokenizers")
    assert {r.doc_id for r in token_count.count_tokens(long_docs.where("doc_id < 3"), public.path("piece_bpe_32k.model")).collect() if r.n_tokens > 100_000} == {1, 2}


def test_a_long_benchmark_text(spark, long_docs):
    items = spark.createDataFrame([(1, LONG), (2, "a few words")], "item_id long, text string")
    hit = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.find_contamination(long_docs, items).collect()}
    assert hit == {1: (120_000, 1), 2: (120_000, 1), 3: (3, 1), 4: (0, 0)}


def test_ten_thousand_equal_rows(spark):
    line = "one and the same row of more than five words " + " ".join(f"k{i}" for i in range(40))
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(line).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    assert near_dedup.near_duplicates(docs).where("kept and component_id = 1").count() == 10_000
    assert substring_dedup.dedup_substrings(docs).where("n_removed = n_words").count() == 10_000
    mixed = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")), F.lit(3)).agg(F.count("*"), F.sum("taken"), F.first("target")).first()
    assert mixed[0] == 10_000 and abs(mixed[1] - mixed[2]) <= 3


def test_clashing_names(spark, stage_docs):
    docs = stage_docs[0].withColumn("cls", F.lit(1)).withColumn("row", F.lit(2)).withColumn("n_words", F.lit(3)).withColumn("component_id", F.lit(4))
    n = docs.count()
    assert near_dedup.near_duplicates(docs).count() == n and substring_dedup.dedup_substrings(docs).count() == n
    assert decontaminate.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text", "cls")).count() == n
    pages = spark.createDataFrame([(1, "http://a.net/", None, "x")], "page_id long, url string, html string, host string")
    assert url_filter.filter_urls(pages).first().verdict == "block"


def test_redirect_components_against_union_find(spark):
    rng = random.Random(9)
    url = lambda i: f"http://h{i}.{('com', 'net', 'org')[i % 17 % 3] if i % 17 < 3 else 'example'}/{'fr' if i % 2 else 'x'}/"
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, i) for i in range(60, 90)]
    pages = [(i, url(i), None) for i in range(300)]
    redirects = spark.createDataFrame([(url(a), url(b)) for a, b in links], "from_url string, to_url string")
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    rule = lambda u: "block" if re.match(r"http://[^/]*\.net/", u) else "allow" if re.match(r"http://[^/]*\.org/fr/", u) else None
    members = {}
    for i in range(300):
        members.setdefault(find(i), []).append(rule(url(i)))
    wanted = {i: rule(url(i)) or ("allow" if "allow" in (m := members[find(i)]) else "block" if "block" in m else "allow") for i in range(300)}
    assert set(wanted.values()) == {"allow", "block"}
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=redirects).collect()}
    assert got == wanted


def test_links_are_made_absolute(spark):
    link = '<link href="{}" rel="alternate canonical">'
    targets = {"../b": "http://a.com/b", "./b/": "http://a.com/x/b/", "../../../b?q=/../1": "http://a.com/b?q=/../1", "/y/./z/..": "http://a.com/y/", "mailto:me@b.com": None, "c.d": "http://a.com/x/c.d"}
    pages = spark.createDataFrame([("http://a.com/x/k", link.format(t)) for t in targets], "url string, html string")
    got = {r.b for r in url_filter.alias_edges(pages).collect()}
    assert got == {t for t in targets.values() if t}


def test_language_filters_against_exact_sets():
    rng = np.random.default_rng(4)
    members = [rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(3)]
    filters = language.LanguageFilters.build(["a", "b", "c"], members)
    asked = np.concatenate([members[0][:500], members[1][:300], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    text_of = np.repeat([0, 1], [500, len(asked) - 500])
    votes = filters.votes(asked, text_of, 2)
    exact = np.array([[np.isin(asked[text_of == t], m).sum() for m in members] for t in range(2)])
    assert np.abs(votes - exact).max() <= 10
    assert (votes.argmax(axis=1) == exact.argmax(axis=1)).all()


def test_edited_likeness(spark):
    rng = random.Random(6)
    texts = [(i, prose(rng, n, 5000)) for i, n in enumerate((8, 8, 40, 400, 2000))]
    for r in fingerprint.with_neighbour(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        own, other = fingerprint.winnow(dict(texts)[r.doc_id]), fingerprint.winnow(r.edited)
        a, b = set(own[:, 0].tolist()), set(other[:, 0].tolist())
        assert r.near_edited == len(a & b) / len(a | b) and r.near_edited > 0.25
