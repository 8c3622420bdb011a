"""Vector search, keyword search and joins on words and edits against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.operators import keyword_hits, lookup, pages, retrieval, vector_index

CHUNKS = "chunk_id long, vector array<float>"


def top(queries, chunks, k):
    out = set()
    for q, v in queries:
        scored = []
        for c, w in chunks:
            if w is not None and np.linalg.norm(w) and np.linalg.norm(v):
                a, b = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                scored.append((-np.floor(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) * 1e6 + 0.5) / 1e6, c))
        out |= {(q, c, -s, i + 1) for i, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def told(df):
    return {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in middle[i % 12] + 0.4 * rng.normal(size=16)]) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(2000, [0.0] * 16), (2001, None)]
    return rows, [(i, rows[i][1]) for i in range(0, 600, 50)] + [(5000, [1.0] * 16)]


def test_exact_search(spark, vectors):
    chunks, queries = vectors
    got = vector_index.exact(spark.createDataFrame(queries, "query_id long, vector array<float>"), spark.createDataFrame(chunks, CHUNKS).repartition(5), 7)
    assert told(got) == top(queries, chunks, 7)


def test_index(spark, vectors, tmp_path):
    chunks, queries = vectors
    rows, asked = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(queries, "query_id long, vector array<float>")
    index = vector_index.InvertedFile.write(rows, f"file://{tmp_path}/index", cells=20)
    assert index.size() == 641 and len(index.centroids) == 20  # all but the null one, the one of length 0 too
    wanted = top(queries, chunks, 5)
    assert told(index.search_all(asked, 5, probes=1)) == wanted == told(index.search(asked, 5, probes=20))
    assert told(vector_index.InvertedFile.open(spark, index.path).search_all(asked, 5, probes=3)) == wanted
    probes = vector_index.probes_for(index, asked, rows, target=0.9)
    assert probes < 20
    n, hits = vector_index.recall(index.search(asked, 5, probes), vector_index.exact(asked, rows)).agg(F.sum("n"), F.sum("hits")).first()
    assert hits >= 0.9 * n
    with pytest.raises(Exception, match="vectors of 16 numbers"):
        index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")).collect()


def test_open_cells(spark, tmp_path, monkeypatch):
    """A query that is a chunk itself goes on with few cells, not with all of them; large cells are met by parts."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(1000 + i, [x + 1e-5 for x in v]) for i, v in rows[:60]] + [(2000 + i, rows[5][1]) for i in range(60)]
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(3)
    monkeypatch.setattr(vector_index, "CHUNKS", 32)
    index = vector_index.InvertedFile.write(chunks, f"file://{tmp_path}/open", cells=20)
    asked = [(i, v) for i, v in rows if i % 2 == 0] + [(5001, [0.0] * 16)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    for k in (1, 4, 600):
        assert told(index.search_all(queries, k, probes=2)) == top(asked, rows, k)
    near = vector_index._near(queries, index.centroids, "query_id", 2).where("cells[0] >= 0")
    told_of = lambda kth: vector_index._open_cells(near.withColumn("kth", F.lit(kth).cast("double")), index.centroids, index.least).count()
    assert told_of(1.0) < len(asked) < told_of(0.9) < told_of(None) == 18 * (len(asked) - 1)
    assert {r.parts > 1 for r in index.parts.collect()} == {True, False}
    assert index._blocks().count() < 3 * index.parts.agg(F.sum("parts")).first()[0]
    none = vector_index.InvertedFile.write(spark.createDataFrame([], CHUNKS), f"file://{tmp_path}/nothing")
    assert none.search_all(queries).count() == 0


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], CHUNKS)
    index = vector_index.InvertedFile.write(none, f"file://{tmp_path}/none")
    assert index.size() == 0 and index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")).count() == 0


def test_retrieval_by_hand(spark):
    chunks = spark.createDataFrame(
        [(1, 7, ["x"], "u/1", "Section 4 says Yes", [1.0, 0.0]), (2, 7, ["x", "y"], None, "section  4 SAYS yes", [0.9, 0.1]), (3, 7, ["x"], "", "Other § 12.3", [0.0, 1.0]), (4, 8, ["x"], "u/4", "elsewhere", [1.0, 0.0])],
        "chunk_id long, entity_id long, domain_ids array<string>, url string, content string, vector array<float>",
    )
    questions = spark.createDataFrame(
        [(7, "x", 1, 1, "first?", [[1.0, 0.0], [0.0, 1.0]]), (7, "x", 2, 2, "second?", [[0.9, 0.1]]), (9, "x", 3, 1, "third?", [[1.0, 0.0]]), (7, "x", 4, 3, "fourth?", [])],
        "entity_id long, domain_id string, question_id long, position long, question string, vectors array<array<float>>",
    )
    found = retrieval.discovered(questions, chunks, 2)
    assert {(r.question_id, r.term, r["rank"], r.chunk_id) for r in found.collect()} == {(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 1, 3), (1, 1, 2, 2), (2, 0, 1, 2), (2, 0, 2, 1)}
    rows = {r.question_id: r for r in retrieval.requests(questions, retrieval.excerpts(found, questions, chunks), "Sources:", F.when(F.col("question_id") == 4, F.array(F.lit("more")))).collect()}
    head = "=== VECTOR-RETRIEVED EXCERPTS ===\n"
    assert rows[1].prompt == f"Question: first?\n\nSources:\n\n{head}Source: u/1\n\nSection 4 says Yes\n\nsection  4 SAYS yes\n\nOther § 12.3"
    assert (rows[1].n_excerpts, rows[1].n_repeats, rows[1].refs) == (3, 1, ["Section 4", "§ 12.3"])
    assert rows[2].prompt is None and (rows[2].n_excerpts, rows[2].n_repeats) == (0, 2)
    assert rows[3].prompt is None and rows[3].refs == []
    assert rows[4].prompt == "Question: fourth?\n\nSources:\n\n=== ADDITIONAL SOURCE 1 ===\nmore"


@pytest.mark.parametrize("most, listed", [(1 << 20, 1000), (1 << 20, 0), (0, 0)])
def test_keywords_by_each_way(spark, monkeypatch, most, listed):
    monkeypatch.setattr(keyword_hits, "LISTED", listed)
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abc \n") for _ in range(rng.randrange(40))), "".join(rng.choice("ab") for _ in range(5)) if i % 3 else None) for i in range(150)]
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(80)] + ["", None, "ab c"]
    got = keyword_hits.keyword_hits(spark.createDataFrame(texts, "id long, one string, two string"), "id", ["one", "two"], spark.createDataFrame([(w,) for w in words], "keyword string"), most)
    wanted = {(i, w, w in (a or ""), w in (b or "")) for i, a, b in texts for w in set(words) - {"", None} if w in (a or "") or w in (b or "")}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_keywords(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, one string")
    assert keyword_hits.keyword_hits(texts, "id", ["one"], spark.createDataFrame([], "keyword string")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 3])
def test_similar_names(spark, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 13)))
    names = [word() for _ in range(150)]
    flags = []
    for _ in range(60):
        w = rng.choice(names)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "b" + w[at + 1 :]])
        flags.append(w)
    got = lookup.similar_flags(spark.createDataFrame([(f,) for f in [*flags, None]], "flag string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"), most)
    wanted = {(f, n, d, i + 1) for f in set(flags) for i, (d, n) in enumerate([x for x in sorted((edits(f, n), n) for n in set(names)) if x[0] <= most][:3])}
    rows = [(r.flag, r.name, r.distance, r["rank"]) for r in got.collect()]
    assert len(rows) == len(wanted) > 60 and set(rows) == wanted


def test_overlaps_and_fuzzy_names(spark):
    rng = random.Random(9)
    vocabulary = ["town", "county", *(f"word{i}" for i in range(40))]
    text = lambda: " ".join(vocabulary[int(rng.random() ** 2 * len(vocabulary))] for _ in range(rng.randrange(7)))
    titles, names = [(i, text()) for i in range(80)] + [(90, None), (91, "")], [(i, text()) for i in range(120)] + [(200, None)]
    sets = lambda rows: {i: {w for w in (t or "").split() if len(w) >= 4} for i, t in rows}
    a, b = sets(titles), sets(names)
    got = lookup.shared_words(spark.createDataFrame(titles, "question_id long, question string"), spark.createDataFrame(names, "practice_id long, practice string"))
    assert {tuple(r) for r in got.collect()} == {(i, j, len(a[i] & b[j])) for i in a for j in b if len(a[i] & b[j]) >= 2}
    fuzzy = lookup.fuzzy_entities(spark.createDataFrame(titles, "title_id long, title string"), spark.createDataFrame(names, "entity_id long, name string"), 3)
    wanted = {(i, j, h, n + 1) for i in a for n, (h, j) in enumerate((-x, y) for x, y in sorted((-len(a[i] & b[j]), j) for j in b if a[i] & b[j])[:3])}
    assert {(r.title_id, r.entity_id, r.hits, r["rank"]) for r in fuzzy.collect()} == wanted


def test_scores_have_no_nested_loop(spark, small):
    from quorumlake.plans.catalogue import QUERIES

    plan = QUERIES["page_domain_scores"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pages.MATCH == 4.0
