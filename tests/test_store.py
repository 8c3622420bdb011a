"""The document store and its sinks."""

import json

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import time as times
from quorumlake.operators import rules
from quorumlake.providers import models
from quorumlake.sources import store


@pytest.fixture
def root(tmp_path):
    def put(path, value):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))

    put("realms.json", {"realms": [{"id": "oz", "name": "Oz", "entityFile": "entities.json", "datapath": "oz", "state": "OZ"}]})
    put("oz/entities.json", {"entities": [{"id": "E1", "name": "One"}, {"id": "E2", "name": "Two"}]})
    put("oz/domains.json", {"domains": [{"id": "D1", "name": "First"}, {"id": "D2", "name": "Second", "show": False}]})
    put("oz/D2/questions.json", [{"id": "Q2", "text": "two", "order": "2"}, {"id": "Q1", "text": "one", "weight": 3, "order": "1"}])
    put("oz/D1/E1/analysis.json", {"entityId": "E1", "domainId": "D1", "questions": [{"id": "Q1", "score": 0.8, "answer": "a", "confidence": 0.9}, {"questionId": "Q2", "score": 0.6, "confidence": 80}]})
    put("oz/D2/E2/analysis.json", {"municipality": {"id": "E2"}, "questions": []})
    put("oz/D1/E1/statute.txt", "Text\nof it")
    put("index.csv", "entity,domain,source,section,anchor,url\nE1,D1,https://s,12.1,a1,https://x\n\nE1,D1,https://s,\"3\",a2,https://y\n")
    put("sheet.csv", 'Name,Note\n"One, or so","said ""no"""\nTwo,\n')
    put("urls.txt", "# note\nhttps://a\n\n https://b \n")
    put("map.json", {"type": "FeatureCollection", "features": [{"properties": {"NAME": "One"}, "geometry": {"type": "Point"}}]})
    return str(tmp_path)


def test_readers(spark, root):
    assert [r.id for r in store.realms(spark, root).collect()] == ["oz"]
    assert store.realm(spark, root, "oz").state == "OZ"
    with pytest.raises(KeyError, match="oz"):
        store.realm(spark, root, "nowhere")
    assert {r.id for r in store.entities(spark, root, "oz").collect()} == {"E1", "E2"}
    assert {(r.id, r.show) for r in store.domains(spark, root, "oz").collect()} == {("D1", None), ("D2", False)}
    assert [(r.id, r.question, r.weight) for r in store.questions(spark, root, "oz", "D2").collect()] == [("Q1", "one", 3.0), ("Q2", "two", 1.0)]
    assert store.questions(spark, root, "oz", "D1").count() == 0
    rows = {(r.entity_id, r.domain_id, r.question_id, r.score, r.confidence) for r in store.analyses(spark, root, "oz").collect()}
    assert rows == {("E1", "D1", "Q1", 0.8, 0.9), ("E1", "D1", "Q2", 0.6, 0.8), ("E2", "D2", None, None, None)}
    assert store.analyses(spark, root, "none").count() == 0
    assert [tuple(r) for r in store.texts(spark, root, "oz", "statute").collect()] == [("E1", "D1", "Text\nof it")]
    assert [r.section for r in store.section_index(spark, f"{root}/index.csv").orderBy("url").collect()] == ["12.1", '"3"']
    assert [tuple(r) for r in store.sheet(spark, f"{root}/sheet.csv", ["name", "note"]).collect()] == [("One, or so", 'said "no"'), ("Two", None)]
    assert [r.url for r in store.url_list(spark, f"{root}/urls.txt").collect()] == ["https://a", "https://b"]
    assert [r.properties["NAME"] for r in store.boundaries(spark, f"{root}/map.json").collect()] == ["One"]
    assert store.file_stats(spark, f"{root}/oz/*/*/analysis.json").count() == 2


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "log")
    for day, v in (("2026-01-01 01:00:00", 1), ("2026-01-01 02:00:00", 2), ("2026-01-02 01:00:00", 3)):
        store.save_version(spark.createDataFrame([("k", v)], "k string, v int"), folder, F.lit(day))
    assert [r.v for r in store.current(spark, folder, ["k"]).collect()] == [3]
    store.prune(spark, folder, str(tmp_path / "pruned"), ["k"])
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "pruned")).collect()) == [2, 3]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a|x", 1)], "name string, n int")
    store.write_report(rows, str(tmp_path / "md"), "md", "name")
    assert [r.value for r in spark.read.text(str(tmp_path / "md"), wholetext=True).collect()] == ["| name | n |\n| --- | --- |\n| a\\|x | 1 |\n| b | — |\n".replace("|\n| ---", "|\n| ---")]
    store.write_report(rows, str(tmp_path / "csv"), "csv", "name")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_rules(spark):
    df = spark.createDataFrame([("20m", "User-agent: *\nDisallow: /a\nUser-agent: x\nDisallow: /b")], "d string, r string")
    row = df.select(times.seconds_of(F.col("d")).alias("s"), rules.robots_rules(F.col("r")).alias("p"), rules.is_pdf(F.lit("%PDF-1"), F.lit(None).cast("string"), F.lit("u")).alias("pdf")).first()
    assert (row.s, row.p, row.pdf) == (1200, ["/a"], True)


def test_embedder():
    v = models.HashedWords(32)(["tree care rules", "rules of tree care", "something else", ""])
    assert v.shape == (4, 32) and v[0] @ v[1] > v[0] @ v[2] and abs(v[0] @ v[0] - 1) < 1e-9 and not v[3].any()
    with pytest.raises(KeyError):
        models.provider("other-1")


def test_ten_thousand_domains(spark):
    """No list of domains or keywords is cut, however long it is."""
    from quorumlake.operators import lookup, matrix, pages

    ids = spark.range(10_001).select(F.concat(F.lit("d"), "id").alias("domain_id"), F.lit(True).alias("show"))
    people = spark.createDataFrame([(1, "One", "Town", False)], "entity_id long, name string, type string, test boolean")
    none = spark.createDataFrame([], "entity_id long, domain_id string, state_code boolean, mean_score double, score double")
    assert matrix.combined(people, ids, none, none.select("entity_id", "domain_id", "mean_score")).count() == 10_001
    assert matrix.summary(people, ids, none, none.select("entity_id", "domain_id", "score")).count() == 10_001
    words = ids.select("domain_id", F.lit("general").alias("type"), F.lit("tree").alias("keyword"))
    page = spark.createDataFrame([(1, "u", "A tree", "", "")], "page_id long, url string, title string, headers string, body string")
    assert pages.domain_scores(page, words).count() == 10_001
    names = ids.select(F.col("domain_id").alias("name"))
    found = lookup.similar_flags(spark.createDataFrame([("d1000x",)], "flag string"), names, most=1).collect()
    assert {(r.name, r.distance) for r in found} == {("d1000", 1), ("d10000", 1)}
