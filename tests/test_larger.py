"""Steps on tables of other forms and on what grows with them: folders, many entities of a place, many small documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.plans import catalogue
from quorumlake.providers import models


@pytest.fixture(scope="module")
def foldered(spark, small, tmp_path_factory):
    """Tables of streams as folders of several files."""
    root = tmp_path_factory.mktemp("tables")
    for name in ("pages", "events"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"file://{root}/{name}.parquet")
    return f"file://{root}"


@pytest.mark.parametrize("name", ["stream_host_votes", "stream_token_windows", "stream_latest_records", "stream_first_visits"])
def test_streams_of_folders(spark, foldered, oracle, same, name):
    same(catalogue.QUERIES[name](spark, foldered).toPandas(), oracle(catalogue.ORACLES[name]))


def test_embeddings_that_cancel_out():
    """Words of one place and opposite signs, and texts without words, have a direction; blank ones have none."""
    embed = models.HashedWords(8)
    words = [f"w{i}" for i in range(60)]
    one = {w: embed([w])[0] for w in words}
    a, b = next((a, b) for a in words for b in words if not (one[a] + one[b]).any())
    v = embed([f"{a} {b}", f"{a} {b}", "...", " \n"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 1, 1, 0]) and (v[0] == v[1]).all()


def test_entities_of_one_place(spark):
    """Many entities of a place have its candidates; what meets are places, not entities with ordinances."""
    from quorumlake.operators import runs

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("NY").alias("state"), F.lit("").alias("county"), F.concat(F.lit("Athens "), F.col("id") % 2).alias("city"), F.concat(F.lit("Trees "), "id").alias("header"), F.repeat(F.lit("x "), F.lit(120)).alias("content"), F.lit(True).alias("is_substantive"))
    people = spark.range(500).select(F.col("id").alias("entity_id"), F.lit("NY").alias("state"), F.lit("athens").alias("city")).union(spark.createDataFrame([(7, "ny", "athens 1"), (900, "NY", None)], "e long, s string, c string"))
    domains = spark.createDataFrame([("trees", "Trees", ["tree"])], "domain_id string, name string, keywords array<string>")
    rows = runs.populate(people, domains, docs, lambda p: '{"relevant": true, "confidence": 70}', limit=5)
    got = {r.entity_id: r.docs for r in rows.groupBy("entity_id").agg(F.sort_array(F.collect_list("doc_id")).alias("docs")).collect()}
    assert got == {i: [0, 1, 2, 3, 4] for i in range(500)}
    assert {r.filename for r in rows.where("entity_id = 7").collect()} == {f"statute{i}.txt" for i in range(1, 6)}


@pytest.mark.parametrize("name", ["content_blocks", "anchored_texts", "statute_titles", "clean_pages", "section_chunks"])
def test_small_tables_are_dealt(spark, small, name):
    """A table of one file doesn't stay one task where each row is much work."""
    from quorumlake.plans import content_queries

    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert content_queries._parts(spark, small).rdd.getNumPartitions() == catalogue.QUERIES[name](spark, small).rdd.getNumPartitions() == wanted


def test_shares_of_a_domain(spark, tmp_path, monkeypatch):
    """A large domain is read by several tasks, each file by one of them; the driver keeps no names of files."""
    from quorumlake.sources import document_tree

    document_tree.register(spark)
    rows = spark.range(90).select(F.lit("us").alias("realm_id"), F.concat(F.lit("d"), F.col("id") % 2).alias("domain_id"), F.concat(F.lit("e "), F.col("id") % 45).alias("entity_id"), F.lit("x").alias("name"), F.col("id").cast("string").alias("content"))
    document_tree.save(rows, f"file://{tmp_path}/t")
    monkeypatch.setattr(document_tree, "FOLDERS", 10)
    parts = document_tree.TreeReader(f"{tmp_path}/t").partitions()
    found = [k for p in parts for _, k in p.paths]
    assert len(parts) > 4 and len(found) == len(set(found)) == 90
    reader = document_tree.TreeReader(f"{tmp_path}/t")
    list(reader.pushFilters([document_tree.EqualTo(("entity_id",), "e 7")]))
    assert [k for p in reader.partitions() for _, k in p.paths] == [("us", "d0", "e 7", "x"), ("us", "d1", "e 7", "x")]


def test_all_analyses_are_stored(spark, small):
    """Every entity's analyses go through the store, not those of some entities."""
    from quorumlake.sources import tables

    keys = lambda rows: {(r.entity_id, r.domain_id) for r in rows.select(F.col("entity_id").cast("string").alias("entity_id"), "domain_id").distinct().collect()}
    assert keys(catalogue.QUERIES["stored_analyses"](spark, small)) == keys(tables.answers(spark, small, current=True))


def test_names_of_a_folder(tmp_path):
    """A local folder is read piece by piece, with the names that a listing of any store gives."""
    from pyarrow import fs

    from quorumlake.sources import document_tree

    for i in range(50):
        (tmp_path / f"e {i}").mkdir()
        (tmp_path / f"f{i}").write_text("x")
    (tmp_path / "to").symlink_to(tmp_path / "e 1")
    local, other = fs.LocalFileSystem(), fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    for folders in (True, False):
        assert sorted(document_tree._names(local, str(tmp_path), folders)) == sorted(document_tree._names(other, "", folders)) == document_tree._children(local, str(tmp_path), folders)
    assert len(document_tree._children(local, str(tmp_path), True)) == 51 and not document_tree._children(local, f"{tmp_path}/none", True)
