"""The document tree, a caller's function on documents, the crawl's frontier and kept visits."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import callbacks, content, frontier
from quorumlake.sources import document_tree
from quorumlake.streaming import incremental

KEYS = "realm_id string, domain_id string, entity_id string, name string, content string"


@pytest.fixture
def tree(spark, tmp_path):
    document_tree.register(spark)
    root = f"file://{tmp_path}/tree"
    save = lambda rows: spark.createDataFrame(rows, KEYS).repartition(2).write.format("document_tree").option("path", root).mode("append").save()
    read = lambda: spark.read.format("document_tree").option("path", root).load()
    return save, read, str(tmp_path / "tree")


def test_versions_of_documents(tree):
    save, read, _ = tree
    assert read().count() == 0
    save([("us", "a/b", "e 1", "x@y.json", "one"), ("us", "c", "e2", "x", "ünï\n"), ("de", "c", "e2", "x", None)])
    save([("us", "c", "e2", "x", "two"), ("us", "c", "e2", "z", "three")])
    assert {tuple(r) for r in read().collect()} == {("us", "a/b", "e 1", "x@y.json", "one"), ("us", "c", "e2", "x", "two"), ("us", "c", "e2", "z", "three"), ("de", "c", "e2", "x", "")}


def test_filters_are_pushed(spark, tree):
    save, read, _ = tree
    save([(r, d, e, "x", r + d + e) for r in ("us", "de") for d in "ab" for e in "123"])
    some = read().where((F.col("realm_id") == "us") & F.col("domain_id").isin("a", "z") & (F.col("entity_id") > "1"))
    assert {r.content for r in some.collect()} == {"usa2", "usa3"}
    reader = document_tree.TreeReader(tree[2])
    rest = list(reader.pushFilters([document_tree.EqualTo(("realm_id",), "us"), document_tree.In(("domain_id",), ("a", "z")), document_tree.EqualTo(("content",), "q")]))
    assert [f.attribute for f in rest] == [("content",)]
    assert [k for p in reader.partitions() for _, k in p.paths] == [("us", "a", e, "x") for e in "123"]


def test_failed_writes_leave_the_old_state(spark, tree):
    save, read, root = tree
    save([("us", "a", "1", "x", "old")])
    with pytest.raises(Exception, match="needs realm"):
        save([("us", "a", "1", "x", "new"), ("us", "a", "", "x", "bad")])
    assert [r.content for r in read().collect()] == ["old"]
    files = [f for _, _, names in os.walk(f"{root}/us") for f in names if not f.endswith(".crc")]
    assert len(files) <= 2  # what a failed task left can't be read, as its write has no commit
    with pytest.raises(Exception, match="versions are only added"):
        spark.createDataFrame([("us", "a", "1", "x", "new")], KEYS).write.format("document_tree").option("path", f"file://{root}").mode("overwrite").save()


def test_errors_are_rows_and_runs_go_on(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(None, "none")], "id long, text string")

    def function(row):
        (calls / f"{row['id']}-{os.urandom(4).hex()}").touch()
        if row["id"] == 13:
            raise KeyError("poisoned")
        if row["id"] == 14:
            return [{"n": "no number"}]
        return [{"n": len(row["text"])}] * ((row["id"] or 0) % 3)

    folder = f"file://{tmp_path}/run"
    done = callbacks.process(docs, "id", function, "n long", folder, parts=4)
    assert {r.id: r.kind == "KeyError" for r in done.errors().collect()} == {13: True, 14: False}
    assert sorted(r.id for r in done.results().collect()) == sorted(i for i in range(40) if i not in (13, 14) for _ in range(i % 3))
    assert done.done().count() == 41 == len(os.listdir(calls))
    os.remove(tmp_path / "run/part-0002/_SUCCESS")
    again = callbacks.process(docs, "id", function, "n long", folder, parts=4)
    part = docs.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(4)) == 2).count()
    assert len(os.listdir(calls)) == 41 + part and again.done().count() == 41 and part < 41


def crawled(links, seeds, depth, priority, per_source, per_entity, skipped, deeper):
    """frontier.crawl() in loops, an entity after the other."""
    least = {}
    for u, pos, target in links:
        if u and target:
            least[u, target] = min(pos, least.get((u, target), pos))
    out = []
    for entity in sorted({s[0] for s in seeds}):
        found = [(False, 0, place, source, url, None) for e, source, url, place in seeds if e == entity and url]
        seen, counts, level = {}, {}, 0
        while found:
            new, met = [], set()
            for p, n, pos, source, url, parent in sorted(found, key=lambda x: (not x[0], *x[1:5])):
                if url in met:
                    continue
                met.add(url)
                counts[source] = counts.get(source, 0) + 1
                if counts[source] > per_source:
                    counts[source] -= 1
                    continue
                new.append((entity, source, url, level, len(seen) + len(new) + 1, p, parent))
            if per_entity:
                new = [x for x in new if x[4] <= per_entity]
            seen |= {x[2]: x for x in new}
            out += new
            level += 1
            found = [(priority(t), x[4], pos, x[1], t, x[2]) for x in new if level <= depth + deeper.get(x[1], 0) for (u, t), pos in least.items() if u == x[2] and t not in seen and (entity, t) not in skipped]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_crawl_order_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pages = [f"u{i}" for i in range(60)]
    links = [(rng.choice(pages), rng.randrange(50), rng.choice(pages)) for _ in range(220)] + [("u1", 1, None), (None, 1, "u2")]
    seeds = [(e, s, rng.choice(pages), i) for e in range(4) for i, s in enumerate(("main", "hub", "main"))] + [(2, "main", None, 9)]
    skipped = {(e, rng.choice(pages)) for e in range(4) for _ in range(6)}
    links = list({(u, t): (u, p, t) for u, p, t in links}.values())
    taken = {}
    links = [x for x in links if taken.setdefault((x[0], x[1]), x[2]) == x[2]]  # one place, one link
    want = crawled(links, seeds, 3, lambda t: t.endswith("7"), 9, 14 if seed else None, skipped, {"hub": 1})
    got = frontier.crawl(
        spark.createDataFrame(links, "url string, pos long, target string"), spark.createDataFrame(seeds, "entity_id long, source string, url string, place long"), 3, F.endswith("target", F.lit("7")), 9, 14 if seed else None,
        spark.createDataFrame(list(skipped), "entity_id long, url string"), {"hub": 1},
    ).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 40
    visited = spark.createDataFrame([(r.entity_id, r.url) for r in got], "entity_id long, url string")
    left = {(r.entity_id, r.url, r.n_links) for r in frontier.waiting(spark.createDataFrame(links, "url string, pos long, target string"), visited).collect()}
    own = {(r.entity_id, r.url) for r in got}
    count = {}
    for e, u in own:
        for a, _, b in links:
            if a == u and b and (e, b) not in own:
                count[e, b] = count.get((e, b), 0) + 1
    assert left == {(*k, n) for k, n in count.items()}


def test_crawl_without_seeds(spark):
    assert frontier.crawl(spark.createDataFrame([], "url string, pos long, target string"), spark.createDataFrame([], "entity_id long, source string, url string, place long"), 2).count() == 0


def test_kept_visits(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day, at = 86_400_000, lambda days: int(days * 86_400_000) + 1_700_000_000_000
    batches = [[(1, "a", 0), (1, "a", 1), (2, "a", 0.5)], [(1, "a", 2.9), (1, "b", 3)], [(1, "a", 3.0), (1, "c", 9)], [(1, "a", 9.1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, u, at(x)) for e, u, x in rows], "entity_id long, url string, ms long").selectExpr("entity_id", "url", "timestamp_millis(ms) AS ts").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        os.utime(next((tmp_path / f"in/{i}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("entity_id long, url string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    out = incremental.run_available(incremental.kept_visits(stream), "append", f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    rows = {((r.ms - at(0)) / day, r.entity_id, r.url, r.kind) for r in out.where("kind <> 'due'").collect()}
    told = {(round(r[0], 3), *r[1:]) for r in rows}
    assert told - {(9.1, 1, "a", "first"), (9.1, 1, "a", "again")} == {(0.0, 1, "a", "first"), (0.5, 2, "a", "first"), (3.0, 1, "b", "first"), (3.0, 1, "a", "again"), (9.0, 1, "c", "first")}
    assert len(told) == 6  # the last visit counts again, or as the first if its state has gone by then
    assert out.where("kind = 'due'").count() >= 1


def test_wildcards_of_menus_by_loops(spark):
    rng = random.Random(4)
    address = lambda: "https://a.org" + "".join("/" + rng.choice("pqr") for _ in range(rng.randrange(4)))
    menu, related = [(e, address()) for e in range(4) for _ in range(12)], [(e, address()) for e in range(4) for _ in range(3)]
    menu = [(e, u or "x") for e, u in menu] + [(0, "https://a.org/q*")]
    got = {tuple(r) for r in content.compact_menu(spark.createDataFrame(menu, "entity_id long, url string"), spark.createDataFrame(related, "entity_id long, url string")).collect()}
    wanted = set()
    for e in range(4):
        own, used = {u for x, u in menu if x == e}, {u for x, u in related if x == e}
        plain = {u for u in own if not u.endswith("*") and u.count("/") > 2}
        cards = {u for u in own if u.endswith("*")} | {u + "*" for u in plain if any(v.startswith(u + "/") for v in plain) and not any(v.startswith(u) for v in used)}
        wanted |= {(e, u) for u in own if not u.endswith("*") and not (u in plain and any(u.startswith(c[:-1]) for c in cards))} | {(e, c) for c in cards}
    assert got == wanted


def test_sheets_by_their_parsers(spark):
    from quorumlake.operators import sheets

    rows = spark.createDataFrame([(1, ["Bay (Town)", "G old", "VG"]), (2, ["Bay (Town/x)", "R-late"]), (3, ["", "G"]), (4, [None, "G"]), (5, []), (6, ["Hill", "?", " G"])], "row_id long, cells array<string>")
    told = lambda parser: {(r.entity_id, r.state, r.domain_id, r.grade) for r in sheets.grades(rows, parser).collect()}
    assert told(sheets.GradeSheet({"a": 1, "b": 2}, {"G": "Good", "VG": "Very Good", "R": "Red"})) == {("NY-Bay-Town", "NY", "a", "Red"), ("NY-Bay-Town", "NY", "b", "Very Good"), ("NY-Hill", "NY", "b", "Good")}

    class Lengths:
        prefix, state, columns = "x", "y", {"n": 1}
        name = staticmethod(lambda cell: F.nullif(cell, F.lit("")))
        grade = staticmethod(lambda cell: F.length(cell).cast("string"))

    assert told(Lengths()) == {("xBay (Town)", "y", "n", "5"), ("xBay (Town/x)", "y", "n", "6"), ("xHill", "y", "n", "1")}
    assert sheets.grades(rows.limit(0), Lengths()).count() == 0
