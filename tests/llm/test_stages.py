"""Pipeline stages and the mix on odd tables; predictions of languages recomputed from exact sets."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlake.llm import language, mixing
from quorumlake.llm.shared import word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_empty_tables(spark, small, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, spark.createDataFrame([], DOCS), small)
    assert out.count() == 0 and "doc_id" in out.columns, name


def test_stages_of_nulls_and_repeats(spark, small):
    line = "a line of more than ten letters"
    rows = [(1, f"{line}\nown words of the first document here", "en", "s", 1), (1, f"{line}\nown words of the first document here", "en", "s", 1), (None, line, None, None, None), (None, None, None, None, None), (2, None, "en", None, 0), (3, "", "en", "s", 0), (4, f"{line}\nother words", "en", "t", 9)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("x")).withColumn("cls", F.lit("y"))
    by = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert by(stages["language ID"](spark, docs, small)) == Counter({(1, rows[0][1]): 2, (None, line): 1, (4, rows[6][1]): 1})
    lines = stages["line dedup"](spark, docs, small)
    assert by(lines) == Counter({(1, rows[0][1]): 2, (None, ""): 2, (2, ""): 1, (3, ""): 1, (4, "other words"): 1})
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert by(stages["MinHash near-dedup"](spark, docs, small)) == Counter((r[0], r[1]) for r in rows)
    assert by(stages["benchmark decontamination"](spark, docs, small)) == Counter((r[0], r[1]) for r in rows)
    mixed = stages["mixing sources"](spark, docs, small).collect()
    assert len(mixed) == len(rows) and all(r.taken == r.copies * r.size for r in mixed)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(12)
    rows = [(i, f"s{rng.randrange(9)}" if i % 3 else "big", "w " * rng.randrange(1, 60)) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), word_count(F.col("text"))).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += t.count("w")
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    share = {s: sum(sizes.values()) * w / sum(weights.values()) for s, w in weights.items()}
    capped: set[str] = set()
    while over := {s for s in share if s not in capped and share[s] > 3 * sizes[s]}:
        capped |= over
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = {s: w for s, w in weights.items() if s not in capped}
        share = {s: 3 * sizes[s] if s in capped else rest * weights[s] / sum(free.values()) for s in share}
    assert all(abs(target[s] - share[s]) < 1e-6 * share[s] for s in share)
    assert all(abs(taken[s] - share[s]) <= 30 for s in share)  # half of the largest document


def test_predictions_from_exact_sets(spark, small):
    """Grams of each language as exact sets: the filters may err for grams that no language has, so few documents differ."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    judged = {r.doc_id: r for r in language.identify(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert {i: r.held_out for i, r in judged.items()} == {r.doc_id: held(r.doc_id) for r in docs}
    grams = lambda t: Counter(w[i : i + 3] for w in (f" {x} " for x in re.findall(r"[^\W\d_]+", (t or "").lower())) for i in range(len(w) - 2))
    known: dict[str, Counter] = {}
    for r in docs:
        if r.lang and not held(r.doc_id):
            known.setdefault(r.lang, Counter()).update(grams(r.text))
    same = letters = 0
    for r in docs:
        own = grams(r.text)
        if not own:
            assert judged[r.doc_id].lang_pred == "und" and judged[r.doc_id].score == 0
            continue
        letters += 1
        votes = {x: sum(n for g, n in own.items() if g in known[x]) for x in known}
        best = max(votes.values())
        same += votes.get(judged[r.doc_id].lang_pred, -1) >= 0.97 * best
        assert 0 <= judged[r.doc_id].score <= 1
    assert same >= 0.97 * letters


def test_lines_of_many_rows_without_ids(spark):
    from quorumlake.llm import line_dedup

    shared = "a line that all of them hold"
    rows = [(1, shared)] + [(None, f"{shared}\nown line number {i} of many\nown line number {i // 2} of many") for i in range(3000)] + [(2, "own line number 7 of many\nx")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter(r.kept for r in out if r.doc_id is None)
    wanted = Counter("\n".join(x for x in (t or "").split("\n") if x != shared and x != "own line number 7 of many") for i, t in rows if i is None)
    assert kept == wanted and {r.kept for r in out if r.doc_id} == {shared, "own line number 7 of many\nx"}
