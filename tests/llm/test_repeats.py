"""Texts of one phrase over and over, and texts of control strings, in bounded time and memory."""

import random
import re
import resource

from pyspark.sql import functions as F

from quorumlake.llm import chat, decontaminate

LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(docs, items):
    """The contract in loops: doc_id, n_words, n_hit, item_ids."""
    words = lambda t: LETTERS.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    kinds = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            kinds.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = set()
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in kinds}:
            for i in range(len(w) - n + 1):
                own = kinds.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    ids |= own
        out.add((doc, len(w), len(hit), tuple(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def by_spark(spark, docs, items):
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found.collect()}


def test_contamination_of_periodic_texts(spark):
    rng = random.Random(6)
    phrase = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, " ".join([phrase(rng.randrange(1, 5))] * rng.randrange(1, 15)) + " " + phrase(rng.randrange(20))) for i in range(60)] + [(100, "same " * 30), (101, "Same, same"), (102, None), (103, "...")]
    docs = [(i, " ".join([phrase(rng.randrange(1, 6))] * rng.randrange(1, 30)) + " tail " + phrase(rng.randrange(60))) for i in range(60)]
    docs += [(200, "same " * 500), (201, "same same same " + "x " * 100), (202, None), (203, ""), (204, "SAME;same"), (None, "same " * 12), (200, "other text")]
    docs += [(i + 300, f"words before {t} words after") for i, t in items[:30]]
    assert by_spark(spark, docs, items) == contaminated(docs, items)


def test_hundred_thousand_equal_words(spark):
    n = 100_000
    docs = [(1, "same " * n), (2, "a b " * n), (3, "clean text"), (4, "same " * 12)]
    items = [(7, "same " * n), (8, "b a " * n), (9, "same " * 13)]
    assert by_spark(spark, docs, items) == {(1, n, n, ("7", "9"), True), (2, 2 * n, 2 * n, ("8",), True), (3, 2, 0, (), False), (4, 12, 0, (), False)}


def test_hot_passage_in_all_documents_and_items(spark):
    shared = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"d{i} {shared} e{i}") for i in range(2000)]
    items = [(i, f"i{i} {shared}") for i in range(30)]
    ids = tuple(sorted(map(str, range(30))))
    assert by_spark(spark, docs, items) == {(i, 42, 40, ids, True) for i, _ in docs}


def test_long_chats_in_bounded_memory(spark):
    template = chat.Template()
    for unit in ("word ", "é: ", "\\x### "):
        text = unit * (3_000_000 // len(unit))
        formatted = "".join(p for p, _ in template.segments("user", text))
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert list(template.turns(formatted)) == [("user", text)]
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    rows = [(1, 0, "user", "x" * 2_000_000), (1, 1, "assistant", ": \\" * 500_000)]
    (out,) = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert (out.n_turns, out.loss_chars, out.complete) == (2, 1_500_000, True)


def test_readers_refuse_what_is_no_turn():
    template = chat.Template()
    for bad in ("x", "### User x</turn>\n", "### User: a ### b</turn>\n", "### User: a</turn>", "### User: a: b</turn>\n", "### User: a\\"):
        try:
            list(template.turns(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_columns_of_other_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_hit long, hits string")
    assert decontaminate.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("cls"))).first().n_hit == 2
