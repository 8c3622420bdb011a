"""Operators against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import fingerprint, mixing, near_dedup, queries, shared, substring_dedup, textbatch, token_count


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, small, oracle, same, name):
    same(queries.QUERIES[name](spark, small).toArrow().to_pandas(integer_object_nulls=True), oracle(queries.ORACLES[name]))  # whole numbers stay so beside nulls


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def brute_targets(sizes):
    """Weights 1, 2, 3 in turn, shares over three times a source's size dealt out again until none is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix_targets(spark):
    for sizes in ({"a": 5, "b": 1, None: 100, "c": 2}, {"a": 0, "b": 10, "c": 1}, {"x": 7}, {"a": 0}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        wanted = brute_targets(sizes)
        assert got.keys() == wanted.keys() and all(abs(got[s] - wanted[s]) < 1e-6 for s in got)


def test_mix_query(spark, small, texts):
    out = queries.op1_mix_sources(spark, small).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in out} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    sums = {}
    for r in out:
        sums[source[r.doc_id]] = sums.get(source[r.doc_id], 0) + r.taken
        assert r.taken <= 3 * r.size
    largest = max(r.size for r in out)
    assert all(abs(sums[source[r.doc_id]] - r.target) <= max(0.02 * r.target, largest) for r in out)
    assert sorted(map(tuple, queries.op1_mix_sources(spark, small).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 5000, 3000)
    p = rng.random(3000)
    after = mixing.flight(p, sizes, 7)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert abs(after @ sizes - p @ sizes) < 1e-3 and abs(after.sum() - p.sum()) < 1e-6


def test_flight_keeps_means():
    p, sizes = np.array([0.2, 0.5, 0.7, 0.6, 0.3, 0.7]), np.array([3, 5, 2, 8, 1, 4])
    drawn = np.mean([mixing.flight(p, sizes, i) for i in range(4000)], axis=0)
    assert np.abs(drawn - p).max() < 0.03


def test_mix_in_levels(spark):
    rows = spark.createDataFrame([(i, "s" if i % 5 else "t", i % 97 + 1) for i in range(3000)], "doc_id long, source string, n long")
    out = mixing.mix(rows, F.col("n"), group=50).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in out} == {"s": 2400, "t": 600} and all(abs(r.taken - r.target) <= 2 for r in out)


def brute_winnow(text, gram, window):
    code = np.array([ord(c) for c in text], dtype=np.uint64)
    gram = min(gram, len(code))
    h = [int(textbatch.mix(textbatch.roll(code[i : i + gram] + np.uint64(1), gram, fingerprint._BASE))[0] >> np.uint64(32)) for i in range(len(code) - gram + 1)]
    window = min(window, len(h))
    return sorted({min(range(i, i + window), key=lambda j: (h[j], -j)) for i in range(len(h) - window + 1)}), h


def test_winnowing():
    random.seed(3)
    for n in (1, 5, 16, 17, 40, 63, 64, 300, 700):
        text = "".join(random.choice("ab é") for _ in range(n))
        places, h = brute_winnow(text, 16, min(48, max(8, (n - 15) // 8)))  # short texts have narrower windows
        got = fingerprint.winnow(text)
        assert got[:, 1].tolist() == places and got[:, 0].tolist() == [h[p] for p in places]
    shared_part = "".join(random.choice("abcdefgh ") for _ in range(63))
    a, b = "x" * 100 + shared_part + "y" * 50, "z" * 33 + shared_part
    assert set(fingerprint.winnow(a)[:, 0]) & set(fingerprint.winnow(b)[:, 0])


def test_fingerprints_are_thinned_before_they_are_compared():
    random.seed(8)
    for n in (1, 17, 40, 113, 300, 420, 900):
        text = "".join(random.choice("ab é") for _ in range(n))
        grams = fingerprint.grams_of(n)
        for window in (1, 8, 12, 30, 48):
            places, h = brute_winnow(text, 16, max(min(window, grams), fingerprint.window_of(grams)))
            got = fingerprint.thinned(fingerprint.winnow(text), grams, window)
            assert got[:, 1].tolist() == places and got[:, 0].tolist() == [h[p] for p in places]
    likes = []
    for _ in range(200):
        text = "".join(random.choice("abcdefgh ") for _ in range(226))
        likes.append(fingerprint.likeness(fingerprint.winnow(text[:113]), fingerprint.winnow(text), 113, 226))
    assert 0.4 < sum(likes) / len(likes) < 0.55  # half of the text, and so half of what is kept


def test_fingerprint_query(spark, small, texts):
    out = {r.doc_id: r for r in queries.op3_fingerprint(spark, small).collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        third = len(texts[a]) // 3
        edited = texts[a][: len(texts[a]) - third] + texts[b][:third]
        assert out[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[a].n_chars == len(texts[a])
        assert out[a].fingerprint == fingerprint.encoded(fingerprint.winnow(texts[a])) and out[a].edited_fingerprint == fingerprint.encoded(fingerprint.winnow(edited))
        assert out[a].near_next == fingerprint.likeness(fingerprint.winnow(texts[a]), fingerprint.winnow(texts[b]), len(texts[a]), len(texts[b]))


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    judged = queries.op5_language(spark, sf).where("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert judged.right >= 0.98


def test_token_counts():
    public = pytest.importorskip("public_tokenizers")
    counter = token_count.WholeTokenCounter(public.path("piece_bpe_32k.model"), memo=50)
    random.seed(1)
    pieces = [" ", "  ", "a", "b", "The", "\n", "▁", "é", "\t", "x.", "\r", "中", "<s>", "\x00", "ing"]
    told = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    for i in range(0, len(told), 40):
        part = told[i : i + 40]
        assert counter.counts(part) == [len(x) for x in counter.library.encode(part)]


def test_token_query(spark, small, texts):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    wanted = {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op7_token_count(spark, small).collect()} == wanted


def test_words():
    told = ["The quick,  Brown fox", "", "élan 42\x00x", "\tend\n", "x"]
    import pyarrow as pa

    for rule, pattern, fold in ((textbatch.spaced_words(), r"[^\x20\x09-\x0D]+", False), (textbatch.letter_words(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        for limit in (1, 10, 1000):
            counts, hashes = [], {}
            for part in textbatch.slices(pa.array([*told, None]), limit):
                w = textbatch.words(part, rule)
                counts += w.counts().tolist()
                for i in range(len(part)):
                    text = part.bytes_of(i).decode()
                    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text
                    for word, h in zip(re.findall(pattern, text), w.hash[w.ptr[i] : w.ptr[i + 1]], strict=True):
                        assert hashes.setdefault(word, h) == h
            assert len(set(hashes.values())) == len(hashes)
            lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold else t for t in told]
            assert counts == [len(re.findall(pattern, t)) for t in lower] + [0]


def test_components(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(900, 1000)] + [(7000 + i, 7000 + i) for i in range(3)]
    edges += [(a := random.randint(2000, 2200), random.randint(2000, 2200)) for _ in range(150)]
    del a
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if not 7000 <= x < 7003}


def test_near_chain_and_copies(spark):
    random.seed(2)
    words = [str(random.random()) for _ in range(400)]
    chain = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(20)]
    copies = [(100 + i, "Same text of copies here and there " + ("again" if i % 2 else "AGAIN")) for i in range(50)]
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(chain + copies, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in range(20)) and all(out[100 + i] == 100 for i in range(50))


def test_substrings_by_brute_force(spark):
    random.seed(4)
    letters = [random.choice("abc") for _ in range(3000)]
    docs = {i: " ".join(letters[random.randint(0, 2000) :][: random.randint(0, 300)]) for i in range(40)}
    window = 12
    seen = {}
    for i, t in docs.items():
        w = t.split()
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), []).append((i, p))
    gone = {i: set() for i in docs}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i] |= set(range(p, p + window))
    wanted = {i: " ".join(x for p, x in enumerate(t.split()) if p not in gone[i]) for i, t in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept for r in substring_dedup.dedup_substrings(df, window=window).collect()}
    assert got == wanted
