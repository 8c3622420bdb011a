"""Spelling variants, ball trees and token files against plain Python."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import ball_tree, huffman, spelling, token_files
from quorumlake.llm import textbatch as tb

DOCS = "doc_id long, text string, word string, key string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    """The contract of spelling_variants() in a few loops."""
    letters = {chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))}
    n = Counter()
    for doc, text in rows:
        runs = "".join(c if c in letters else " " for c in text or "").split()
        for run in runs:
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    friends = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {}
    for w, own in friends.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(friends[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def spelled_by_spark(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)
    return [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs).collect()]


def test_spelling_against_loops(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abéz") for _ in range(rng.randrange(7, 10))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(bases[: 1 + int(rng.random() ** 3 * len(bases))])
            at = rng.randrange(len(w))
            w = rng.choice([w] * 12 + [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "É" + w[at + 1 :], w.upper()])
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1", "×-", "\n"]).join(words)))
    rows += [(500 + i, f"{w} " * n) for i, (w, n) in enumerate((("chainaaa", 2), ("chainaab", 30), ("chainabb", 400)))]
    rows += [(None, "abcdefgh abcdefgh"), (None, None), (7, ""), (8, "Ä" * 3000 + " " + "Ä" * 3000), (9, "zzzzzzz " * 4000), (9, "zzzzzzz " * 4000), (10, "no")]
    got, wanted = spelled_by_spark(spark, rows), spelled(rows)
    assert len(got) == len(wanted) and set(got) == wanted
    assert sum(1 for r in wanted if r[3]) > 20 and any(r[3] and r[5] != r[3] for r in wanted)


def test_spelling_of_nothing(spark):
    assert spelled_by_spark(spark, []) == [] == spelled_by_spark(spark, [(1, None), (2, "one two")])


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 10)
    text = "abc defghijklmnopqrstu " + "x" * 40 + " é-" * 9
    assert [x for p in spelling._pieces(text) for x in spelling._RUN.findall(p)] == spelling._RUN.findall(text)


def test_keys_meet_all_near_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aabbc") for _ in range(rng.randrange(7, 11))) for _ in range(900)})
    grams = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    ranks = {g: i for i, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (x[1], x[0])))}
    keys = {w: spelling.keys_of(w, ranks) for w in words}
    found = 0
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                short, long_ = sorted((a, b), key=len)
                found += 1
                assert keys[short][0] & keys[long_][len(long_) > len(short)], (a, b)
    assert found > 300


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


def clustered(rows, k=16, rounds=3):
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, [max(-ball_tree.LIMIT, min(ball_tree.LIMIT, x)) for x in v]) for i, v in fine]
    start = sorted(fine, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        label = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in fine]
        if step < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), x in zip(fine, label, strict=True) if x == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    rows = [(i, c, far(v, centroids[c])) for (i, v), c in zip(fine, label, strict=True)]
    inertia = {c: sum(d for _, x, d in rows if x == c) for c in set(label)}
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), name(c)) for i, c, d in rows)


def clustered_by_spark(spark, rows):
    out = ball_tree.cluster(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


def test_clusters_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in middle[i % 5] + rng.normal(size=64) * (0.02 if i % 3 else 0.6)]) for i in range(350)]
    rows += [(1000 + i, [0.5] * 64) for i in range(120)] + [(2000 + i, [float(x) for x in np.round(rng.normal(size=64))]) for i in range(40)]
    rows += [(None, [0.25] * 64), (None, [0.75] * 64), (3, rows[3][1]), (3000, None), (3001, [1.0] * 63), (3002, [float("nan")] * 64), (3003, [None] + [0.0] * 63), (3004, [float("inf")] * 64), (3005, [1e30] + [-1e30] * 63)]
    assert clustered_by_spark(spark, rows) == clustered(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1] * 64), (2, [0.2] * 64), (2, [0.2] * 64)]
    assert clustered_by_spark(spark, rows) == clustered(rows)
    assert clustered_by_spark(spark, []) == [] == clustered_by_spark(spark, [(1, None)])


def test_balls_are_assigned_unopened():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-5, 5, (1000, 64)) + 1000 * i for i in range(2)])
    tree, order = ball_tree.Tree.of(points)
    assert sorted(order) == list(range(2000)) and (tree.points == points[order]).all()
    assert all((tree.sums[i] == tree.points[lo:hi].sum(axis=0)).all() for i, (lo, hi) in enumerate(zip(tree.first, tree.last, strict=True)))
    parts = list(tree.assign(np.stack([np.zeros(64, dtype=np.int64), np.full(64, 1000), np.full(64, 50_000)])))
    assert len(parts) < 10 and all(s is not None for *_, s in parts) and sum(hi - lo for lo, hi, *_ in parts) == 2000


def plain_huffman(counts):
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    bits, n = [0] * len(counts), len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            bits[i] += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        n += 1
    return bits


def test_codes_are_as_short_as_can_be():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 17, 300):
        counts = rng.integers(1, 1000, n)
        bits = huffman.code_lengths(counts)
        assert (bits * counts).sum() == (np.array(plain_huffman(counts)) * counts).sum() and (2.0**-bits).sum() == 1
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    bits = huffman.code_lengths(fibonacci, 5)
    assert bits.max() == 5 and (2.0**-bits).sum() == 1 and (bits * fibonacci).sum() > (np.array(plain_huffman(fibonacci)) * fibonacci).sum()
    assert list(huffman.code_lengths(np.array([7]))) == [1] and not len(huffman.code_lengths(np.zeros(0)))
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_streams_come_back_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.unique(rng.integers(0, 49_000, 3000))
    counts = rng.zipf(1.4, len(ids)).clip(1, 10**9)
    code = huffman.Code.of(ids, huffman.code_lengths(counts))
    text = rng.choice(ids, n)
    stream, checkpoints = code.encode(text)
    assert (code.decode(stream, checkpoints, n) == text).all()
    last = len(checkpoints) - 1
    assert (code.decode(stream, checkpoints[last:], n - last * huffman.STEP) == text[last * huffman.STEP :]).all()


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_units_are_encoded_as_the_library_does():
    rng = random.Random(3)
    letters = "aAeE.,'’-_<|>12 \n\t̀̌̈JÀéß×中😀 ²İ"
    texts = ["It's we'LL don''t 'sx", "<|endoftext|> a<|startoftext|>b <|STARTOFTEXT|> it's", "J̌ H̱x ẗ", "à́b.́, x≠ ≮", "ÀÉ×÷é.", "1234 ½ ²x 3rd", "x\xa0y\u0085z\x1c\x1df", "中文 한국어 각", "ﬁ ß ẞ İstanbul ΑΣ", "", "<|", "x<|y e's", "é" * 900, "a" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)]
    encoder, own = token_files.UnitEncoder(vocabulary()), library()
    assert encoder.by_unit
    for _ in range(2):  # from the library, then from the memo
        for part in tb.slices(pa.array([*texts, None])):
            ids, ptr = encoder.encode(part)
            for i in range(len(part)):
                assert ids[ptr[i] : ptr[i + 1]].tolist() == own.encode(part.bytes_of(i).decode(), add_special_tokens=False).ids, part.bytes_of(i)


def test_memo_may_be_emptied(monkeypatch):
    monkeypatch.setattr(token_files, "POOL", 40)
    monkeypatch.setattr(token_files, "SLOTS", 8)
    encoder, own = token_files.UnitEncoder(vocabulary()), library()
    for text in ("one two three one four", "five six seven eight nine ten eleven twelve one " * 3, "one five thirteen"):
        (part,) = tb.slices(pa.array([text]))
        assert encoder.encode(part)[0].tolist() == own.encode(text, add_special_tokens=False).ids


def test_files_come_back(spark, tmp_path):
    own = library()
    texts = [(5, "one two three"), (2, None), (9, ""), (None, "null id"), (2, "twice"), (2, "twice"), (7, "long text of many words " * 40), (1, "Éa <|endoftext|>"), (3, "x")]
    docs = spark.createDataFrame([(i, t, "p", "k", 1) for i, t in texts], "doc_id long, text string, part string, row string, ids long")
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(docs, vocabulary(), path, end_id=2, block=16)
    ids = {t: [*own.encode(t or "", add_special_tokens=False).ids, 2] for _, t in texts}
    pieces = token_files.read_ids(spark, path).collect()
    whole = {}
    for r in sorted(pieces, key=lambda r: r.start):
        whole.setdefault(r.start - 16 * r.piece, (r.doc_id, []))[1].extend(r.ids)
    assert sorted(map(str, whole.values())) == sorted(str((i, ids[t])) for i, t in texts)
    order = [whole[s] for s in sorted(whole)]
    assert [i for i, _ in order] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    assert sorted(whole) == np.cumsum([0, *(len(x) for _, x in order)])[:-1].tolist()
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    told = {(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.checksums(spark, path, block=16).collect()}
    assert told == {(s, i, len(x), crc(x)) for s, (i, x) in whole.items()}
    assert max(r.piece for r in pieces) > 3 and sum(1 for x in whole.values() if len(x[1]) > 16) == 1


def test_files_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_ids(none, vocabulary(), f"file://{tmp_path}/none", end_id=2)
    assert token_files.checksums(spark, f"file://{tmp_path}/none").count() == 0 == token_files.read_ids(spark, f"file://{tmp_path}/none").count()
    token_files.write_ids(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), vocabulary(), f"file://{tmp_path}/empty")
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.checksums(spark, f"file://{tmp_path}/empty").orderBy("doc_id").collect()] == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_checksums_of_both():
    one, two = b"hello world", bytes(range(200))
    assert token_files.crc32_of_both(zlib.crc32(one), zlib.crc32(two), len(two)) == zlib.crc32(one + two)
    assert token_files.crc32_of_both(0, zlib.crc32(two), len(two)) == zlib.crc32(two)


def test_query_of_token_files(spark, small):
    from quorumlake.llm.queries import QUERIES

    own, at = library(), 0
    got = {r.doc_id: r for r in QUERIES["op13_token_files"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    for r in docs:
        ids = [*own.encode(r.text, add_special_tokens=False).ids, 2]
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)
