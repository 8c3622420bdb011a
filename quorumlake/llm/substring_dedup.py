"""Exact substring deduplication: fixed blocks as anchors, rolling windows as probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import textbatch as tb

#: Words of a window that counts as a repeat.
WINDOW = 35
#: Filter of indexed blocks: a fixed 2**28 bits (32 MB), and 2**25 bits (4 MB) for blocks indexed twice or more.
SEGMENTS = 256
SEGMENT_BITS = 1 << 20
TWICE_BITS = 1 << 17
PROBES = 3

_RULE = tb.spaced_words()


def block_size(window: int) -> int:
    """Any span of ``window`` words holds a whole block of so many words that starts at a multiple of it."""
    return (window + 1) // 2


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Bits inside a hash's segment."""
    return [((h >> np.uint64(8 + 14 * i)) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(size) for i in range(PROBES)]


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """segment, h, again: the distinct hashes of the non-overlapping reference blocks of all documents, and whether more
    than one block has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column(0)):
                w = tb.words(texts, _RULE)
                h, at = tb.grams(w.hash, w.ptr, size)
                own, n = np.unique(h[(at - w.ptr[:-1][w.text_of()[at]]) % size == 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(own)), pa.array(n > 1)], names=["h", "again"])

    once = docs.select("text").mapInArrow(run, "h long, again boolean")
    # a block that a third of all documents hold is one row a task before it is shuffled
    counted = once.groupBy("h").agg((F.max("again") | (F.count("*") > 1)).alias("again"))
    return counted.select(F.col("h").bitwiseAND(SEGMENTS - 1).cast("int").alias("segment"), "h", "again")


def _filters(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all blocks and of the repeated ones; their size is fixed, so the driver gets as much at any scale."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(once).tobytes()], pa.binary()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "once", "twice"])

        for batch in batches:
            segments, hashes, again = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(segments):
                own = segments == s
                if s != now:
                    if now is not None:
                        yield made()
                    now, once, twice = int(s), np.zeros(SEGMENT_BITS, dtype=np.uint8), np.zeros(TWICE_BITS, dtype=np.uint8)
                for b in _bits(hashes[own], SEGMENT_BITS):
                    once[b] = 1
                for b in _bits(hashes[own & again], TWICE_BITS):
                    twice[b] = 1
        if now is not None:
            yield made()

    rows = blocks.repartition("segment").sortWithinPartitions("segment").mapInArrow(fill, "segment int, once binary, twice binary").toArrow()
    once, twice = np.zeros((SEGMENTS, SEGMENT_BITS // 8), dtype=np.uint8), np.zeros((SEGMENTS, TWICE_BITS // 8), dtype=np.uint8)
    for s, a, b in zip(rows["segment"].to_pylist(), rows["once"], rows["twice"], strict=True):
        once[s], twice[s] = np.frombuffer(a.as_buffer(), dtype=np.uint8), np.frombuffer(b.as_buffer(), dtype=np.uint8)
    return once, twice


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    segment = (h & np.uint64(SEGMENTS - 1)).astype(np.int64)
    ok = np.ones(len(h), dtype=bool)
    for b in _bits(h, table.shape[1] * 8):
        b = b.astype(np.int64)
        ok &= (table[segment, b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 > 0
    return ok


#: Kinds of places: a run of starts known to repeat; a start to look for elsewhere; one that stands for known ones.
_KNOWN, _OPEN, _SIGN = 0, 1, 2
_RUN = 1 << 31


def _places(docs: DataFrame, filters, window: int, size: int) -> DataFrame:
    """Windows that an anchor hit doesn't rule out, with what else must be known of them.

    A window that repeats inside its batch is settled there; one of its kind goes on as a sign for other batches.  So a
    window that a third of all documents hold is as many rows as there are batches.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = filters.value
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            docs_ = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in tb.slices(batch.column(1)):
                w = tb.words(texts, _RULE)
                h, at = tb.grams(w.hash, w.ptr, size)
                if not len(h):
                    continue
                text_of = w.text_of()
                aligned = (at - w.ptr[:-1][text_of[at]]) % size == 0
                hit = _in(once, h)
                hit[aligned] = _in(twice, h[aligned])
                # a window holds the grams that start at its first window - size + 1 words
                hits = np.zeros(len(w.hash) + 1, dtype=np.int64)
                hits[at[hit] + 1] = 1
                edge = np.cumsum(hits)
                one, start = tb.grams(w.hash, w.ptr, window)
                two, _ = tb.grams(w.hash, w.ptr, window, salt=1)
                ok = edge[start + window - size + 1] > edge[start]
                one, two, start = one[ok], two[ok], start[ok]
                found[0].append(one)
                found[1].append(two >> np.uint64(33))
                found[2].append(docs_[texts.first + text_of[start]] if len(start) else np.zeros(0, dtype=np.int64))
                found[3].append(start - w.ptr[:-1][text_of[start]] if len(start) else start)
            one, two, doc, pos = (np.concatenate(x) for x in found)
            if not len(one):
                continue
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            again = np.zeros(len(order), dtype=bool)
            again[1:] |= same
            first = ~again
            again[:-1] |= same
            known = np.zeros(len(order), dtype=bool)
            known[order] = again
            sign = np.zeros(len(order), dtype=bool)
            sign[order] = first & again
            yield from _rows(one[~known], two[~known], doc[~known], pos[~known] << 2 | _OPEN)
            yield from _rows(one[sign], two[sign], doc[sign], pos[sign] << 2 | _SIGN)
            # rows of a document follow each other, so runs of known starts are found where the place jumps
            d, p = doc[known], pos[known]
            if len(d):
                jump = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]))
                length = np.diff(np.append(jump, len(d)))
                yield from _rows(tb.mix(d[jump].view(np.uint64)), length.astype(np.uint64), d[jump], p[jump] << 2 | _KNOWN)

    return docs.mapInArrow(probe, "part long, more int, doc long, place long")


def _rows(part: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(part), 100_000):
        j = i + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(tb.signed(part[i:j])), pa.array(more[i:j].astype(np.int32)), pa.array(doc[i:j].astype(np.int64)), pa.array(place[i:j].astype(np.int64))], names=["part", "more", "doc", "place"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places sorted by window, those that stand twice; of a window of any size one row at most is held."""
    key, repeated, held = None, False, None

    def out(doc: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(run)], names=["doc", "run"])

    for batch in batches:
        part, more, doc, place = (batch.column(i).to_numpy() for i in range(4))
        kind, pos = place & 3, place >> 2
        known = kind == _KNOWN
        if known.any():
            yield out(doc[known], pos[known] * _RUN + more[known])
        part, more, doc, pos, kind = part[~known], more[~known], doc[~known], pos[~known], kind[~known]
        if not len(part):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (more[1:] != more[:-1])]))
        sizes = np.diff(np.append(starts, len(part)))
        yes = (sizes > 1) | (np.maximum.reduceat(kind, starts) == _SIGN)
        if key == (part[0], more[0]):
            if held is not None:
                yield out(held[0], held[1])
            yes[0] = True
        elif key is not None and held is not None:
            held = None
        emit = np.repeat(yes, sizes)
        # the last window may go on in the next batch
        key, repeated = (part[-1], more[-1]), bool(yes[-1])
        held = None if repeated or kind[-1] == _SIGN else (doc[-1:], pos[-1:] * _RUN + 1)
        emit &= kind == _OPEN
        yield out(doc[emit], pos[emit] * _RUN + 1)


def dedup_substrings(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes words covered by a window of ``window`` words that also starts elsewhere, in any document or the same.

    docs: doc_id and the text column.  Returns doc_id, n_words, n_removed and kept (the words left, joined by one
    blank), a row for each row of docs; windows are judged on the input.  Words are runs without blanks and the control
    characters 9 to 13.  Null and empty texts have no words.  Repeated rows are documents of their own, so both lose
    what they share.  Ids may be null or repeat: then digests of id and text tell rows apart.

    Every document is cut into blocks of 18 words that don't overlap.  A repeat of 35 words holds a whole block of
    either side, so it shows as a rolling probe at another offset that hits an indexed block, or as a block indexed
    twice.  Both tests use bitmaps of fixed size, which let false hits pass but lose none; when they fill up at a very
    large scale, more windows pass and the result stays the same.  Windows with a hit go, as 96-bit hashes with their
    place, to one shuffle that settles exactly which occur again; joining neighbouring places extends them to the
    maximal repeats, which are then cut out of the texts.

    Data moved: 8 bytes for each block, some 20 for each repeated window, and the texts once by document.
    """
    spark, size = docs.sparkSession, block_size(window)
    n, ids, different = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    key = F.col("doc_id").cast("long") if n == ids == different else F.xxhash64("doc_id", text)
    source = docs.select(key.alias("doc"), F.col(text).cast("string").alias("text"))
    filters = spark.sparkContext.broadcast(_filters(_blocks(source, size)))
    places = _places(source, filters, window, size)
    runs = places.repartition("part").sortWithinPartitions("part", "more").mapInArrow(_repeated, "doc long, run long")
    # rows of one id and text have the same runs, which are then gathered once
    gather = F.collect_list if n == ids == different else F.collect_set
    runs = (runs.repartition("doc") if gather is F.collect_list else runs).groupBy("doc").agg(gather("run").alias("runs")).withColumnRenamed("doc", "__doc")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), key.alias("__key")).join(runs, F.col("__key") == F.col("__doc"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for texts in tb.slices(batch.column(1)):
                w = tb.words(texts, _RULE)
                gone = np.zeros(len(w.hash), dtype=bool)
                for i in range(len(texts)):
                    own = lists[texts.first + i]
                    if own.is_valid:
                        r = own.values.to_numpy()
                        lo, hi = w.ptr[i], w.ptr[i + 1]
                        edge = np.zeros(hi - lo + 1, dtype=np.int64)
                        np.add.at(edge, r // _RUN, 1)
                        np.add.at(edge, r // _RUN + r % _RUN - 1 + window, -1)
                        gone[lo:hi] = np.cumsum(edge[:-1]) > 0
                kept, offsets = _joined(texts, w, ~gone)
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.ptr[:-1]) * (w.counts() > 0) if len(texts) else w.counts()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(texts.first, len(texts)), pa.array(w.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(kept)).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def _joined(texts: tb.Texts, w: tb.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text, joined by one blank, and where each text begins."""
    start, end, text_of = w.start[keep], w.end[keep], w.text_of()[keep]
    data = np.append(texts.data, np.uint8(0x20))
    last = np.append(text_of[1:] != text_of[:-1], True) if len(start) else np.zeros(0, dtype=bool)
    data[end[~last]] = 0x20
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[start] += 1
    edge[end + ~last] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    return data[inside], total[texts.offsets].astype(np.int64)
