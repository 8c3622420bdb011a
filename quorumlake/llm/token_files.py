"""Token ids of texts in files of Huffman-coded blocks, and the files read back."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import textbatch as tb
from quorumlake.llm.huffman import LONGEST, Code, code_lengths
from quorumlake.llm.shared import Scratch, partitions

#: Ids of a block at most; a document of more has several of its own.
BLOCK = 1 << 16
#: Places of the memo of unit hashes, and ids that it holds before it is emptied.
SLOTS, POOL = 1 << 21, 1 << 23

# Fixed values of the vocabulary's file: what it does before merging.  Of a file that says otherwise whole texts are encoded.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_SPACE, _LETTER, _DIGIT, _MARK, _STICKY = range(5)
_KIND = np.full(256, _STICKY, dtype=np.uint8)
_KIND[:128] = _MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[ord("'")] = _STICKY
#: The signs that stand for bytes in the vocabulary: themselves if they print, else the next ones from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SIGNS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}

_encoders: dict[str, UnitEncoder] = {}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of parts of the texts that the library encodes alike alone and in their text; and each byte's kind.

    Parts end at ASCII blanks, and where two of ASCII letters, digits and other signs meet; letters of U+00C0 to U+00FF
    are letters too.  The apostrophe and all else stays with what is around it: contractions reach over the apostrophe, and
    composition, case and kinds of other signs are for the library to know.  Texts with "<|", which begins the names of
    added tokens, are parted at blanks only.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    for at in np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))):
        own = int(np.searchsorted(offsets, at, side="right"))
        part = slice(int(offsets[own - 1]), int(offsets[own]))
        if kind[at] != _STICKY:  # else this text is done
            kind[part] = np.where(kind[part] == _SPACE, _SPACE, _STICKY)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) & (((kind[1:] != _STICKY) & (kind[:-1] != _STICKY)) | (kind[1:] == _SPACE) | (kind[:-1] == _SPACE))
    edge[offsets] = True
    at = np.flatnonzero(edge)
    inside = kind[at[:-1]] != _SPACE
    return at[:-1][inside], at[1:][inside], kind


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and how many each has."""
    size = np.array([len(x) for x in found], dtype=np.int64)
    return np.array(list(chain.from_iterable(found)), dtype=np.uint32), size


class UnitEncoder:
    """Ids of texts as the library gives them, without special tokens of its own; units seen before come from a memo."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        with open(tokenizer_file, encoding="utf-8") as f:
            told = json.load(f)
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in told["added_tokens"])
        self.by_unit = added and (told.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split[0].get("pattern") == {"Regex": _SPLIT} and not split[-1].get("add_prefix_space")
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.size = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
        self.pool, self.used = np.zeros(POOL, dtype=np.uint32), 0

    def _unit_ids(self, parts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units.  One of letters alone is one word to the library, so its merges are asked for at once."""
        merged = self.library.model.tokenize
        signs = lambda x: x.lower().decode() if x.isascii() else x.decode().lower().encode().decode("latin-1").translate(_SIGNS)  # noqa: E731  such letters are composed already
        found = [[t.id for t in merged(signs(x))] if one else [] for x, one in zip(parts, letters.tolist(), strict=True)]
        rest = np.flatnonzero(~letters).tolist()
        for i, e in zip(rest, self.library.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return _flat(found)

    def _library_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if not self.by_unit:
            ids, size = self._library_ids([texts.bytes_of(i).decode() for i in range(len(texts))])
            return ids, np.concatenate([[0], np.cumsum(size)])
        if not len(texts.data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        begin, end, kind = units(texts.data, texts.offsets)
        h = tb.span_hashes(texts.data, begin, end)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        known = self.key[slot] == h
        at, size, pool = self.at[slot], self.size[slot], self.pool
        if not known.all():
            new, first, same = np.unique(h[~known], return_index=True, return_inverse=True)
            b, e = begin[~known][first], end[~known][first]
            others = np.concatenate([[0], np.cumsum(kind != _LETTER)])
            letters = others[e] == others[b]
            ids, own = self._unit_ids([texts.data[i:j].tobytes() for i, j in zip(b.tolist(), e.tolist(), strict=True)], letters)
            if self.used + len(ids) > len(pool):  # known units of this slice keep the pool they were found in
                self.forget()
                pool = np.concatenate([pool, ids])
                start = len(pool) - len(ids) + np.cumsum(own) - own
            else:
                pool[self.used : self.used + len(ids)] = ids
                start = self.used + np.cumsum(own) - own
                self.used += len(ids)
                into = (new & np.uint64(SLOTS - 1)).astype(np.int64)
                self.key[into], self.at[into], self.size[into] = new, start, own
                # two new units of one place: the last write counts in all three arrays alike
            at[~known], size[~known] = start[same], own[same]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, texts.offsets)]


def _encoder(tokenizer_file: str) -> UnitEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = UnitEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int | None, wide: bool, block: int = BLOCK, text: str = "text") -> DataFrame:
    """doc_id, tie, row, piece, last, ids: the ids of each text and the end id, block of them a row.

    tie is a hash of the text; row tells rows of one id and text apart.  ids are bytes, 4 of an id if wide, else 2.
    """
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            for texts in tb.slices(batch.column(3)):
                ids, ptr = encoder.encode(texts)
                if end_id is not None:
                    ids, ptr = np.insert(ids, ptr[1:], end_id), ptr + np.arange(len(ptr))
                n = np.diff(ptr)
                pieces = np.maximum(1, -(-n // block))
                owner = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
                lo = ptr[owner] + piece * block
                hi = np.minimum(lo + block, ptr[owner + 1])
                body = [ids[i:j].astype(kind).tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                ids_ = [batch.column(c).take(pa.array(texts.first + owner)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*ids_, pa.array(piece, pa.int32()), pa.array(hi == ptr[owner + 1]), pa.array(body, pa.binary())], names=["doc_id", "tie", "row", "piece", "last", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tie"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, row long, piece int, last boolean, ids binary")


def id_counts(tokens: DataFrame, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and how often each does, over all rows; the driver gets a row for each id of the vocabulary at most."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own = np.bincount(np.frombuffer(cell.as_buffer(), dtype=kind))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    table = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    return table["id"].to_numpy(), table["n"].to_numpy()


_BLOCK = "part int, block int, first long, n int, doc_ids array<long>, pieces array<int>, last array<boolean>, counts array<int>, checkpoints array<int>, stream binary"


def write_ids(docs: DataFrame, tokenizer_file: str, path: str, end_id: int | None = None, block: int = BLOCK, text: str = "text") -> None:
    """Writes the ids of all texts to path: a file for each range of ids of documents, in ascending doc_id order.

    docs: doc_id and the text column.  Null ids come first; rows of one id are ordered by a hash of their texts, equal
    rows are written again each.  Null and empty texts have no ids but the end id.  An empty table gives files without
    blocks.  Other columns, whatever their names, are not looked at.

    The files are Parquet, so that Spark writes and commits them in any store.  ``blocks``: a row for each block of up to
    BLOCK ids, coded for itself, with its checkpoints (the bit of each STEP-th id), the documents in it and their
    counts.  ``codebook``: the bits of each id's code; codes are canonical, so no more is needed.

    Texts are encoded once where they lie.  The ids go through one exchange, by range, and counts of ids are the only
    thing that the driver sees: as many as the vocabulary has.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True)
    wide = max(vocabulary, (end_id or 0) + 1) > 1 << 16
    kind = "<u4" if wide else "<u2"
    with Scratch(spark) as scratch:
        tokens = scratch.keep(tokenise(docs, tokenizer_file, end_id, wide, block, text))
        ids, counts = id_counts(tokens, wide)
        lengths = code_lengths(counts, max(LONGEST, int(vocabulary).bit_length() + 2))
        book = pa.table({"id": pa.array(ids, pa.int64()), "bits": pa.array(lengths, pa.int32())})
        spark.createDataFrame(book).coalesce(1).write.parquet(f"{path}/codebook")
        code = spark.sparkContext.broadcast(Code.of(ids, lengths))
        order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, first, held = TaskContext.get().partitionId(), 0, 0, []

            def made() -> pa.RecordBatch:
                nonlocal number, first, held
                own = [np.frombuffer(x[3], dtype=kind) for x in held]
                every = np.concatenate(own)
                stream, checkpoints = code.value.encode(every) if len(every) else (b"", np.zeros(0, dtype=np.int64))
                row = [part, number, first, len(every), [x[0] for x in held], [x[1] for x in held], [x[2] for x in held], [len(x) for x in own], checkpoints.tolist(), stream]
                number, first, held = number + 1, first + len(every), []
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], names=_NAMES)

            size = 0
            for batch in batches:
                for doc, piece, last, cell in zip(*(batch.column(c) for c in range(4)), strict=True):
                    own = len(cell.as_buffer()) // (4 if wide else 2)
                    if held and size + own > block:
                        yield made()
                        size = 0
                    held.append((doc.as_py(), piece.as_py(), last.as_py(), cell.as_py()))
                    size += own
            if held:
                yield made()

        ranges = tokens.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "piece")
        ranges.select("doc_id", "piece", "last", "ids").mapInArrow(pack, _BLOCK).write.parquet(f"{path}/blocks")
        code.destroy()


_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
_NAMES = ["part", "block", "first", "n", "doc_ids", "pieces", "last", "counts", "checkpoints", "stream"]


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, Code]:
    """The blocks, each with the ids before its file (base), and the code."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()  # a row for each id of the vocabulary at most
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    sizes = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a file
    bases = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    base = spark.createDataFrame([(part, b) for (part, _), b in zip(sizes, bases, strict=False)], "part int, base long")
    return blocks.join(F.broadcast(base), "part"), Code.of(book["id"].to_numpy(), book["bits"].to_numpy())


def _segments(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Of each block: doc_id, place of the document's first id, piece, last, count of each document or piece in it; and its ids."""
    for batch in batches:
        for i in range(len(batch)):
            base, first, n, docs, pieces, last, counts, checkpoints, stream = (batch.column(c)[i] for c in range(9))
            ids = code.decode(stream.as_py(), checkpoints.values.to_numpy(), n.as_py())
            ends = np.cumsum(counts.values.to_numpy(), dtype=np.int64)
            own = np.split(ids, ends[:-1])
            begins = base.as_py() + first.as_py() + ends - counts.values.to_numpy()
            yield list(zip(docs.as_py(), begins.tolist(), pieces.as_py(), last.as_py(), counts.as_py(), strict=True)), own


_READ = ("base", "first", "n", "doc_ids", "pieces", "last", "counts", "checkpoints", "stream")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, piece, last, ids: the documents of the files, or pieces of those over a block; start is the place of
    the row's first id among all.  Blocks are decoded apart from each other, wherever they are read."""
    blocks, code = _opened(spark, path)
    shared = spark.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in _segments(batches, shared.value):
            doc, start, piece, last, _ = zip(*rows, strict=True)
            offsets = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(piece, pa.int32()), pa.array(last, pa.bool_()), lists], names=["doc_id", "start", "piece", "last", "ids"])

    return blocks.select(*_READ).mapInArrow(run, "doc_id long, start long, piece int, last boolean, ids array<int>")


def checksums(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files: the place of its first id, how many it has, and
    the checksum of all of them as little-endian 32-bit numbers.  Checksums of pieces are combined, not the pieces."""
    blocks, code = _opened(spark, path)
    shared = spark.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in _segments(batches, shared.value):
            doc, start, piece, last, n = zip(*rows, strict=True)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            start = [s - p * block for s, p in zip(start, piece, strict=True)]  # all pieces but the last are full
            columns = [pa.array(c, t) for c, t in zip((doc, start, piece, last, n, crc), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "piece", "last", "n_tokens", "ids_crc32"])

    digests = lambda some: some.select(*_READ).mapInArrow(run, "doc_id long, start long, piece int, last boolean, n_tokens long, ids_crc32 long")
    alone = (F.col("piece") == 0) & F.col("last")
    whole = digests(blocks).where(alone).select("doc_id", "start", "n_tokens", "ids_crc32")
    long_ = blocks.where(F.exists("pieces", lambda p: p > 0) | F.exists("last", lambda x: ~x))  # few, so few are decoded again
    pieces = digests(long_).where(~alone).groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("piece", "n_tokens", "ids_crc32"))).alias("pieces"))
    return whole.union(pieces.mapInArrow(_combined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, start, pieces in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            crc, n = 0, 0
            for p in pieces:
                crc, n = crc32_of_both(crc, p["ids_crc32"], 4 * p["n_tokens"]), n + p["n_tokens"]
            rows.append((doc, start, n, crc))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def crc32_of_both(one: int, two: int, size: int) -> int:
    """Checksum of two strings after each other from those of either; size: bytes of the second.

    A checksum is linear over its bits once the effect of zero bytes is taken out, so the first moves on by ``size`` zero
    bytes, which squaring the step of one byte does in few steps.
    """
    step = [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)]
    apply = lambda rows, x: _folded(rows[i] for i in range(32) if x >> i & 1)
    while size:
        if size & 1:
            one = apply(step, one)
        step = [apply(step, x) for x in step]
        size >>= 1
    return one ^ two


def _folded(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out
