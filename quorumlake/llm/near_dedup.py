"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm import textbatch as tb
from quorumlake.llm.shared import Scratch, bitmap_of, connected_components, in_bitmap, join_sized, materialise, partitions

#: Words of a shingle, and the similarity in hundredths from which two documents are linked.
SHINGLE = 5
LINK = 75
#: Keys of each of the two collections, and minhashes of a key: COLLECTION ** 2 tables for 2 * COLLECTION * DEPTH minhashes.
COLLECTION = 12
DEPTH = 2
#: Bins of the sketch that pairs are judged by before they are confirmed, and how many standard deviations below the
#: threshold a pair may look: one at the threshold is missed with a chance of 3e-6.
BINS, SPREAD = 128, 4.5
#: Sets and shingles of a block (a larger bucket is cut into blocks, and every two of them meet in a task); and shingles
#: that a task gathers before it compares, a set counting ROW more.
BLOCK, BLOCK_SHINGLES, GATHERED, ROW = 1000, 1 << 20, 1 << 21, 64
#: Pairs that are confirmed before links are looked at again.
ROUND = 4000
#: Bits of the filter of rows whose sets are needed: a fixed 4 MB.
FILTER_BITS = 1 << 25

_RULE = tb.spaced_words(fold_case=True)
_HASHES = 2 * COLLECTION * DEPTH
_A = tb.mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = tb.mix(_A) | np.uint64(1)
_NONE = b""
_FILLED = np.arange(BINS + 1)
#: Bins that must agree, by the number of bins that either of two sketches fills.
_AGREE = np.maximum(1, np.ceil((_FILLED * LINK - SPREAD * np.sqrt(_FILLED * LINK * (100 - LINK))) / 100))


def _ranked(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th random order of shingles, as 32-bit ranks."""
    x = (h ^ _A[j]) * _B[j]
    return ((x ^ (x >> np.uint64(29))) * _A[j]) >> np.uint64(32)


def shingles(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and where each text's begin; a text of fewer words is one shingle."""
    h, at = tb.grams(w.hash, w.ptr, SHINGLE)
    ptr = np.searchsorted(at, w.ptr)
    counts = w.counts()
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        extra = np.array([tb.grams(own := w.hash[w.ptr[i] : w.ptr[i + 1]], np.array([0, len(own)]), len(own))[0][0] for i in few], dtype=np.uint64)
        h = np.insert(h, ptr[few], extra)
        ptr = ptr + np.concatenate([[0], np.cumsum((counts > 0) & (counts < SHINGLE))])
    return h, ptr


def _class_of(own: np.ndarray) -> bytes:
    """128-bit name of a set of shingles; none for an empty one."""
    return tb.digest128(own.tobytes()) if len(own) else _NONE


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), n (size of the set), cls (its name), u and v (keys of the two collections)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in tb.slices(batch.column(2)):
                h, ptr = shingles(tb.words(texts, _RULE))
                own = [np.unique(h[ptr[i] : ptr[i + 1]]) for i in range(len(texts))]
                full = np.flatnonzero(np.diff(ptr) > 0)
                low = np.zeros((_HASHES, len(texts)), dtype=np.uint64)
                if len(full):
                    for j in range(_HASHES):
                        low[j, full] = np.minimum.reduceat(_ranked(h, j), ptr[full])
                pair = low.T.reshape(len(texts), 2 * COLLECTION, DEPTH)
                keys = tb.mix((pair[:, :, 0] << np.uint64(32) | pair[:, :, 1]) + _A[: 2 * COLLECTION])
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(tb.signed(k).reshape(-1)), COLLECTION).cast(pa.list_(pa.int64())) for k in (np.ascontiguousarray(keys[:, :COLLECTION]), np.ascontiguousarray(keys[:, COLLECTION:]))]
                ids = [batch.column(c).slice(texts.first, len(texts)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array([len(x) for x in own], pa.int64()), pa.array([_class_of(x) for x in own], pa.binary()), *lists],
                    names=["doc_id", "row", "n", "cls", "u", "v"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n long, cls binary, u array<long>, v array<long>")


def _cells(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """cell, cls, n: the sets in the cells of the tables.

    A table is a key of one collection combined with a key of the other.  Keys that only one set has are dropped first,
    so the combinations are made for the few sets that may meet.
    """
    keys = classes.select("cls", "n", F.posexplode(F.concat("u", "v")).alias("at", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1").select("key")
    one, two = F.col("at") < COLLECTION, F.struct("at", "key")
    met = keys.join(shared, "key").groupBy("cls", "n").agg(F.collect_list(F.when(one, two)).alias("u"), F.collect_list(F.when(~one, two)).alias("v"))
    cells = met.select("cls", "n", "v", F.explode("u").alias("one")).select("cls", "n", "one", F.explode("v").alias("two"))
    return scratch.keep(cells.select(F.xxhash64("one.at", "two.at", "one.key", "two.key").alias("cell"), "cls", "n"))


def _members(cells: DataFrame) -> DataFrame:
    """first, cls, n: the bucket of each set that is first in a cell of two or more, with all sets of its cells.

    Cells that one set is first in hold much the same sets, so a set is in far fewer buckets than cells; and two sets of
    a cell are together in the bucket of its first.
    """
    first = cells.groupBy("cell").agg(F.min("cls").alias("first"), F.count("*").alias("sets")).where("sets > 1")
    return cells.join(first, "cell").select("first", "cls", "n").distinct()


def _full_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """cls, own: the shingle sets of the classes in rows (row, cls), from one document each."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(rows.select("row"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column(0).to_numpy())))
            for texts in tb.slices(batch.column(1)):
                h, ptr = shingles(tb.words(texts, _RULE))
                own = [np.unique(h[ptr[i] : ptr[i + 1]]) for i in range(len(texts))]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(tb.signed(np.concatenate(own))))
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(x) for x in own], pa.binary()), lists], names=["cls", "own"])

    made = docs.select("row", "text").mapInArrow(run, "cls binary, own array<long>")
    return made.join(rows.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _blocks(size: str, shingles_: str) -> Column:
    """How many blocks a bucket of so many sets and shingles is cut into."""
    return F.ceil(F.greatest(F.col(size) / BLOCK, F.col(shingles_) / BLOCK_SHINGLES)).cast("int").alias("blocks")


def _stars(members: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between the sets and the smallest first set of their cells: one comparison for each set.

    A large group of near copies has one first set in most cells, so these join most of it.  The first set goes to each
    block of its bucket.
    """
    arms = members.where("first < cls").groupBy("cls", "n").agg(F.min("first").alias("first"))
    blocks = arms.groupBy("first").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).select("first", _blocks("sets", "total"))
    arms = arms.join(blocks, "first").select("first", "cls", F.lit(1).alias("rank"), F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("part"))
    hubs = blocks.select("first", F.col("first").alias("cls"), F.lit(0).alias("rank"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    rows = arms.union(hubs).join(full, "cls")
    dealt = rows.select(F.xxhash64("first").alias("bucket"), F.col("part").alias("lo"), F.col("part").alias("hi"), "part", "rank", F.col("cls").alias("grp"), "own")
    return _compared(dealt, lambda t: t.hub_pairs())


def _across(members: DataFrame, groups: DataFrame, full: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between groups, from all pairs of sets that share a bucket and aren't in one group yet.

    Buckets of one group are left out.  A large bucket is cut into blocks by a hash of the set, and a set goes to each
    pair of blocks that its own belongs to, so tasks share the comparisons and hold two blocks at once.
    """
    label = scratch.keep(members.join(groups, F.col("cls") == F.col("node"), "left").select("first", "cls", "n", F.coalesce("component", "cls").alias("grp")))
    key = F.xxhash64("grp")
    mixed = label.groupBy("first").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("sets"), F.sum("n").alias("total")).where("low < high")
    mixed = scratch.keep(mixed.select("first", "sets", _blocks("sets", "total")))
    own = join_sized(label, mixed, "first", "sets").where("blocks > 0").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = own.select(F.xxhash64("first").alias("bucket"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cls", "grp")
    dealt = rows.join(full, "cls").select("bucket", "lo", "hi", "part", F.lit(0).alias("rank"), "grp", "own")
    return _compared(dealt, lambda t: t.likely_pairs())


class _Blocks:
    """Rows of whole blocks as arrays: their sets, groups, and which rows share a pair of blocks."""

    def __init__(self, table: pa.Table):
        self.bucket, self.lo, self.hi, self.part = (table[c].to_numpy() for c in ("bucket", "lo", "hi", "part"))
        self.names = table["grp"].to_pylist()
        self.group = np.unique(np.frombuffer(b"".join(self.names), dtype="V16"), return_inverse=True)[1]
        own = table["own"].combine_chunks()
        self.ptr = own.offsets.to_numpy().astype(np.int64) - own.offsets[0].as_py()
        self.values = own.flatten().to_numpy().view(np.uint64)
        self.n = np.diff(self.ptr)
        self.begins = np.concatenate([[True], _new(self.bucket, self.lo, self.hi)])
        self.start = np.flatnonzero(self.begins)[np.cumsum(self.begins) - 1]

    def hub_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row with the first of its block, which has rank 0."""
        y = np.flatnonzero(~self.begins)
        x = self.start[y]
        near = self._near_sizes(x, y)
        return x[near], y[near]

    def likely_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows of a pair of blocks, in different groups, whose sizes and sketches allow a link; likelier first."""
        sketch = self._sketches()
        rank = np.arange(len(self.start)) - self.start
        order = np.argsort(-rank, kind="stable")
        over = np.searchsorted(-rank[order], -np.arange(rank.max() + 2), side="right")
        found: list[tuple[np.ndarray, ...]] = [(order[:0], order[:0], np.zeros(0))]
        for i in range(1, int(rank.max()) + 1):
            for y in np.array_split(order[: over[i]], over[i] // 20_000 + 1):
                x = y - i
                fits = (self.group[x] != self.group[y]) & ((self.lo[y] == self.hi[y]) | (self.part[x] != self.part[y])) & self._near_sizes(x, y)
                x, y = x[fits], y[fits]
                if len(x):
                    a, b = sketch[x], sketch[y]
                    filled = ((a | b) > 0).sum(axis=1)
                    same = ((a == b) & (a > 0)).sum(axis=1)
                    ok = same >= _AGREE[filled]
                    if ok.any():
                        found.append((x[ok], y[ok], same[ok] / filled[ok]))
        x, y, like = (np.concatenate(f) for f in zip(*found, strict=True))
        best = np.argsort(-like, kind="stable")
        return x[best], y[best]

    def _near_sizes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(self.n[x], self.n[y]) >= LINK * np.maximum(self.n[x], self.n[y])

    def _sketches(self) -> np.ndarray:
        """A byte for each bin of hashes: of the least one in it, 0 if there is none."""
        row = np.repeat(np.arange(len(self.n)), self.n)
        slot = row * BINS + (self.values >> np.uint64(57)).astype(np.int64)
        first = np.concatenate([[True], slot[1:] != slot[:-1]])  # sets are sorted
        out = np.zeros(len(self.n) * BINS, dtype=np.uint8)
        out[slot[first]] = (self.values[first] % np.uint64(255)).astype(np.uint8) + 1
        return out.reshape(-1, BINS)

    def links(self, x: np.ndarray, y: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links between groups among the pairs, confirmed on the full sets; pairs that earlier links joined are left out."""
        if not len(x):
            return []
        root, out = np.arange(self.group.max() + 1), []
        token = np.unique(self.values, return_inverse=True)[1]
        mark = np.zeros(token.max() + 1, dtype=bool)
        for begin in range(0, len(x), ROUND):
            a, b = x[begin : begin + ROUND], y[begin : begin + ROUND]
            apart = root[self.group[a]] != root[self.group[b]]
            a, b = a[apart], b[apart]
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            # pairs of one set follow each other; GATHERED shingles at most (one set at least) are looked up at once
            cut = np.cumsum(self.n[b]) // GATHERED
            ends = np.concatenate([[0], np.flatnonzero(_new(a, cut)) + 1, [len(a)]]) if len(a) else []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                i, others = a[lo], b[lo:hi]
                mine = token[self.ptr[i] : self.ptr[i + 1]]
                mark[mine] = True
                told = mark[np.concatenate([token[self.ptr[j] : self.ptr[j + 1]] for j in others])]
                mark[mine] = False
                common = np.add.reduceat(told.astype(np.int64), np.cumsum(self.n[others]) - self.n[others])
                for j in others[100 * common >= LINK * (len(mine) + self.n[others] - common)]:
                    g, h = root[self.group[i]], root[self.group[j]]
                    if g != h:
                        root[root == h] = g
                        out.append((self.names[i], self.names[j]))
        return out


def _compared(dealt: DataFrame, pairs: Callable[[_Blocks], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links (a, b) of the pairs that meet in rows dealt by bucket, lo and hi; a task holds a few blocks with their sets."""
    by = ("bucket", "lo", "hi")

    def compare(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(pa.Table.from_batches(batches).combine_chunks())
        found = blocks.links(*pairs(blocks))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            begins = np.flatnonzero(_new(*(batch.column(c).to_numpy() for c in by))) + 1
            if rest and any(rest[-1].column(c)[len(rest[-1]) - 1] != batch.column(c)[0] for c in by):
                begins = np.concatenate([[0], begins])
            sizes = np.diff(batch.column("own").offsets.to_numpy())
            done = 0
            for begin in begins:
                held += int(sizes[done:begin].sum()) + ROW * (begin - done)
                if begin > done:
                    rest.append(batch.slice(done, begin - done))
                    done = begin
                if held >= GATHERED:
                    yield from compare(rest)
                    rest, held = [], 0
            rest.append(batch.slice(done))
            held += int(sizes[done:].sum()) + ROW * (len(batch) - done)
        if rest:
            yield from compare(rest)

    return dealt.repartition(partitions(dealt.sparkSession), *by).sortWithinPartitions(*by, "rank").mapInArrow(run, "a binary, b binary")


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether each row but the first has other keys than the row before."""
    return np.any([k[1:] != k[:-1] for k in keys], axis=0)


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Groups of documents that chains of near-duplicate links join.

    docs: doc_id and the text column.  Returns doc_id, n_shingles, component_id (smallest doc_id of the group) and kept
    (doc_id is component_id), a row for each row of docs.  Words are runs without blanks and the control characters 9 to
    13, A-Z lower-cased; a set is the distinct runs of SHINGLE words, all words of a text with fewer.  Sets are linked
    when 100 times their intersection reaches LINK times their union.

    Documents of equal sets are one class from the start, so copies cost one row each and no pairs.  Classes meet in
    tables whose keys combine a key of either of two small collections of minhashes: 144 tables for 48 minhashes, which
    miss a pair at the threshold with a chance of 1e-4 and likelier pairs with less.  Cells are gathered by their first
    set into buckets.  The full sets of the classes that met, which a second pass makes from one document each, are dealt
    by bucket: first each class is held against one first set, then every two of a bucket that are in different groups
    are compared, by sketches and then on the full sets.  Pairs live and end inside the tasks, which return only links
    that join groups, so what is written grows with the sets and not with the pairs.

    Null and empty texts, and texts without words, have the empty set and are their own group.  Rows of one doc_id are
    judged by their own texts; a null doc_id never names a group that has an id.  Rows without one in a group of their
    own have a null component and are kept.  Other columns, whatever their names, are not looked at.  An empty table
    gives an empty one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("row", F.xxhash64("doc_id", "text"))
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.keep(_signatures(source))
        classes = scratch.keep(signed.where("n > 0").select("cls", "n", "row", "u", "v").dropDuplicates(["cls"]))
        members = scratch.keep(_members(_cells(classes.select("cls", "n", "u", "v"), scratch)))
        needed = scratch.keep(classes.select("cls", "row").join(members.select("cls").distinct(), "cls", "left_semi"))
        full = scratch.keep(_full_sets(source, needed))
        groups = connected_components(_stars(members, full), scratch)
        more = connected_components(_across(members, groups, full, scratch), scratch)
        # a group's final name: what its own group of the second links is called
        named = groups.withColumnRenamed("component", "old").join(more.withColumnRenamed("node", "old"), "old", "left").select("node", F.coalesce("component", "old").alias("component"))
        named = scratch.keep(named.union(more.join(groups, "node", "left_anti").select("node", "component")))
        seen = materialise(signed.select("doc_id", F.col("n").alias("n_shingles"), "cls"))
        sizes = scratch.keep(seen.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows")))
        sizes = scratch.keep(sizes.join(named, F.col("cls") == F.col("node"), "left").select("cls", "own", "rows", F.coalesce("component", "cls").alias("grp")))
        least = scratch.keep(sizes.groupBy("grp").agg(F.min("own").alias("least"), F.sum("rows").alias("rows"), F.count("*").alias("classes")).where("rows > 1"))
        least = materialise(join_sized(sizes.drop("own"), least.drop("rows"), "grp", "classes").where("least is not null").select("cls", "rows", "least"))
    out = join_sized(seen.where("n_shingles > 0"), least, "cls", "rows").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    out = out.union(seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
