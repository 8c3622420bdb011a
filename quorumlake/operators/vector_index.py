"""Vector search by blocks: exact search, an inverted file of cells, and its recall.

Vectors travel in blocks, so a join meets blocks and not rows, and a task multiplies two of them at once.  Of each pair
of blocks k rows a query go on, whatever the blocks hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.sources.folders import kept
from quorumlake.sources.tables import spread

#: Chunks and queries of a block.
CHUNKS, QUERIES = 1024, 256
#: Vectors that centroids are fitted on at most; they are the only rows that the driver sees.
SAMPLE = 20_000
#: Cells at most, and rounds of fitting.
CELLS, ROUNDS = 1024, 8
#: Parts that a cell is dealt to at most, so that a cell of a third of all chunks isn't one task's.  A cell has one for each
#: full block, as each block of chunks meets each block of queries, and many small ones would meet more often.
SPREAD = 16
#: Vectors held against all centroids at once, and rows of a batch that comes of it, at most.
PIECE, ROWS = 256, 4096
#: Scores count to so many parts of one, as the exact ones do.
SCALE = 1_000_000


def blocks(rows: DataFrame, key: str, by: Sequence[str] = (), size: int = CHUNKS, parts: Column | None = None) -> DataFrame:
    """by, ids, vectors: blocks of at most size rows of the same values of by.

    rows: key, vector and the columns of by.  Rows are dealt by those values and parts of each, SPREAD where parts isn't
    given; without values they stay where they are.  Vectors are stored as 32-bit floats, as they come; rows without one
    are left out.
    """
    some = rows.where(F.col("vector").isNotNull())
    own = [*by, F.col(key).alias("id"), F.col("vector").cast("array<float>").alias("vector")]
    if by:
        part = F.pmod(F.xxhash64(key), F.lit(SPREAD) if parts is None else parts)
        some = some.select(*own, part.alias("__part")).repartition(*by, "__part").sortWithinPartitions(*by).drop("__part")
    else:
        some = some.select(*own)
    fields = {f.name: f for f in some.schema.fields}
    schema = T.StructType([*(fields[c] for c in by), T.StructField("ids", T.ArrayType(fields["id"].dataType)), T.StructField("vectors", T.BinaryType())])
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)) if width else [()] * len(batch)
            lo = 0
            while lo < len(batch):
                hi = lo + 1
                while hi < len(batch) and hi - lo < size and keys[hi] == keys[lo]:
                    hi += 1
                own = batch.column(width + 1).slice(lo, hi - lo)
                body = own.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                if len(body) % (hi - lo) or len(set(own.value_lengths().to_pylist())) > 1:
                    raise ValueError("vectors of one table must have one dimension")
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(width).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, 1) for i in range(width)), ids, pa.array([body.tobytes()], pa.binary())], names=schema.names)
                lo = hi

    return some.mapInArrow(run, schema)


def _matrix(cell: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype="<f4").reshape(rows, -1).astype(float)


def _scores(queries: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Cosines to SCALE parts, halves up; minus infinity where there is none."""
    both = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(chunks, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = queries @ chunks.T / both
    return np.where(both > 0, np.floor(cosine * SCALE + 0.5) / SCALE, -np.inf)


def best_of(met: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """by, query_id, chunk_id, score, rank: of each query the k chunks of the largest cosine, ties by chunk_id.

    met: pairs of blocks, as by, ids, vectors, query_ids, query_vectors.
    """
    fields = {f.name: f for f in met.schema.fields}
    schema = T.StructType([*(fields[c] for c in by), T.StructField("query_id", fields["query_ids"].dataType.elementType), T.StructField("chunk_id", fields["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, vectors, asked, wanted = (batch.column(width + c)[i] for c in range(4))
                ids, asked = ids.values, asked.values
                score = _scores(_matrix(wanted, len(asked)), _matrix(vectors, len(ids)))
                q, c = [], []
                for j, own in enumerate(score):
                    least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                    some = np.flatnonzero((own >= least) & (own > -np.inf))
                    if len(some) > k:
                        names = ids.take(pa.array(some)).to_pylist()
                        some = some[sorted(range(len(some)), key=lambda x: (-own[some[x]], names[x]))[:k]]
                    q += [j] * len(some)
                    c += some.tolist()
                keys = [batch.column(b).take(pa.array([i] * len(q), pa.int64())) for b in range(width)]
                yield pa.RecordBatch.from_arrays([*keys, asked.take(pa.array(q, pa.int64())), ids.take(pa.array(c, pa.int64())), pa.array(score[q, c] if q else [], pa.float64())], names=schema.names)

    some = met.select(*by, "ids", "vectors", "query_ids", "query_vectors").mapInArrow(run, schema)
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "chunk_id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(queries: DataFrame, by: Sequence[str] = (), parts: Column | None = None) -> DataFrame:
    return blocks(queries, "query_id", by, QUERIES, parts).withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"})


def exact(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """the k chunks most like each query by cosine, ties by id, from all chunks, however many queries there are.

    queries: query_id, vector: a stated set; chunks: chunk_id, vector.  Every block of chunks meets every block of
    queries.  Vectors of length 0 and null ones have no cosine and are never found.  Empty tables give no rows.
    """
    # pairs of blocks are long rows, and a batch of them is as long as a task has pairs: blocks are dealt to many tasks
    return best_of(spread(blocks(chunks, "chunk_id")).crossJoin(_asked(queries)), k)


def fitted_centroids(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Directions of cells, fitted on the ``sample`` vectors whose ids hash smallest; as many cells as the root of all
    rows, CELLS at most, where cells isn't given."""
    some = chunks.where(F.col("vector").isNotNull()).select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))
    if cells is None:
        cells = int(min(CELLS, max(1, round(some.count() ** 0.5))))
    rows = some.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).collect()
    points = np.array([r.vector for r in rows], dtype=float)
    points = points[np.linalg.norm(points, axis=1) > 0] if len(points) else np.zeros((0, 1))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids = points[: max(cells, 1)]  # hashes are in no order that vectors know
    for _ in range(ROUNDS):
        if not len(points):
            break
        label = (points @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, label, points)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(length > 0, total / np.maximum(length, 1e-12), centroids)
    return centroids


def _unit(vectors: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, or of 0 where they have none, and which those are."""
    if len(centroids) and set(vectors.value_lengths().to_pylist()) - {centroids.shape[1]}:
        raise ValueError(f"the index has vectors of {centroids.shape[1]} numbers")
    own = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    length = np.linalg.norm(own, axis=1)
    return own / np.maximum(length, 1e-300)[:, None], length == 0


def _near(rows: DataFrame, centroids: np.ndarray, key: str, probes: int = 1) -> DataFrame:
    """key, vector, cells, likeness: each row once, with the ``probes`` nearest cells; vectors of length 0 have cell -1."""
    schema = T.StructType([rows.schema[key], T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("likeness", T.ArrayType(T.DoubleType()))])
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # CELLS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, PIECE) for b in batches for lo in range(0, len(b), PIECE)):
            unit, none = _unit(batch.column(1), shared.value)
            like = unit @ shared.value.T if len(shared.value) else np.zeros((len(batch), 0))
            near = np.argsort(-like, axis=1, kind="stable")[:, :probes]
            cells = [[-1] if z else c for z, c in zip(none, near.tolist(), strict=True)]
            likeness = [[1.0] if z else x for z, x in zip(none, np.take_along_axis(like, near, axis=1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32())), pa.array(likeness, pa.list_(pa.float64()))], names=schema.names)

    return rows.where(F.col("vector").isNotNull()).select(key, F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, schema)


def _each_cell(near: DataFrame, key: str) -> DataFrame:
    """cell, key, vector, likeness: a row for each cell of what _near() found."""
    return near.select(key, "vector", F.explode(F.arrays_zip("cells", "likeness")).alias("x")).select(F.col("x.cells").alias("cell"), key, "vector", "x.likeness")


def _open_cells(asked: DataFrame, centroids: np.ndarray, least: np.ndarray) -> DataFrame:
    """cell, query_id, vector: the cells that may hold a chunk of a score of kth or more, but for those in cells.

    asked: query_id, vector, cells, kth (null: every cell may).  Two bounds close a cell.  Its chunks are at most as far
    from its centroid as the farthest one, so by the triangle inequality of angles their cosines with a query have a bound.
    And they are no nearer to the query's nearest centroid than to their own, so a query is at least as far from them as
    from the plane between the two centroids.
    """
    schema = T.StructType([T.StructField("cell", T.IntegerType()), asked.schema["query_id"], T.StructField("vector", T.ArrayType(T.FloatType()))])
    shared = asked.sparkSession.sparkContext.broadcast((centroids, least))  # CELLS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, own = shared.value
        square = (middle**2).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * middle @ middle.T, 0))
        angle = lambda c: np.arccos(np.clip(c, -1, 1))
        for batch in (b.slice(lo, PIECE) for b in batches for lo in range(0, len(b), PIECE)):
            unit, _ = _unit(batch.column(1), middle)
            like = unit @ middle.T
            # scores are rounded, so a chunk of the same score may be a little farther
            wanted = np.maximum(batch.column(3).fill_null(-1.0).to_numpy(zero_copy_only=False) - 2 / SCALE, -1)[:, None]
            best = like.argmax(axis=1)
            behind = like[np.arange(len(like)), best][:, None] - like
            may = (behind <= np.sqrt(2 - 2 * wanted) * apart[best] + 1 / SCALE) & (np.cos(np.maximum(angle(like) - angle(own), 0)) >= wanted) & (own <= 1.5)
            seen = batch.column(2)
            may[np.repeat(np.arange(len(like)), seen.value_lengths()), seen.flatten()] = False
            q, cell = np.nonzero(may)
            for lo in range(0, len(q), ROWS):
                take = pa.array(q[lo : lo + ROWS], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cell[lo : lo + ROWS], pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=schema.names)

    return asked.select("query_id", "vector", "cells", "kth").mapInArrow(run, schema)


@dataclass(frozen=True)
class InvertedFile:
    """An index of chunks in cells around centroids: a search reads the cells that are nearest to its queries.

    The files: blocks in a folder for each cell; ``cells``: centroid, count and least likeness of each cell; ``ids``: the
    ids' type.
    """

    spark: SparkSession
    path: str
    centroids: np.ndarray
    least: np.ndarray
    parts: DataFrame

    @classmethod
    def write(cls, chunks: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> InvertedFile:
        """Writes every chunk (chunk_id, vector) to the cell of its nearest centroid; only the centroids rest on a sample."""
        centroids = fitted_centroids(chunks, cells, sample)
        dealt = _each_cell(_near(chunks, centroids, "chunk_id"), "chunk_id")
        bounds = dealt.groupBy("cell").agg(F.min("likeness").alias("least"), F.count("*").alias("n"))
        rows = chunks.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        rows.join(bounds, "cell", "full").write.parquet(f"{path}/cells")
        chunks.select("chunk_id").limit(0).write.parquet(f"{path}/ids")  # an index of nothing has no block that tells their type
        index = cls.open(chunks.sparkSession, path)
        blocks(dealt.join(F.broadcast(index.parts), "cell"), "chunk_id", ["cell"], parts=F.col("parts")).write.partitionBy("cell").parquet(f"{path}/blocks")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedFile:
        cells = spark.read.parquet(f"{path}/cells")
        rows = sorted(cells.where("cell >= 0").collect(), key=lambda r: r.cell)  # CELLS at most
        parts = cells.where("n IS NOT NULL").select("cell", F.least(F.lit(SPREAD), F.ceil(F.col("n") / CHUNKS)).cast("int").alias("parts"))
        return cls(spark, path, np.array([r.centroid for r in rows], dtype=float) if rows else np.zeros((0, 1)), np.array([2.0 if r.least is None else r.least for r in rows]), parts)

    def size(self) -> int:
        return self.spark.read.parquet(f"{self.path}/cells").agg(F.sum("n")).first()[0] or 0

    def _blocks(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/ids").schema["chunk_id"].dataType
        schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()), T.StructField("cell", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/blocks").select("cell", "ids", "vectors")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best chunks of the ``probes`` nearest cells, by exact cosines."""
        return self._in(_each_cell(_near(queries, self.centroids, "query_id", probes), "query_id").where("cell >= 0"), k)

    def search_all(self, queries: DataFrame, k: int = 5, probes: int = 8) -> DataFrame:
        """As search(), and then every other cell that may hold a better chunk than the k-th found: the exact result.

        Queries and what is found first are kept in a shared folder, so queries are embedded once.  A query goes on with
        the cells that are open to it alone.
        """
        asked = kept(_near(queries, self.centroids, "query_id", probes)).where(F.get("cells", F.lit(0)) >= 0)
        first = kept(self._in(_each_cell(asked, "query_id"), k))
        kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        more = self._in(_open_cells(asked.join(kth, "query_id", "left"), self.centroids, self.least), k)
        both = first.union(more).drop("rank")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _in(self, asked: DataFrame, k: int) -> DataFrame:
        # each part of a cell's chunks meets all that is asked of the cell; what is asked of cells without chunks has no parts
        parts = F.broadcast(self.parts)
        own = self._blocks().join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
        met = _asked(asked.join(parts, "cell"), ["cell"], F.col("parts")).join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return best_of(own.join(met, ["cell", "part"]), k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, n (wanted chunks), hits (of those found)."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return wanted.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


def probes_for(index: InvertedFile, queries: DataFrame, chunks: DataFrame, k: int = 5, target: float = 0.95, sample: int = 200) -> int:
    """The smallest power of two of probes (all cells at most) whose recall on a bounded sample of queries reaches target."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    wanted = exact(some, chunks, k).cache()
    probes = 1
    while probes < len(index.centroids):
        n, hits = recall(index.search(some, k, probes), wanted).agg(F.sum("n"), F.sum("hits")).first()
        if not n or hits >= target * n:
            break
        probes *= 2
    wanted.unpersist()
    return min(probes, max(1, len(index.centroids)))
