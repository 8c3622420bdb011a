"""Centroid clustering of vectors of whole numbers, filtered by ball trees that each part of the table keeps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.shared import Scratch, materialise

#: Components of a vector, and the factor before they are rounded down.
SIZE, SCALE = 64, 64
#: Components beyond it count as it, so that squared distances stay 64-bit whole numbers.
LIMIT = 1 << 27
#: Vectors of a tree, and of a leaf.
TREE, LEAF = 2048, 32
#: Below it sums of 64 products of components are exact as doubles.
EXACT = 1 << 22

_TREE = "ids array<long>, points binary, first array<int>, last array<int>, left array<int>, radius array<double>, sums binary"


@dataclass(frozen=True)
class Tree:
    """Balls over the vectors first to last of a part: radius, count (last - first) and sum; left is the first child (the
    second follows it), -1 of a leaf."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order that it puts the vectors in."""
        order = np.arange(len(points))
        first, last, left, radius, sums = [0], [len(points)], [-1], [], []
        node = 0
        while node < len(first):
            lo, hi = first[node], last[node]
            own = points[order[lo:hi]]
            sums.append(own.sum(axis=0))
            away = _away(own, sums[-1] / (hi - lo))
            radius.append(float(away.max()))
            if hi - lo > LEAF and radius[-1] > 0:
                one = own[away.argmax()]
                along = own.astype(float) @ (own[_away(own, one).argmax()] - one).astype(float)
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(along, half)]
                left[node] = len(first)
                first += [lo, lo + half]
                last += [lo + half, hi]
                left += [-1, -1]
            node += 1
        return cls(points[order], *(np.array(x) for x in (first, last, left, radius, sums))), order

    def assign(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
        """first, last, labels, sum: parts of the vectors with the numbers of their nearest centroids.

        A ball whose vectors are all nearer to one centroid than to any other has one label, and its stored sum; sum is
        None for leaves that had to be looked at vector by vector.  A centroid that is too far for a ball is too far for
        the balls inside it.
        """
        nodes, open_ = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
        middle = self.sums / (self.last - self.first)[:, None]
        while len(nodes):
            far = np.sqrt(((middle[nodes][:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))
            far[~open_] = np.inf
            nearest = far.argmin(axis=1)
            reach = self.radius[nodes]
            bound = far[np.arange(len(nodes)), nearest] + 2 * reach
            open_ &= far <= (bound + 1e-9 * (1 + bound))[:, None]  # more than double arithmetic can be off
            whole = open_.sum(axis=1) == 1
            for i in np.flatnonzero(whole):
                yield self.first[nodes[i]], self.last[nodes[i]], int(nearest[i]), self.sums[nodes[i]]
            leaf = ~whole & (self.left[nodes] < 0)
            for i in np.flatnonzero(leaf):
                lo, hi, some = self.first[nodes[i]], self.last[nodes[i]], np.flatnonzero(open_[i])
                yield lo, hi, some[distances(self.points[lo:hi], centroids[some]).argmin(axis=1)], None
            down = ~whole & ~leaf
            nodes = (self.left[nodes[down]][:, None] + np.arange(2)).reshape(-1)
            open_ = np.repeat(open_[down], 2, axis=0)


def _away(points: np.ndarray, from_: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - from_).astype(float) ** 2).sum(axis=1))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point to each centroid."""
    largest = max(abs(int(x)) for a in (points, centroids) if a.size for x in (a.min(), a.max()))
    if largest < EXACT:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, point: the vectors of exactly SIZE components, none null or not finite, as whole numbers."""
    own = F.col(vector).cast("array<double>")
    fine: Column = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    point = F.transform(own, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))
    kept = vectors.where((F.size(own) == SIZE) & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), point.cast("array<long>").alias("point"))


def build_trees(points: DataFrame) -> DataFrame:
    """A row for each TREE vectors of a partition: their ball tree.  No vector leaves its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            for lo in range(0, len(batch), TREE):
                part = batch.slice(lo, TREE)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy().reshape(-1, SIZE))
                while len(ids) >= TREE:
                    every = np.concatenate(held)
                    yield _row(ids[:TREE], every[:TREE])
                    ids, held = ids[TREE:], [every[TREE:]]
        if ids:
            yield _row(ids, np.concatenate(held))

    return points.mapInArrow(run, _TREE)


def _row(ids: list[int | None], points: np.ndarray) -> pa.RecordBatch:
    tree, order = Tree.of(points)
    lists = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in ((tree.first, pa.int32()), (tree.last, pa.int32()), (tree.left, pa.int32()), (tree.radius, pa.float64()))]
    names = ["ids", "points", "first", "last", "left", "radius", "sums"]
    return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([tree.points.astype("<i4").tobytes()], pa.binary()), *lists, pa.array([tree.sums.astype("<i8").tobytes()], pa.binary())], names=names)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(len(batch)):
            ids, points, first, last, left, radius, sums = (batch.column(c)[i] for c in range(7))
            yield ids.values, Tree(
                np.frombuffer(points.as_py(), dtype="<i4").astype(np.int64).reshape(-1, SIZE), *(x.values.to_numpy() for x in (first, last, left, radius)), np.frombuffer(sums.as_py(), dtype="<i8").reshape(-1, SIZE)
            )


def cluster_sums(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the vectors nearest to each centroid; a task passes on one row a centroid and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), SIZE), dtype=np.int64)
        for _, tree in _trees(batches):
            for lo, hi, label, sums in tree.assign(centroids):
                if sums is not None:
                    count[label] += hi - lo
                    total[label] += sums
                else:
                    np.add.at(count, label, 1)
                    np.add.at(total, label, tree.points[lo:hi])
        cluster, part = np.repeat(np.arange(len(centroids)), SIZE), np.tile(np.arange(SIZE), len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(np.repeat(count, SIZE)), pa.array(total.reshape(-1))], names=["cluster", "part", "n", "total"])

    rows = trees.mapInArrow(run, "cluster int, part int, n long, total long").groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), SIZE), dtype=np.int64)
    for r in rows.collect():  # centroids by components
        count[r.cluster], total[r.cluster, r.part] = r.n, r.total
    return count, total


def nearest(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            label, far = np.zeros(len(tree.points), dtype=np.int32), np.zeros(len(tree.points), dtype=np.int64)
            for lo, hi, own, _ in tree.assign(centroids):
                label[lo:hi] = own
                far[lo:hi] = ((tree.points[lo:hi] - centroids[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """Lloyd's rounds in whole numbers, exact at any size and order of the rows.

    vectors: vec_id and the vector column.  Vectors of exactly SIZE components, none null or not finite, count, each
    component x as floor(SCALE x); beyond LIMIT it is LIMIT.  The first centroids are the k vectors of the smallest
    sha256 of seed:vec_id.  Each round assigns every vector to the nearest centroid (of ties the smaller number) and
    moves a centroid to the floor of the mean of its vectors; one without vectors stays.  Returns vec_id, cluster,
    distance (squared, to the last centroids), cluster_inertia and inertia (sums of distances, the largest long at
    most) and centroid_sha256, a row for each vector that counts.

    Each part of the table keeps ball trees of TREE vectors, written once: radius, count and sum of each ball.  In a
    round a ball that lies wholly nearer to one centroid gives its count and sum away unopened; others are opened down
    to leaves, which are compared exactly.  The driver has k times SIZE numbers, whatever the table's size.

    Repeated rows count again.  Rows of one vec_id or without one are told apart by their components; a null id is the
    empty string in the hash.  Fewer than k vectors give as many centroids; none, as in an empty table, give no rows.
    Other columns, whatever their names, are not looked at.
    """
    with Scratch(vectors.sparkSession) as scratch:
        points = whole_vectors(vectors, vector)
        trees = scratch.keep(build_trees(points))
        name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        start = points.orderBy(name, "point").limit(k).collect()
        if not start:
            return materialise(vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"))
        centroids = np.array([r.point for r in start], dtype=np.int64)
        for _ in range(rounds):
            count, total = cluster_sums(trees, centroids)
            centroids = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        found = materialise(nearest(trees, centroids))
    most = (1 << 63) - 1
    own = {r.cluster: int(r.far) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}
    rows = [(c, min(far, most), min(sum(own.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, far in own.items()]
    small = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
