"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.llm.shared import Scratch, materialise, partitions, shared_folder

BLANK = " \t\n\v\f\r"
#: Keys of fewer code points are never dropped.
LEAST = 10
#: Batches that a table is fed in, by ascending doc_id.
BATCHES = 6
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Stands for a null doc_id, which comes after all others.
LAST_ID = (1 << 63) - 1

RUN = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("owner", T.LongType())])


def line_key(line: str) -> bytes | None:
    """16-byte digest of a line's key (blanks stripped at both ends, A-Z lower-cased); None if it is too short."""
    key = line.strip(BLANK)
    if len(key) < LEAST:
        return None
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest()  # bytes.lower() changes A-Z only


class LineRuns:
    """Line hashes seen so far with the smallest document of each, as sorted runs in levels.

    A run is a table bucketed and sorted by hash, in as many buckets as a shuffle has partitions, with one file each.  So
    a new batch, dealt by hash once, meets all runs where they lie: the anti-join moves no row of a run.  What the batch
    has of its own becomes a run of level 0; FANOUT runs of a level are merged, bucket by bucket, into one of the next,
    so a hash is rewritten a logarithmic number of times and a lookup reads at most FANOUT - 1 runs of each level.  No
    hash is in two runs.  Use in a with: its end drops the runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.scratch = Scratch(spark)

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self._drop([name for level in self.levels for name in level])
        self.scratch.__exit__()

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _read(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.union, (self.spark.table(name).select("key", "owner") for name in names))

    def seen(self) -> DataFrame:
        names = [name for level in self.levels for name in level]
        return self._read(names) if names else self.spark.createDataFrame([], RUN)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("key", "owner").repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name

    def add(self, rows: DataFrame) -> None:
        self.levels[0].append(self._write(rows))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._read(old)))
            self.levels[level] = []
            self._drop(old)
            level += 1

    def losers(self, keys: DataFrame, more: bool = True) -> DataFrame:
        """Takes in a batch (columns key, doc and any others) and returns its rows whose line has an earlier owner.

        Batches must come in order of doc for the owner to be the smallest of all; in any order, first come first kept.
        After the last batch nothing needs to be added, which more=False says.
        """
        own = keys.groupBy("key").agg(F.min("doc").alias("own"), F.count("*").alias("n"))
        met, owners = own, [F.lit(None).cast("long")]
        for i, name in enumerate(name for level in self.levels for name in level):
            met = met.join(self._read([name]).withColumnRenamed("owner", f"owner_{i}"), "key", "left")
            owners.append(F.col(f"owner_{i}"))
        met = materialise(met.select("key", "own", "n", F.coalesce(*owners).alias("owner")))
        if more:
            self.add(met.where("owner is null").select("key", F.col("own").alias("owner")))
        twice = met.where("owner is not null or n > 1").select("key", F.coalesce("owner", "own").alias("owner"))
        return keys.join(twice, "key").where("doc <> owner").select(*keys.columns)


def _keys(docs: DataFrame) -> DataFrame:
    """key, doc, row: the keys of each text, with its document and what tells rows of one document apart."""
    schema = "key binary, doc long, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, rows = [], [], []
            for doc, row, text in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                found = {line_key(x) for x in (text.as_py() or "").split("\n")} - {None}
                keys += found
                ids += [doc] * len(found)
                rows += [row] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=["key", "doc", "row"])

    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """Drops repeated lines from documents and adds n_lines (before), n_dropped and kept (the new text).

    docs: doc_id, the text column and any others, which are returned as they are; columns named like the new ones are
    replaced.  A line's key is the line without blanks at both ends, A-Z lower-cased.  Keys of LEAST code points or
    more that two documents hold lose all their lines except in the document of the smallest id.

    Null and empty texts are one empty line.  Rows of the same doc_id are one document, so they don't take lines from
    each other; rows without doc_id are one document, the last.  A line that a document repeats stays or goes as often
    as it is there.  An empty table gives an empty one.

    Data moved: 24 bytes for each line, once by hash and the repeated ones once by document, and the texts once by
    document unless the list of repeated lines is small enough for Spark to broadcast.  A line that a third of all
    documents hold is one row a task after partial aggregation; the join back is one that Spark splits.
    """
    spark = docs.sparkSession
    new = ("n_lines", "n_dropped", "kept")
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    # rows without doc_id are one document of any size: each of their texts has a list of lost lines of its own
    row = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col(text))).otherwise(F.lit(0)).cast("long")
    source = docs.select(ids.alias("doc"), row.alias("row"), F.col(text).alias("text"))
    bounds = [float(b) for b in (docs.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) or [])]
    batch = F.lit(0)
    for b in sorted(set(bounds)):
        batch = batch + (F.col("doc") > F.lit(b)).cast("int")
    place = shared_folder(spark)  # a folder for each batch, which reads no other's
    _keys(source).withColumn("batch", batch).write.partitionBy("batch").parquet(place)
    keys = spark.read.schema("key binary, doc long, row long, batch int").parquet(place)
    lost = None
    with LineRuns(spark) as runs:
        for b in range(len(set(bounds)) + 1):
            found = runs.losers(keys.where(F.col("batch") == b).select("key", "doc", "row"), more=b < len(set(bounds)))
            lost = found if lost is None else lost.union(found)
    gone = lost.groupBy("doc", "row").agg(F.collect_set("key").alias("__gone")).withColumnsRenamed({"doc": "__doc", "row": "__row"})
    keep = [c for c in docs.columns if c not in new]
    at_text = keep.index(text)
    schema = docs.select(*keep).schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    joined = docs.select(*keep, ids.alias("__id"), row.alias("__own")).join(gone, (F.col("__id") == F.col("__doc")) & (F.col("__own") == F.col("__row")), "left").select(*keep, "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for value, gone in zip(batch.column(at_text), batch.column(len(keep)), strict=True):
                parts = (value.as_py() or "").split("\n")
                left = parts
                if gone.is_valid:
                    bad = set(gone.as_py())
                    left = [x for x in parts if line_key(x) not in bad]
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
                kept.append("\n".join(left))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*keep, *new])

    return joined.mapInArrow(run, schema)
