"""What the operators of this subpackage share: places to cut lineage, and components of a graph."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new name below the folder that driver and executors share, which spark.checkpoint.dir names.

    Unset, a local session (tests, a trial) takes a temporary folder; a cluster has none that all machines see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quorumlake-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quorumlake-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by shared_folder()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of its own below the shared one for what an operator needs while it runs; the end of a with removes it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, shared_folder(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df as written to the folder and read again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)


#: join_sized() broadcasts fewer rows than this.
HOT = 1000


def join_sized(rows: DataFrame, small: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of rows with small, whose key is unique and whose column size tells how many rows hold it at least.

    Keys that hold more than a HOT-th of all that small counts are fewer than HOT, so those are broadcast and their rows
    stay where they are; only the rest is dealt by key.
    """
    total = small.agg(F.sum(size)).first()[0] or 0
    large = small.where(F.col(size) * HOT > total).drop(size)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small.where(F.col(size) * HOT <= total).drop(size), key, "left")
    return rows.join(F.broadcast(large), key).unionByName(rest)


def bitmap_of(values: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the 64-bit values of a column; of whatever size that is, the driver gets one row for each of its bytes at most."""
    value = f"`{values.columns[0]}`"
    rows = values.selectExpr(f"cast(shiftright(pmod({value}, {bits}), 3) AS int) AS byte", f"shiftleft(1, cast(pmod({value}, 8) AS int)) AS bit")
    table = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[table["byte"].to_numpy()] = table["bits"].to_numpy().astype(np.uint8)
    return out


def in_bitmap(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values % (8 * len(table))
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs without blanks and the control characters 9 to 13; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, scratch: Scratch | None = None, most_rounds: int = 40) -> DataFrame:
    """Smallest node that each node of an undirected graph reaches.

    edges: columns a, b of one orderable type; loops and repeats may occur, nulls are ignored.  Returns node, component
    for each node of an edge.  Alternates large-star and small-star steps, so paths shorten by doubling; every step is
    a join and a grouped minimum (partial minima first, and a join whose large keys Spark splits), and is written to the
    shared folder, so no executor holds state and nothing reaches the driver but three numbers a round.
    """
    if scratch is None:
        with Scratch(edges.sparkSession) as own:
            return materialise(connected_components(edges, own, most_rounds))
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = None
    for _ in range(most_rounds):
        found = now.agg(F.count("*"), F.count_distinct("v"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if not found[0] or tuple(found) == state:
            break
        state = tuple(found)
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        now = scratch.keep(small.union(low.select("v", F.col("m").alias("u"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return scratch.keep(nodes.union(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct())
