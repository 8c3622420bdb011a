"""A caller's own function on each document: typed results, errors in a table of their own, and restart where a run broke off."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Parts of a run; each is written for itself, so a run that breaks off loses the part it was in.
PARTS = 8
#: Characters of an error's message that are kept.
MESSAGE = 1000


@dataclass(frozen=True)
class Processed:
    """Where a run writes; reading takes whole parts only."""

    spark: SparkSession
    folder: str
    key: str

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/part-*")

    def results(self) -> DataFrame:
        """key and the function's fields: a row for each result, none for a document that gave none."""
        return self._rows().where("error IS NULL").select(self.key, F.explode("results").alias("r")).select(self.key, "r.*")

    def errors(self) -> DataFrame:
        """key, kind, message of each document whose function raised."""
        return self._rows().where("error IS NOT NULL").select(self.key, "error.kind", "error.message")

    def done(self) -> DataFrame:
        return self._rows().select(self.key)


def _finished(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def process(docs: DataFrame, key: str, function: Callable[[dict[str, Any]], list[dict[str, Any]]], schema: str, folder: str, parts: int = PARTS) -> Processed:
    """Calls function with each document and keeps what it returns.

    docs: key and what function reads; function returns rows of schema.  A document that makes it raise, or whose rows
    don't fit the schema, is an error of its own and stops no other.  Documents are written to ``folder`` by parts, dealt
    by a hash of the key, and each part's results as one: a part that is there is not run again, so a run that broke off is
    taken up by calling this again, and each document is processed once in what is read.  The function may be called
    twice for a document where a task is tried again, as Spark does.

    Null keys are a document each; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    fields = spark.createDataFrame([], schema).schema
    error = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
    out = T.StructType([docs.schema[key], T.StructField("results", T.ArrayType(fields)), T.StructField("error", error)])
    rows_type, error_type = (to_arrow_schema(out).field(i).type for i in (1, 2))
    at = docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, failed = [], []
            for row in batch.to_pylist():
                try:
                    own = pa.array([list(function(row))], rows_type)
                    found.append(own)
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  any error of the caller's function is the document's
                    found.append(pa.array([None], rows_type))
                    failed.append({"kind": type(e).__name__, "message": str(e)[:MESSAGE]})
            results = pa.concat_arrays(found) if found else pa.array([], rows_type)
            yield pa.RecordBatch.from_arrays([batch.column(at), results, pa.array(failed, error_type)], names=[key, "results", "error"])

    if not _finished(spark, f"{folder}/input"):
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts))
        docs.withColumn("__part", part).write.mode("overwrite").partitionBy("__part").parquet(f"{folder}/input")
    for i in range(parts):
        if not _finished(spark, f"{folder}/part-{i:04d}"):
            own = spark.read.schema(docs.schema.add("__part", "long")).parquet(f"{folder}/input").where(F.col("__part") == i).drop("__part")
            own.mapInArrow(run, out).write.mode("overwrite").parquet(f"{folder}/part-{i:04d}")
    return Processed(spark, folder, key)
