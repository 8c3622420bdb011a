"""Folders that driver and executors share, for what a query must keep between its steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir; where that isn't set, in a local session alone, below the temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quorumlake-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quorumlake-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written to a shared folder and read again: what several steps use is computed once."""
    path = shared(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
