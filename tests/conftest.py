import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle(small):
    """Runs SQL in DuckDB over the small tables."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return lambda sql: con.execute(sql).df()


def rows_of(df):
    """Rows of a pandas frame, columns by name, in any order, comparable between engines."""
    import pandas as pd

    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else round(v, 6) if isinstance(v, float) else v
    return sorted(str([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(got, wanted):
        assert sorted(got.columns) == sorted(wanted.columns)
        a, b = rows_of(got), rows_of(wanted)
        assert len(a) == len(b)
        different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        assert not different, different[:3]

    return check
