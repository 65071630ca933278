import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Whether a query and its SQL give the same rows on a folder of tables."""
    import duckdb

    def run(query, sql: str, folder: str) -> None:
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        ours, theirs = query(spark, folder).toPandas(), con.execute(sql).fetchdf()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert _rows(ours) == _rows(theirs)

    return run


def _rows(frame):
    def text(x):
        if x is None or x != x:
            return None
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted((tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)
