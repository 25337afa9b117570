import glob
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowsight.session import prepare  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain_value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def as_set():
    """Sorted rows of (columns, tuples) in column-name order."""

    def convert(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(plain_value(r[i]) for i in order) for r in rows), key=repr)

    return convert


@pytest.fixture(scope="session")
def plan_of():
    """Physical plan text before adaptive changes."""

    def text(df):
        return df._jdf.queryExecution().explainString(
            df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )

    return text
