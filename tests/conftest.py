import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gaugeworks-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def convos(spark):
    """Turns of a few conversations as one array each."""
    schema = "id BIGINT, convo ARRAY<STRUCT<role: STRING, content: STRING>>"
    rows = [
        (1, [("user", "hello"), ("assistant", "hi"), ("user", "more?")]),
        (2, [("user", "only")]),
        (3, []),
        (4, [("system", "be nice"), ("user", "a"), ("assistant", "b")]),
        (5, [("assistant", "first"), ("user", "then")]),
    ]
    return spark.createDataFrame(rows, schema)
