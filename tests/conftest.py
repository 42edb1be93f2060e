import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from logloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines of one file, in order, as a scan would give them."""

    def make(*values, file="f"):
        rows = [((file, 0, i, 0), value) for i, value in enumerate(values)]
        return spark.createDataFrame(
            rows, "arrival struct<file:string,block:bigint,row:bigint,event:int>, value string"
        ).coalesce(1)

    return make


@pytest.fixture
def utc():
    def make(*parts):
        return datetime(*parts, tzinfo=timezone.utc)

    return make
