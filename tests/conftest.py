"""One Spark session for all tests."""

import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.local.dir", f"{home}/local").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
