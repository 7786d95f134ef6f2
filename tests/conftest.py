import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuscope import session  # noqa: E402
from corpuscope.functions import text as tx  # noqa: E402
from corpuscope.sources import files as fl  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield session.configure(spark)
    spark.stop()


@pytest.fixture()
def make_files(spark):
    """dict path -> content to a described file table."""
    from pyspark.sql import functions as F

    def make(contents: dict):
        rows = spark.createDataFrame(list(contents.items()), "relative_path string, content string")
        rows = rows.withColumn("size", tx.byte_size(F.col("content"))).withColumn(
            "mtime", F.lit("2025-01-16 00:00:00").cast("timestamp"))
        return fl.described(rows)

    return make
