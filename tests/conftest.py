import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("treeline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def bare_tables(spark, tmp_path_factory):
    """Folders of the project's tables without rows and with one row of NULLs."""
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables here")
    top = tmp_path_factory.mktemp("bare")
    for name in os.listdir(small):
        df = spark.read.parquet(f"{small}/{name}")
        df.limit(0).write.parquet(f"{top}/empty/{name}")
        spark.createDataFrame([tuple(None for _ in df.columns)], df.schema).write.parquet(f"{top}/nulls/{name}")
    return [f"{top}/empty", f"{top}/nulls"]
