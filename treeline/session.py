"""Session defaults and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_written: list[str] = []


def get_spark(app: str = "treeline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and, when run locally, few shuffle partitions."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="treeline-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return "file://" + _local_folder


def materialise(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table into the shared folder, in one folder for each value of the columns `by`, and read it back.

    The lineage ends at the written files, so a lost executor costs a re-read and never a recomputation, and everything
    that is read more than once (or whose ids must not change between two readings) is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/treeline-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession) -> int:
    """Delete all tables that this process has written into the shared folder, once no result needs them any more."""
    jvm = spark._jvm
    dropped = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
