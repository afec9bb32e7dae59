"""Intermediate tables of operators that run in rounds, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.session import shared_folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, if the session is still there to do it."""
    with contextlib.suppress(Exception):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path of its own below the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back, so later rounds neither compute it again nor need what it came from."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
