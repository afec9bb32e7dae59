"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again, so a lost executor costs a re-read and no recomputation of
earlier passes.  Results are read from these tables when they are used, so a
run's folder goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.session import shared_folder, ship

class Scratch:
    """The tables of one run of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark = ship(spark)
        self.folder = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def remove(self) -> None:
        """Delete all tables, if the session is still there to do it."""
        with contextlib.suppress(Exception):
            self.drop("")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return what reads it back."""
        path = f"{self.folder}/{name}"
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go once the table is there
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(clean, before)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
        """``df`` in ``buckets`` by ``key``, by default as many as a shuffle has parts, so that grouping and joining by it shuffle only the other side.

        The catalog is told of the buckets and forgets them again; the files stay until they are dropped.
        """
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
        n, as_table = min(buckets or parts(self.spark), most), f"quern_{name}_{uuid.uuid4().hex}"
        dealt = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd")
        dealt.option("path", f"{self.folder}/{name}").saveAsTable(as_table)
        release(self.spark)
        try:
            return self.spark.table(as_table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {as_table}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner find the shuffle files of plans that are done."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
