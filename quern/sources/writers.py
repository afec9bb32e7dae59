"""Sinks: JSON lines, CSV with a fixed field list, one summary object, console previews."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append JSON lines, one folder for each value of ``by``."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def append_once(df: DataFrame, path: str, batch: str, by: str | None = None) -> bool:
    """Append JSON lines as the batch of this name, once; whether this call put them there.

    Rows are written aside and moved into place by one rename, which fails if
    the batch is there: a job that fails leaves nothing that readers see, and a
    job that runs twice, even at the same time, leaves its rows once.
    """
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    aside, target = hadoop.Path(f"{path}/_aside-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/batch={batch}")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    try:
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).json(aside.toString())
        how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").NONE  # never over what is there
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(target), how)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.toString():
            raise
        return False  # another run of this batch was first
    finally:
        fs.delete(aside, True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def renamed(spark: SparkSession, path: str, old: str, new: str, prefix: str = "part") -> None:
    """Give the files that a writer left in a folder another ending, and ``prefix`` in place of ``part``."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in fs.listStatus(top):
        name = file.getPath().getName()
        if name.startswith("part-") and name.endswith(old):
            own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}{name[4:].removesuffix(old)}{new}")
            fs.rename(file.getPath(), own)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header and the given fields; missing ones are empty."""
    columns = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def summary(df: DataFrame) -> DataFrame:
    """A one-row report as one JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_summary(df: DataFrame, path: str) -> None:
    summary(df).coalesce(1).write.mode("overwrite").text(path)


def preview_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order as (row, field, value), a row for each field that is not null."""
    first = df.orderBy(order).limit(n)
    place = F.row_number().over(Window.orderBy(order)) - 1  # n rows
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return first.withColumn("row", place).select("row", F.explode(fields).alias("f")).select("row", "f.*").where("value is not null")


def preview(df: DataFrame, n: int = 5) -> None:
    df.show(n, truncate=False, vertical=True)


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters and a note of how many are left out."""
    return F.when(
        F.length(text) > n,
        F.concat(F.left(text, F.lit(n)), F.lit("... ["), (F.length(text) - n).cast("string"), F.lit(" more chars]")),
    ).otherwise(text)
