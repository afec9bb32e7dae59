"""Scans: tables, JSON lines (strict and lenient), JSON documents of several layouts, benchmark samples, generations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.jsons import SAMPLE_KEYS
from quern.session import ship


def table(spark: SparkSession, name: str, kind: str = "parquet", split: str | None = None) -> DataFrame:
    """A named data set; a split is a sub-folder or a ``split`` column of a catalog table."""
    if kind == "table":
        df = spark.table(name)
        return df.where(F.col("split") == split) if split else df
    return spark.read.format(kind).load(f"{name.rstrip('/')}/{split}" if split else name)


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, event: str | None = None) -> DataFrame:
    """Strict JSON lines: a bad line fails the query; ``event`` keeps one kind of record."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.where(F.col("event") == event) if event else df


def with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def numbered_lines(spark: SparkSession, path: str | list[str], as_one: bool = False, **options: bool) -> DataFrame:
    """source_file, line_number (from 1), line of all lines that are not blank.

    Files are split as any text is: a line's number is its place in its split
    plus the lines of the file's splits before, of which only counts are joined.
    ``as_one`` numbers the files of a folder through, by name, as parts of one.
    """
    at = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "source_file"), ("file_block_start", "block"))]
    lines = spark.read.options(**options).text(path).select(*at, F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    counts = lines.groupBy("source_file", "block").agg(F.min("m").alias("first"), F.count("*").alias("lines"))
    whole = F.regexp_extract("source_file", "^(.*)/", 1) if as_one else F.col("source_file")
    before = Window.partitionBy(whole).orderBy("source_file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("source_file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    number = F.col("base") + F.col("m") - F.col("first") + 1
    return lines.where(F.trim("line") != "").join(bases, ["source_file", "block"]).select(
        "source_file",
        number.alias("line_number"),
        "line",
    )


def _is_sample(x: dict) -> bool:
    return any(k in x for k in SAMPLE_KEYS)


def _of_document(doc) -> list[dict]:
    if isinstance(doc, list):
        return [x for x in doc if isinstance(x, dict)]
    if not isinstance(doc, dict):
        return []
    samples = doc.get("samples")
    if isinstance(samples, list):
        return [x for x in samples if isinstance(x, dict)]
    if isinstance(samples, dict):
        return [x for v in samples.values() if isinstance(v, list) for x in v if isinstance(x, dict)]
    inside = [x for v in doc.values() if isinstance(v, list) for x in v if isinstance(x, dict) and _is_sample(x)]
    return inside or ([doc] if _is_sample(doc) else [])


def _parsed(line: str):
    try:
        return json.loads(line)
    except ValueError:
        return None


def samples(spark: SparkSession, path: str) -> DataFrame:
    """source_file, n, record (JSON text) of all samples below a path.

    JSON-line files are read by lines, in splits, and give every object that
    parses, numbered by its line; JSON files are read whole, in all known
    layouts, and their samples numbered from 0.  Order by (not samples_first,
    source_file, n) for the order that puts files named after samples first.
    """
    ship(spark)
    kind = "source_file string, n long, record string, samples_first boolean"

    def run(objects):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (name, n, json.dumps(x, ensure_ascii=False), "samples" in name.rsplit("/", 1)[-1].lower())
                    for name, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for n, x in objects(number, text)
                ]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                types = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
                names = ["source_file", "n", "record", "samples_first"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return each

    def of_line(number: int, line: str) -> list[tuple[int, dict]]:
        return [(number, x)] if isinstance(x := _parsed(line), dict) else []

    def of_file(_: int, text: str) -> list[tuple[int, dict]]:
        return list(enumerate(_of_document(_parsed(text or ""))))

    lines = numbered_lines(spark, path, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    whole = whole.select(F.col("_metadata.file_path").alias("source_file"), F.lit(0).cast("long").alias("line_number"), "value")
    return lines.mapInArrow(run(of_line), kind).unionByName(whole.mapInArrow(run(of_file), kind))


def benchmark_samples(df: DataFrame, path: str, index: Column) -> DataFrame:
    """example_id, prompt, answer of either layout, told apart by the path; ``index`` numbers the rows from 0."""
    if "aime" in path.lower() or "prompt" in df.columns and dict(df.dtypes)["prompt"].startswith("array"):
        prompt, answer = F.col("prompt")[0]["content"], F.col("reward_model")["ground_truth"]
    else:
        prompt, answer = F.col("problem"), F.col("answer")
    return df.select(index.cast("long").alias("example_id"), prompt.alias("prompt"), answer.cast("string").alias("answer"))


def file_parameters(name: Column) -> dict[str, Column]:
    """Task, temperature, top-p, samples and length from a file name such as ``aime_t0.7_p0.9_n16-MNT1024.jsonl``."""
    get = lambda pattern, kind: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast(kind)
    return {
        "task": F.split_part(name, F.lit("_"), F.lit(1)),
        "temperature": get(r"_t([0-9.]+)", "double"),
        "top_p": get(r"_p([0-9.]+)", "double"),
        "n": get(r"_n([0-9]+)", "int"),
        "max_new_tokens": get(r"MNT([0-9]+)", "int"),
    }


def checkpoints(names: DataFrame, minimum: int = 0, column: str = "name") -> DataFrame:
    """name, step of folders ``checkpoint-<step>`` from a minimum on, by step."""
    step = F.try_to_number(F.regexp_extract(column, r"^checkpoint-(\d+)$", 1), F.lit("999999999999")).cast("long")
    return names.select(F.col(column).alias("name"), step.alias("step")).where((F.col("step") >= minimum)).orderBy("step")


def latest_checkpoint(names: DataFrame, column: str = "name") -> DataFrame:
    return checkpoints(names, 0, column).agg(F.max_by("name", "step").alias("name"))


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def is_checkpoint(name: str) -> bool:
    return re.fullmatch(r"checkpoint-\d+", name) is not None
