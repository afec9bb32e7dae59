"""Objects of JSON documents that are larger than a task should read.

A document is read in splits, cut into fragments behind every closing brace.
Where a fragment stands follows from sums over those before it: an odd number of
quotes so far means that it begins inside a string, and the brackets outside of
strings give its depth.  An object of the list ends where the depth falls back
to that of the list; what lies between two such ends is one record, which is put
together and parsed on its own.  Sums run over ranges of each file, so no task
sees more of a file than its split, its range or one record.  Depths are summed
without the texts, which are shuffled for the quotes, to their records' numbers
and to their records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sequence import running_sums
from quern.session import ship
from quern.sources.tables import stored

#: What a document begins with, and how deep the objects of its lists lie.
LAYOUTS = {r"^\s*\[": 1, r'^\s*\{\s*"samples"\s*:\s*\[': 2, r'^\s*\{\s*"samples"\s*:\s*\{': 3}
#: How low the depth may fall, by that of the objects, before the lists are over.
FLOOR = {1: 1, 2: 2, 3: 2}
_MEASURED = "source_file string, pos long, text string, change long, lowest long, shut boolean, below1 boolean, below2 boolean"
_REST = re.compile(r'(?:[^"\\]|\\.)*(?:"|$)', re.S)
_MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{}]', re.S)


def fragments(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """source_file, pos, text: documents cut behind closing braces, which are left out; ``pos`` grows along a file."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}")
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )
    # a split has fewer fragments than bytes, so its first byte and a fragment's place in it keep the order
    firsts = rows.groupBy("source_file", "block").agg(F.min("row").alias("first"))  # a row for each split
    placed = rows.join(F.broadcast(firsts), ["source_file", "block"])
    return placed.select("source_file", (F.col("block") + F.col("row") - F.col("first") + 1).alias("pos"), "text")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with the change of depth in them, the lowest depth on the way, whether their brace is one, and
    whether they fall from the first and from the second depth, which ends a list within a document's head."""
    for batch in batches:
        out = []
        for text, inside, open_ in zip(*(batch.column(c).to_pylist() for c in ("text", "inside", "open")), strict=True):
            depth = lowest = 0
            fell = [False, False]
            steps = [(m[0] in "[{") - (m[0] in "]}") for m in _MARK.finditer(text, _REST.match(text).end() if inside else 0)]
            for step in steps if open_ else [*steps, -1]:
                depth += step
                lowest = min(lowest, depth)
                fell = [x or step < 0 and depth == k for k, x in enumerate(fell)]
            out.append((depth, lowest, not open_, *fell))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        own = [batch.column(c) for c in ("source_file", "pos", "text")]
        yield pa.RecordBatch.from_arrays([*own, *made], names=["source_file", "pos", "text", "change", "lowest", "shut", "below1", "below2"])


def _opened(text: str, depth: int, level: int) -> str | None:
    """The record's text from the brace that opens its object."""
    for mark in _MARK.finditer(text):
        if mark[0] == "{" and depth == level:
            return text[mark.start() :]
        depth += (mark[0] in "[{") - (mark[0] in "]}")
    return None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, n, text, depth, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                found = json.loads(_opened(text, depth, level) or "")
            except ValueError:
                continue
            out.append((name, n, json.dumps(found, ensure_ascii=False)))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source_file", "n", "record"])


def objects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """source_file, n (from 0, in order) and record (JSON text) of the objects in the lists of each document.

    Documents are a list, or an object whose first key is ``samples`` with a list
    or an object of nothing but lists in it; others give nothing here.  Objects that do not
    parse are left out, and those before and after them stay.
    """
    ship(spark)
    cut = stored(fragments(spark, path, glob), "fragments")
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    n_quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    read = running_sums(cut.withColumn("own", n_quotes), {"quotes": F.col("own")}, "source_file")
    # quotes before a fragment tell whether it begins inside a string, those through it whether its brace is in one
    inside, open_ = (F.col("quotes") - F.col("own")) % 2 == 1, F.col("quotes") % 2 == 1
    read = read.select("source_file", "pos", "text", inside.alias("inside"), open_.alias("open"))
    measured = stored(read.mapInArrow(_measured, _MEASURED), "measured")
    first = F.min_by("text", "pos").alias("head")
    level = F.coalesce(*[F.when(F.col("head").rlike(pattern), depth) for pattern, depth in LAYOUTS.items()]).alias("level")
    levels = cut.groupBy("source_file").agg(first).select("source_file", level).where("level is not null")
    deep = running_sums(measured.drop("text").join(F.broadcast(levels), "source_file"), {"depth": F.col("change")}, "source_file")
    before = F.col("depth") - F.col("change")
    floor = F.element_at(F.array(*[F.lit(x) for x in FLOOR.values()]), F.col("level"))
    # only a document's first fragment begins above the lists
    over = F.when(before < floor, F.when(floor == 1, F.col("below1")).otherwise(F.col("below2"))).otherwise(before + F.col("lowest") < floor)
    ends = F.col("shut") & (F.col("depth") == F.col("level"))
    told = deep.withColumns({"before": before, "over": over.cast("int"), "ends": ends.cast("int")})
    told = running_sums(told, {"upto": F.col("ends"), "done": F.col("over")}, "source_file").where("done = 0")
    told = told.select("source_file", "pos", "level", "before", "ends", (F.col("upto") - F.col("ends")).alias("n"))
    told = told.hint("shuffle_hash").join(measured.select("source_file", "pos", "text"), ["source_file", "pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "text", "before")))
    record = told.groupBy("source_file", "n", "level").agg(parts.alias("x"), F.max("ends").alias("whole")).where("whole = 1")
    text = F.concat(F.array_join(F.transform("x", lambda p: p["text"]), "}"), F.lit("}"))
    row = record.select("source_file", "n", text.alias("text"), F.get(F.col("x"), F.lit(0))["before"].alias("depth"), "level")
    return row.mapInArrow(_parsed, "source_file string, n long, record string")
