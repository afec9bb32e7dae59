"""A cleaning pipeline for training documents: five stages, each written and read again.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs``.  Rows with a null id pass the filters, since no decision names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import leaks
from quern.llm.minhash_dedup import near_duplicates
from quern.llm.packing_bins import pack_sequences
from quern.llm.scratch import Scratch
from quern.llm.suffix_dedup import remove_repeats
from quern.llm.toxicity import fit, scored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples, their own left out, do not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = fit(docs.select("doc_id", "text"), labels)
    return scored(docs, index, leave_own=True).where("predicted = 0").select("row.*")


#: Ids of rows to drop that are broadcast at most; more of them meet the documents in a shuffle.
FEW = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for those with an id of ``gone``."""
    gone = Scratch(docs.sparkSession).table(gone.where("doc_id is not null").select("doc_id").distinct(), "gone")
    few = gone.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    An id may have several texts; these are then documents of their own, and of
    linked ones with the same id that of the least hash stays.  Of rows with
    equal id and text the least in the order of the other columns stays.
    """
    mark = F.xxhash64("doc_id", "text")
    by_id = docs.where("doc_id is not null").groupBy("doc_id").agg((F.min(mark) != F.max(mark)).alias("more"), F.count("*").alias("n"))
    several, repeated = by_id.agg(F.max("more"), F.max("n") > 1).first()
    if several:
        marks = (mark, F.xxhash64("text", "doc_id", F.lit(7)))
        own = docs.where("doc_id is not null").select("doc_id", "text").distinct()
        own = own.select("*", marks[0].alias("one"), marks[1].alias("two"), F.monotonically_increasing_id().alias("row"))
        own = Scratch(spark).table(own, "own")
        found = near_duplicates(own.select("row", "text"), "row", "text").select(F.col("doc_id").alias("row"), "component_id")
        members = own.select("doc_id", "one", "two", "row").join(found, "row")
        least = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "one", "two")).alias("least"))
        same = (marks[0] == F.col("least.one")) & (marks[1] == F.col("least.two"))
        kept = docs.join(least.select("least"), same, "left_semi")
        kept = kept.where("doc_id is not null").unionByName(docs.where("doc_id is null"))
    else:
        kept = _without(docs, near_duplicates(docs.select("doc_id", "text")).where("not kept"))
    if not repeated:
        return kept
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct(F.lit(0).alias("__0"), *others)).alias("__r")
    one = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(first)
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"__r.`{c}`").alias(c) for c in docs.columns]
    return one.select(*columns).unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a document of a smaller id has.

    A null text stays null.  Where a cut goes through a character, the rest of
    its bytes go, too, since they are no text.
    """
    none = "__null"
    while none in docs.columns:
        none += "_"
    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs.withColumn(none, F.col("text").isNull()), columns=[*others, none])
    text = F.when(~F.col(f"row.`{none}`"), F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, leaks(docs.select("doc_id", "text"), benchmark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return pack_sequences(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the radix sort nor the set join nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else keep.table(out, name)
    return docs
