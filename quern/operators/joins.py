"""Vocabulary, span and verdict joins."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary is broadcast up to this many rows; larger ones shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def vocabulary_alignment(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Ids of equal token strings: token, student_id, teacher_id."""
    return student.select("token", F.col("id").alias("student_id")).join(teacher.select("token", F.col("id").alias("teacher_id")), "token")


def alignment_stats(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """shared, student_only, teacher_only and shared / max(sizes), in one pass over both."""
    both = student.select("token", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        teacher.select("token", F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    per = both.groupBy("token").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    shared, ns, nt = F.sum(F.col("s") * F.col("t")), F.sum("s"), F.sum("t")
    return per.agg(
        shared.alias("shared"),
        (ns - shared).alias("student_only"),
        (nt - shared).alias("teacher_only"),
        (shared / F.greatest(ns, nt, F.lit(1))).alias("shared_ratio"),
    )


def mapped_ids(rows: DataFrame, alignment: DataFrame, ids: str = "ids", key: str = "row_id") -> DataFrame:
    """Teacher ids as student ids, in place; -1 where the student has no such token."""
    each = rows.select(key, F.posexplode(ids).alias("at", "teacher_id"))
    found = each.join(small(alignment.select("teacher_id", "student_id")), "teacher_id", "left")
    back = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("student_id", F.lit(-1)).alias("id")))).alias("m"))
    return back.select(key, F.transform("m", lambda m: m["id"]).alias("mapped"))


def span_alignment(student: DataFrame, teacher: DataFrame, minimum: int = 1, width: int = 64) -> DataFrame:
    """Per student token the teacher tokens whose spans share ``minimum`` characters or more.

    Both sides are put into buckets of ``width`` characters that they touch, so
    that a long sequence is not compared as a whole; a pair is taken in the
    first bucket that both touch.
    """

    def bucketed(df: DataFrame, p: str) -> DataFrame:
        spans = df.where("end_char > start_char").select(
            "seq_id",
            F.col("pos").alias(f"{p}_pos"),
            F.col("start_char").alias(f"{p}s"),
            F.col("end_char").alias(f"{p}e"),
        )
        return spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{p}s") / width), F.floor((F.col(f"{p}e") - 1) / width))))

    shared = F.least("se", "te") - F.greatest("ss", "ts")
    pairs = bucketed(student, "s").join(bucketed(teacher, "t"), ["seq_id", "bucket"]).where(
        (shared >= minimum) & (F.col("bucket") == F.floor(F.greatest("ss", "ts") / width))
    )
    return pairs.groupBy(
        "seq_id",
        "s_pos",
        F.col("ss").alias("start_char"),
        F.col("se").alias("end_char"),
    ).agg(F.array_sort(F.collect_list("t_pos")).alias("t_pos"))


def expanded(samples: DataFrame, seeds: list[int]) -> DataFrame:
    """Every sample with every seed; the seeds are a literal, so nothing is joined."""
    return samples.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def two_stage(rule: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rule verdicts, replaced where they fail by the model's verdict for the same key, if there is one."""
    asked = model.select(*keys, F.col("ok").alias("model_ok"))
    return rule.join(asked, keys, "left").withColumn("ok", F.col("ok") | F.coalesce("model_ok", F.lit(False))).drop("model_ok")


def overlap_ratio(s: Column, t: Column) -> Column:
    return F.size(F.array_intersect(s, t)) / F.greatest(F.size(s), F.lit(1))


def rank_in(ids: Column, target: Column) -> Column:
    """One-based rank of the target in a list; null if it is not there."""
    at = F.array_position(ids, target)
    return F.when(at > 0, at)


def compatible(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """identical: the same (token, id) rows; prefix: the student's are all among the teacher's."""
    s, t = student.select("token", "id").distinct(), teacher.select("token", "id").distinct()
    both = s.withColumn("s", F.lit(1)).withColumn("t", F.lit(0)).unionByName(t.withColumn("s", F.lit(0)).withColumn("t", F.lit(1)))
    per = both.groupBy("token", "id").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return per.agg(
        F.coalesce(F.bool_and((F.col("s") == 1) & (F.col("t") == 1)), F.lit(True)).alias("identical"),
        F.coalesce(F.bool_and((F.col("s") == 0) | (F.col("t") == 1)), F.lit(True)).alias("prefix_compatible"),
    )


def zipped(rows: DataFrame, a: str, b: str, name: str = "zipped") -> DataFrame:
    """Two arrays position by position; unequal lengths raise."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("lengths differ"))
    return rows.withColumn(name, F.when(same.isNull(), F.arrays_zip(a, b)))


def resolved_eos(
    student: DataFrame,
    teacher: DataFrame,
    student_ids: dict[str, list[int]],
    teacher_ids: dict[str, list[int]],
    extra: list[str],
) -> DataFrame:
    """Student-side ids of all stop tokens with their sources: token_id, token, sources, native.

    Teacher ids go by token string, never by number.
    """
    spark = student.sparkSession
    asked = lambda ids: spark.createDataFrame([(s, i) for s, x in ids.items() for i in x], "source string, id int")
    own = asked(student_ids).join(student, "id").select(F.col("id").alias("token_id"), "token", "source", F.lit(True).alias("native"))
    by_name = asked(teacher_ids).join(teacher, "id").select("token", "source").unionByName(
        spark.createDataFrame([(t, "configured_extra") for t in extra], "token string, source string")
    )
    other = by_name.join(student, "token").select(F.col("id").alias("token_id"), "token", "source", F.lit(False).alias("native"))
    return own.unionByName(other).groupBy("token_id", "token").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.bool_or("native").alias("native"),
    )


def preferred_teacher_eos(resolved: DataFrame) -> DataFrame:
    """The least id that only the teacher defines, else the least of the teacher's, else the least."""
    of_teacher = F.exists("sources", lambda s: F.startswith(s, F.lit("teacher")))
    rank = F.when(of_teacher & ~F.col("native"), 0).when(of_teacher, 1).otherwise(2)
    return resolved.agg(F.min_by("token_id", F.struct(rank, "token_id")).alias("token_id"))


def random_seeds(n: int, seed: int) -> list[int]:
    """``n`` distinct seeds in [0, 2^31 - 1), the same for the same ``seed``."""
    return random.Random(seed).sample(range((1 << 31) - 1), n)
