"""Frames over the test tables that stand for tokens, score vectors, rollouts and message lists.

The same frames are written as SQL for the counterpart of each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token positions: a user's events in time order are a sequence."""
    e = read(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("seq_id"), "event_id", "ts", pos.alias("pos"),
        (F.col("event_id") % 97).alias("token_id"), F.concat(F.lit("t"), (F.col("event_id") % 97).cast("string")).alias("token"),
        F.col("event_type").alias("route"), ((F.col("event_id") * 37 % 101) / 100.0).alias("overlap"),
        F.abs("value").alias("reverse_kl"), (
            F.abs("value") * 0.5 + (F.col("event_id") % 7)
        ).alias("forward_kl"), F.col("value").alias("final_loss"),
        F.when(
            F.col("event_id") % 4 != 0,
            -F.abs("value") / 10,
        ).alias("student_logp"), F.when(F.col("event_id") % 4 != 0, -F.abs("value") / 8).alias("teacher_logp"),
        (F.col("event_id") % 10 != 0).alias("active"), F.col("event_id").alias("row_id"), (pos + 1).alias("position"),
        F.when(F.col("user_id") % 5 == 0, 0.5).otherwise(1.0).alias("seq_weight"),
    )


TOKENS = """tok AS (SELECT user_id AS seq_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  event_id % 97 AS token_id, 't' || (event_id % 97) AS token, event_type AS route, (event_id * 37 % 101) / 100.0::DOUBLE AS overlap,
  abs(value) AS reverse_kl, abs(value) * 0.5 + (event_id % 7) AS forward_kl, value AS final_loss,
  CASE WHEN event_id % 4 <> 0 THEN -abs(value) / 10 END AS student_logp, CASE WHEN event_id % 4 <> 0 THEN -abs(value) / 8 END AS teacher_logp,
  event_id % 10 <> 0 AS active, event_id AS row_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
  CASE WHEN user_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS seq_weight FROM events)"""

#: Adds response_pos and relative_pos to ``tok``.
POSITIONS = """posn AS (SELECT *, (response_pos + 1)::DOUBLE / greatest(n_active, 1) AS relative_pos FROM (SELECT *,
  sum(active::INT) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS response_pos,
  sum(active::INT) OVER (PARTITION BY seq_id)::BIGINT AS n_active FROM tok))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors of student and teacher: each embedding with the next one, as doubles times 8."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8.0).alias("v"))
    return e.select("vec_id", F.col("v").alias("s")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t")), "vec_id")


#: One row for each entry: vec_id, i (from 0), s, t and their ranks.
PAIRS = """en AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE * 8.0 AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
pr AS (SELECT a.vec_id, a.i, a.v AS s, b.v AS t, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.v DESC, a.i) AS rs, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.v DESC, b.i) AS rt
  FROM en a JOIN en b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rollouts of words cut at spaces."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "n_chars", F.filter(F.split("text", " ", -1), lambda w: w != "").alias("w"))


WORDS = "wd AS (SELECT doc_id, text, n_chars, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)"


def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of a user's events in order: ids of 0 to 39, of which 3 and 7 end and 5 pads."""
    t = tokens(spark, sf_dir)
    grouped = t.groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", ((F.col("event_id") * 7 + F.col("seq_id")) % 40).cast("int").alias("id")))).alias("x")
    )
    return grouped.select("seq_id", F.transform("x", lambda e: e["id"]).alias("ids"))


IDS = "idl AS (SELECT seq_id, list(((event_id * 7 + seq_id) % 40)::INT ORDER BY pos) AS ids FROM tok GROUP BY seq_id)"


def boxed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an answer put behind the text, in forms that differ by id."""
    d = read(spark, sf_dir, "documents")
    k, n = F.col("doc_id") % 6, F.col("n_chars").cast("string")
    tail = F.when(
        k == 0,
        F.concat(F.lit("\n\\boxed{\\frac{1}{"), n, F.lit("}} done")),
    ).when(k == 1, F.concat(F.lit("\nAnswer: "), n, F.lit(".\n"))).when(k == 2, F.concat(F.lit("\n#### "), n, F.lit("$"))).when(k == 3, F.concat(F.lit(" -"), n, F.lit(".5 end"))).when(k == 4, F.concat(F.lit("\\boxed{"), n)).otherwise(F.concat(F.lit("\n\\boxed { "), n, F.lit(" }\n\\boxed{}")))
    return d.select("doc_id", F.concat("text", tail).alias("text"), n.alias("gold"), "n_chars")


BOXED = """bx AS (SELECT doc_id, n_chars, n_chars::VARCHAR AS gold, text || CASE doc_id % 6 WHEN 0 THEN chr(10) || '\\boxed{\\frac{1}{' || n_chars || '}} done'
  WHEN 1 THEN chr(10) || 'Answer: ' || n_chars || '.' || chr(10) WHEN 2 THEN chr(10) || '#### ' || n_chars || '$' WHEN 3 THEN ' -' || n_chars || '.5 end'
  WHEN 4 THEN '\\boxed{' || n_chars ELSE chr(10) || '\\boxed { ' || n_chars || ' }' || chr(10) || '\\boxed{}' END AS text FROM documents)"""


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison across engines."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
