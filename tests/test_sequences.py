"""Running sums over ranges, and gaps between ids, against plain definitions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import evaluation, sequence


def test_running_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(k, p, r.choice([None, -2, 0, 1, 5])) for k in (1, 2, None) for p in r.sample(range(500), 300)]
    table = spark.createDataFrame(rows, "seq_id long, pos long, v long")
    got = sequence.running_sums(table, {"s": F.col("v")}, totals=True, span=16)
    assert got.columns == ["seq_id", "pos", "v", "s", "s_total"]
    found = {(x.seq_id, x.pos): (x.s, x.s_total) for x in got.collect()}
    plain = sequence.running_sums(table, {"s": F.col("v")}, span=16).collect()
    assert {(x.seq_id, x.pos): x.s for x in plain} == {k: s for k, (s, _) in found.items()}
    for k in (1, 2, None):
        own = sorted((p, v or 0) for key, p, v in rows if key == k)
        total = sum(v for _, v in own)
        for i, (p, _) in enumerate(own):
            assert found[k, p] == (sum(v for _, v in own[: i + 1]), total)


def test_one_long_sequence_is_many_tasks(spark):
    long = spark.range(400_000).select(F.lit(7).alias("seq_id"), F.col("id").alias("pos"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequence.running_sums(long, {"s": F.lit(1)}, span=4096).withColumn("task", F.spark_partition_id())
        wrong, tasks, most = (
            got.groupBy("task").agg(F.count_if(F.col("s") != F.col("pos") + 1).alias("bad"), F.count("*").alias("n"))
            .agg(F.sum("bad"), F.count("*"), F.max("n")).first()
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert wrong == 0 and tasks == 4 and most < 200_000


def test_gaps_of_far_ids(spark):
    far = 2**60
    ids = [3, 4, 4, 9, 65_535, 65_536, 65_538, far, far + 2, None, -5]
    got = sorted(tuple(r) for r in evaluation.gaps(spark.createDataFrame([(i,) for i in ids], "example_id long")).collect())
    assert got == [(0, 2), (5, 8), (10, 65_534), (65_537, 65_537), (65_539, far - 1), (far + 1, far + 1)]
    assert evaluation.gaps(spark.createDataFrame([], "example_id long")).count() == 0


def test_groups_between_gaps(spark):
    rows = spark.createDataFrame([(2, "b"), (2, "a"), (0, "c"), (70_000, "d")], "example_id long, response string")
    got = evaluation.with_gaps(rows)
    assert got.count() == 70_001
    assert {r.example_id: r.responses for r in got.where("size(responses) > 0").collect()} == {0: ["c"], 2: ["a", "b"], 70_000: ["d"]}


def test_windows_of_whole_sequences_are_gone(spark):
    """The prune weights of a sequence are no longer one task's window over all its positions."""
    facts = spark.range(100).select(F.lit(1).alias("seq_id"), F.col("id").alias("pos"), F.lit(True).alias("active"), (F.col("id") % 3 / 2).alias("overlap"))
    got = sequence.prune_weights(facts).orderBy("pos").collect()
    low = F.sum((F.col("overlap") < 0.65).cast("int")).over(Window.partitionBy("seq_id").orderBy("pos"))
    want = facts.withColumn("low_count", low).orderBy("pos").collect()
    assert [r.low_count for r in got] == [r.low_count for r in want]
