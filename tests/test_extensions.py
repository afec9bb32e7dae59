"""A table function of mappers, and a judge that loads once in a worker."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import types as T

from quern.functions.extensions import Mapper, judged, mapped, register_mappers, verified


def test_columns_follow_from_the_mapper_and_the_input(spark):
    add = lambda rows: T.StructType([*rows.fields, T.StructField("twice", T.LongType())])
    twice = Mapper(lambda row: [(*row, row.x * 2)], add)
    odd = Mapper(lambda row: [(row.x,)] if row.x % 2 else [], lambda rows: T.StructType([rows["x"]]))
    register_mappers(spark, {"twice": twice, "odd": odd})
    rows = spark.range(5).withColumnRenamed("id", "x")
    assert mapped(rows, "twice").columns == ["x", "twice"]
    assert sorted(r.twice for r in mapped(rows, "twice").collect()) == [0, 2, 4, 6, 8]
    assert sorted(r.x for r in mapped(rows.withColumnRenamed("x", "x"), "odd").collect()) == [1, 3]
    assert mapped(rows.limit(0), "twice").count() == 0
    with pytest.raises(Exception, match="one of odd, twice"):
        mapped(rows, "thrice")


def test_a_judge_is_loaded_once_in_a_worker(spark):
    seen = tempfile.mkdtemp(prefix="quern-loads-")

    def load():
        fd, _ = tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=seen)
        os.close(fd)
        return lambda frame: frame["x"] > 3

    rows = spark.range(64).withColumnRenamed("id", "x").repartition(16)
    assert sum(r.ok for r in judged(rows, "above three", load).collect()) == 60
    workers = [name.split("-")[0] for name in os.listdir(seen)]
    assert len(workers) == len(set(workers)) < 16


def test_only_what_the_rule_fails_is_judged(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, t string")
    rule = spark.createDataFrame([(1, True), (2, False), (3, False)], "k long, ok boolean")

    def load():
        def judge(frame: pd.DataFrame) -> pd.Series:
            assert 1 not in set(frame["k"])
            return frame["t"].notna()

        return judge

    got = verified(rule, rows, ["k"], "not null", load).collect()
    assert sorted((r.k, r.ok) for r in got) == [(1, True), (2, True), (3, False)]


def test_a_judge_is_shown_few_bytes_at_once(spark):
    """Long texts in one batch come in slices, and none goes back if only keys are asked for."""
    import datetime

    def load():
        def judge(frame: pd.DataFrame) -> pd.Series:
            assert frame["text"].str.len().sum() <= 5 << 20 and str(frame["at"].dtype) == "datetime64[ns]", frame.dtypes
            return frame["n"].fillna(1) > 1

        return judge

    rows = spark.range(400, numPartitions=1).selectExpr("id AS k", "repeat('x', 100000) AS text", "IF(id % 4 = 0, NULL, id % 4) AS n", "timestamp_seconds(id) AS at", "map('a', id) AS m")
    got = judged(rows, "long texts", load, ["k"])
    assert got.columns == ["k", "ok"]
    assert sorted(map(tuple, got.collect())) == [(k, k % 4 > 1) for k in range(400)]
    whole = judged(rows.where("k < 3"), "long texts", load).orderBy("k").collect()
    assert [(r.k, len(r.text), r.n, r.at - whole[0].at, r.m, r.ok) for r in whole] == [
        (k, 100_000, k or None, datetime.timedelta(seconds=k), {"a": k}, k > 1) for k in range(3)
    ]
