"""Streams over files: the stop rule's scanner against a rescan of the text, restarts, replays, appends that count once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import token_stats
from quern.sources import writers
from quern.streaming import logs
from quern.streaming.stop import RANGE_BITS, Scanner, merged


def line_end(text):
    """The end of the line with the first complete, non-blank box, by reading the text anew."""
    at = text.find("\\boxed{")
    while at >= 0:
        depth, close = 0, None
        for i in range(at + 6, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                close = i
                break
        if close is not None and text[at + 7 : close].strip():
            line = text.find("\n", close)
            return line + 1 if line >= 0 else close + 1
        at = text.find("\\boxed{", at + 7 if close is None else close + 1)
    return None


def stop_brute(pieces):
    text = ""
    for k, piece in enumerate(pieces):
        text += piece
        if line_end(text) is not None:
            return k
    return None


def stop_scanned(pieces):
    scan = Scanner()
    return next((k for k, piece in enumerate(pieces) if scan.read(piece)), None)


def test_scanner_is_a_rescan():
    r = random.Random(1)
    parts = ["\\boxed{", "\\boxed", "\\box", "ed{", "{", "}", "}", " ", "\n", "x", "\\", "b"]
    stops = 0
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        pieces = []
        while text:
            n = r.randint(1, 9)
            pieces, text = [*pieces, text[:n]], text[n:]
        want = stop_brute(pieces)
        assert stop_scanned(pieces) == want, pieces
        stops += want is not None
    assert stops > 500


def test_state_does_not_grow_with_the_text():
    scan = Scanner()
    scan.read("\\boxed{")
    for _ in range(5000):
        scan.read("word { x } { \\boxed")
        assert not scan.read("{ } ")
        assert scan.boxes == [0] and scan.matched == 0
        assert not scan.read("}")


def test_merged_pieces_stop_where_pieces_do():
    r = random.Random(2)
    parts = ["\\boxed{", "\\boxed", "\\box", "ed{", "{", "}", "}", " ", "x", " " * 20, "plain text of some length ", "\\", "b"]
    stops = 0
    for _ in range(3000):
        pieces = ["".join(r.choice(parts) for _ in range(r.randint(0, 3))) or None for _ in range(r.randint(1, 12))]
        rows = [(7, k, x) for k, x in enumerate(pieces)] + [(8, k, "y") for k in range(3)]
        r.shuffle(rows)
        names = ("seq_id", "pos", "piece")
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
        runs = [x for b in merged(iter([batch])) for x in b.to_pylist()]
        assert [x["n"] for x in runs if x["seq_id"] == 8] == [3]
        own, n, got, scan = [x for x in runs if x["seq_id"] == 7], 0, None, Scanner()
        for x in sorted(own, key=lambda x: x["pos"]):
            n += x["n"]
            if got is None and scan.read(x["text"]):
                got = n - 1
        assert n == len(pieces) and got == stop_scanned([x or "" for x in pieces]), pieces
        stops += got is not None
    assert stops > 300


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, logs.ROCKS)
    yield
    spark.conf.unset(key)


def test_stops_over_a_restart(spark, tmp_path, rocks):
    """State is read back when the stream starts again; a null piece counts as an empty one."""
    path, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "seq_id long, pos long, piece string"
    parts = [[(1, 0, "a \\box"), (2, 0, "b"), (3, 1, "}"), (3, 0, "\\boxed{x")], [(1, 1, "ed{2"), (2, 1, None)], [(1, 2, "}\n"), (1, 3, "z"), (3, 2, "\\boxed{y}")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        logs.run_available(logs.boxed_stops(logs.tail(spark, path, schema, "parquet")), out, at, mode="update")
    got = spark.read.parquet(out).groupBy("seq_id").agg(F.max("tokens").alias("n"), F.min("stop_at").alias("stop")).collect()
    assert {tuple(r) for r in got} == {(1, 4, 3), (2, 2, None), (3, 3, 2)}


def test_rollouts_share_entries_of_the_state(spark, tmp_path, rocks):
    """An entry of the state costs round trips, so there is one for each range of ids; null is a rollout of its own."""
    path, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "seq_id long, pos long, piece string"
    ids = [-1, *range(300), 5 << RANGE_BITS, (1 << 62) + 1, None]
    for rows in ([(k, 0, "a \\boxed{") for k in ids], [(k, 1, f"{k}}}") for k in ids if k != 7]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        logs.run_available(logs.boxed_stops(logs.tail(spark, path, schema, "parquet")), out, at, mode="update")
    got = spark.read.parquet(out).groupBy("seq_id").agg(F.max("tokens").alias("n"), F.min("stop_at").alias("stop")).collect()
    assert {tuple(r) for r in got} == {(k, 1, None) if k == 7 else (k, 2, 2) for k in ids}
    assert spark.read.format("statestore").option("stateVarName", "scans").load(at).count() == 5


def test_a_replayed_batch_counts_once(spark, tmp_path):
    import shutil

    path, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "token string, route string, overlap double, reverse_kl double, forward_kl double, final_loss double, student_logp double, teacher_logp double"
    sums = lambda batch: token_stats.group_sums(batch, "token")
    rows = [("a", "r", 0.5, 1.0, 2.0, 3.0, None, None), ("a", "s", 1.5, 1.0, 2.0, 5.0, -1.0, None), ("b", "r", None, 0.0, 0.0, 1.0, -2.0, -3.0)]
    for k in range(3):
        spark.createDataFrame(rows[k:], schema).write.mode("append").json(path)
        logs.run_available(logs.tail(spark, path, schema), out, at, sums)
    batches = sorted(p.name for p in (tmp_path / "out").glob("batch=*"))
    assert len(batches) == 3
    # the last batch is sent again, as after a failure between the sink and the checkpoint's record of it
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    logs.run_available(logs.tail(spark, path, schema), out, at, sums)
    want = token_stats.group_stats(spark.read.schema(schema).json(path), "token").orderBy("token").collect()
    assert logs.rolled_up(spark, out, "token").orderBy("token").collect() == want and want[0]["count"] == 3
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == batches
    shutil.rmtree(tmp_path / "out")


def test_append_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "x long, rank long").repartition(4)
    assert writers.append_once(rows, path, "a", "rank") and not writers.append_once(rows, path, "a", "rank")
    broken = rows.withColumn("x", F.when(F.col("x") < 29, F.col("x")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        writers.append_once(broken, path, "b")
    assert writers.append_once(rows.where("x < 5"), path, "b", "rank")
    back = spark.read.schema("x long, rank long, batch string").json(path)
    assert sorted(r.x for r in back.collect()) == sorted([*range(30), *range(5)])
    assert not [p for p in (tmp_path / "log").iterdir() if "aside" in p.name]
