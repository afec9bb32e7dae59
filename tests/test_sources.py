"""Readers, writers, settings and the streaming log."""

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import config, readers, writers
from quern.streaming import logs


def test_samples_of_all_layouts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_samples.jsonl").write_text('{"doc": 1}\nnot json\n[1]\n\n{"x": 2}\n')
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"samples": {"t": [{"doc": 3}, 4]}}))
    (tmp_path / "c.json").write_text(json.dumps({"k": [{"doc": 5}, {"other": 6}]}))
    (tmp_path / "d.json").write_text(json.dumps([{"doc": 7}, 8]))
    (tmp_path / "e.json").write_text("broken")
    got = readers.samples(spark, str(tmp_path)).orderBy(F.desc("samples_first"), "source_file", "n").collect()
    assert [json.loads(r.record) for r in got] == [{"doc": 1}, {"x": 2}, {"doc": 5}, {"doc": 7}, {"doc": 3}]


def test_strict_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event": "a", "n": 1}\n{"event": "b", "n": 2}\n')
    assert [r.n for r in readers.jsonl(spark, str(tmp_path), "event string, n int", "a").collect()] == [1]
    (tmp_path / "y.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.jsonl(spark, str(tmp_path), "event string, n int").collect()


def test_line_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("a\n\nb\n")
    assert [
        (r.line_number, r.line) for r in readers.numbered_lines(spark, str(tmp_path)).orderBy("line_number").collect()
    ] == [(1, "a"), (3, "b")]


def test_line_numbers_through_the_parts_of_a_folder(spark, tmp_path):
    """Parts in several splits each, blank lines at their ends, and a folder of its own."""
    texts = {"in/part-00000": "".join(f"a{i}\n" for i in range(300)) + "\n", "in/part-00001": "\n\n" + "b\n" * 200, "in/part-00003": "c", "other/part-00000": "d\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    key, folders = "spark.sql.files.maxPartitionBytes", [str(tmp_path / x) for x in ("in", "other")]
    before = spark.conf.get(key)
    spark.conf.set(key, "256")
    try:
        got = [(x.line_number, x.line) for x in readers.numbered_lines(spark, folders, as_one=True).collect()]
    finally:
        spark.conf.set(key, before)
    lines = (texts["in/part-00000"] + texts["in/part-00001"] + texts["in/part-00003"]).split("\n")
    assert sorted(got) == sorted([(n, x) for n, x in enumerate(lines, 1) if x] + [(1, "d")])


def test_no_task_writes_the_whole_log(spark, tmp_path, monkeypatch):
    from conftest import SF

    from quern.plans import registry, rows

    monkeypatch.setattr(rows, "_fresh", lambda spark, name: f"file://{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        registry.queries()["A8_line_numbers"](spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "numbered").glob("part-*"))) > 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "csv"), ["b", "missing", "a"])
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines() == ["b,missing,a", "x,,1"]
    for _ in range(2):
        writers.append_jsonl(df, str(tmp_path / "log"), "a")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    writers.write_jsonl(df, str(tmp_path / "one"))
    writers.write_summary(df, str(tmp_path / "sum"))
    assert json.loads(next((tmp_path / "sum").glob("*.txt")).read_text()) == {"a": 1, "b": "x", "c": None}


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 3}')
    (tmp_path / "own.json").write_text('{"base_config": "base.json", "a": {"y": 5}}')
    assert config.load(tmp_path / "own.json", ["a.z=7", "b=8"]) == {"a": {"x": 1, "y": 5, "z": 7}, "b": 8}
    (tmp_path / "base.json").write_text('{"base_config": "own.json"}')
    with pytest.raises(ValueError, match="circle"):
        config.load(tmp_path / "own.json")


def test_validation():
    good = {
        "loss_backend": "adaptive_opd",
        "strategy": "full",
        "opd_loss_mode": "prune_opd",
        "reverse_top_k": 16,
        "forward_top_k": 16,
        "overlap_top_k": 16,
    }
    assert config.problems(good) == []
    assert config.problems(
        good | {"opd_loss_mode": "overlap_aux_kl"}
    ) and config.problems(good | {"beta": 1}) and config.problems(good | {"reverse_top_k": 0})
    assert config.problems(good | {"loss_backend": "sampled_rkl"}) and config.problems(good | {"strategy": "esr"})
    assert config.with_lengths(
        {"strategy": "esr", "prefix_length": 50, "max_length": 4096, "max_prompt_length": 100, "auto_shrink_max_length": True}
    )["effective_max_length"] == 150


def test_checkpoints(spark, tmp_path):
    for n in ("checkpoint-9", "checkpoint-10", "checkpoint-x", "other"):
        (tmp_path / n).mkdir()
    names = spark.createDataFrame([(n,) for n in readers.folder_names(spark, str(tmp_path))], "name string")
    assert [r.step for r in readers.checkpoints(names).collect()] == [9, 10]
    assert readers.latest_checkpoint(names).first().name == "checkpoint-10"


def test_log_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"ts": "2024-01-01T00:10:00Z", "route": "r", "final_loss": 1.0}\n{"ts": "2024-01-01T00:20:00Z", "route": "r", "final_loss": 3.0}\n'
    )
    stream = logs.windowed_routes(logs.tail(spark, str(tmp_path / "in"), "ts timestamp, route string, final_loss double"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("routes").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.route, r.n, r.mean_loss) for r in spark.table("routes").collect()] == [("r", 2, 2.0)]
