"""JSON documents read in splits against the same documents read whole."""

import json
import random

import pytest

from quern.sources import large_json, readers


def value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(r.choice('ab {}[]",:\\\n\u00e9\U0001f600') for _ in range(r.randint(0, 12)))
    if kind == 1:
        return r.choice([1, -2.5, None, True])
    if kind < 4:
        return "x" * r.randint(0, 60)
    if kind < 6:
        return {f"k{i}}}": value(r, depth + 1) for i in range(r.randint(0, 3))}
    return [value(r, depth + 1) for _ in range(r.randint(0, 3))]


@pytest.fixture()
def small_splits(spark):
    """Splits of 4 KB, so that every file is many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("4096", "1"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_documents_in_splits(spark, tmp_path, small_splits):
    r = random.Random(6)
    item = lambda: {"doc": 1} | {f"a{i}": value(r) for i in range(r.randint(0, 4))}
    items = lambda n: [r.choice([item(), item(), item(), 8, "}{", None, [3, {"n": {}}]]) for _ in range(n)]
    layouts = {
        "list": items(400),
        "listed": {"samples": items(300), "more": {"x": [{"doc": 2}]}},
        "keyed": {"samples": {"a": items(150), 'b"{': items(150), "c": [], "d": items(1)}},
        "empty": [],
        "none": {"samples": [], "more": {"x": {"y": 1}, "z": [{"doc": 3}]}},
        "few": {"samples": [1, "2"], "more": {"x": {"y": 1}, "z": [{"doc": 3}]}},
        "closed": {"samples": [{"doc": 1}], "more": {"x": {"y": 1}, "z": [{"doc": 3}]}},
        "hollow": {"samples": {}, "more": {"x": [{"doc": 4}]}},
        "bare": {"samples": {"a": [], "b": [0]}, "more": {"x": [{"doc": 4}]}},
        "other": {"x": items(20)},
    }
    for k, (name, doc) in enumerate(layouts.items()):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=k % 2 == 0, indent=k if k > 1 else None))
    (tmp_path / "broken.json").write_text("no json")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {(x.source_file, x.n, x.record) for x in large_json.objects(spark, str(tmp_path)).collect()}
    want = {(x.source_file, x.n, x.record) for x in readers.samples(spark, str(tmp_path)).collect() if "other" not in x.source_file}
    assert got == want and len(want) > 300


def test_texts_are_shuffled_few_times(spark, tmp_path, small_splits):
    """Sums run without the texts, which go to the quotes before them, to their numbers and to their records; each split sends its head."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    doc = [{"doc": k, "text": "".join(r.choices(letters, k=4000))} for k in range(400)]
    (tmp_path / "list.json").write_text(json.dumps(doc))

    def shuffled():
        seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))

    before = shuffled()
    assert large_json.objects(spark, str(tmp_path)).count() == 400
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < shuffled() - before < 4.6 * (tmp_path / "list.json").stat().st_size
