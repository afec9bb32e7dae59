"""The pipeline's stages on the smallest tables: columns, effects, and what the last returns."""

import corpus_pipeline as P
from conftest import SF

from quern.llm.scratch import Scratch


def test_stages(spark):
    docs, keep = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = keep.table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[2]
    out = P.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_stages_on_odd_rows(spark):
    rows = [
        (1, "a b c d e f", "en", "s", 11),
        (1, "a b c d e f", "en", "s", 11),
        (2, "a b c d e f", None, None, None),
        (None, "a b c d e f", "en", "s", 11),
        (3, None, "en", "s", 0),
        (4, "", "en", "s", 0),
    ]
    docs, keep = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), Scratch(spark)
    for name, stage in P.STAGES:
        docs = keep.table(stage(spark, docs, SF), name)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_dedup_of_ids_with_several_texts(spark):
    a, b, c = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    # 5 has a copy of 1's text, two texts of its own, and one of these twice with other columns
    rows = [
        (1, a, "en", "s", 1),
        (5, a, "en", "s", 1),
        (5, b, "en", "s", 1),
        (5, c, "de", "s", 1),
        (5, c, "en", "s", 1),
        (6, b, "en", "s", 1),
        (7, None, "en", "s", 0),
        (7, "", "en", "s", 0),
        (None, a, "en", "s", 1),
    ]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = P.near_dedup(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id or -1), r.text or "", r.lang) for r in got.collect()) == [
            (-1, a, "en"),
            (1, a, "en"),
            (5, b, "en"),
            (5, c, "de"),
            (7, "", "en"),
            (7, "", "en"),
        ]


def test_stages_with_clashing_names_and_long_texts(spark):
    """Columns that operators use themselves, very long texts of one character, and repeated rows go through all stages."""
    names = [
        "row",
        "text_",
        "id",
        "key",
        "component_id",
        "kept",
        "score",
        "predicted",
        "n",
        "h",
        "t",
        "u",
        "item_id",
        "__null",
        "__block",
        "__r",
        "label",
        "own",
    ]
    long = ["a" * 300_000, " " * 1_000_000, "word " * 60_000, "<|endoftext|>" * 2_000, "\u65e5" * 90_000]
    rows = [(i, t, "en", "s", len(t), *["x"] * len(names)) for i, t in enumerate(long)] + [
        (1, long[1], "en", "s", 7, *["x"] * len(names)),
        (9, None, None, None, None, *[None] * len(names)),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs, keep = spark.createDataFrame(rows, schema), Scratch(spark)
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = keep.table(stage(spark, docs, SF), name)
        assert docs.columns == columns
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [0, 1, 2, 3, 4, 9]
    packed = P.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in packed} == {0, 1, 2, 3, 4, 9}
