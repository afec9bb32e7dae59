"""Joins on frames small enough to check by eye."""

import pytest

from quern.operators import evaluation, joins


def test_spans_across_buckets(spark):
    span = "seq_id int, pos int, start_char long, end_char long"
    s = spark.createDataFrame([(1, 0, 0, 200), (1, 1, 200, 200), (1, 2, 200, 210)], span)
    t = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 205), (1, 2, 205, 210), (2, 0, 0, 9)], span)
    got = {r.s_pos: r.t_pos for r in joins.span_alignment(s, t).collect()}
    assert got == {0: [0, 1], 2: [1, 2]}
    assert {r.s_pos: r.t_pos for r in joins.span_alignment(s, t, minimum=6).collect()} == {0: [1]}


def test_zip_checks_lengths(spark):
    ok = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    assert len(joins.zipped(ok, "a", "b").first().zipped) == 2
    with pytest.raises(Exception, match="lengths differ"):
        joins.zipped(spark.createDataFrame([([1], [3, 4])], "a array<int>, b array<int>"), "a", "b").collect()


def test_compatible(spark):
    v = lambda rows: spark.createDataFrame(rows, "token string, id int")
    assert tuple(joins.compatible(v([("a", 1)]), v([("a", 1), ("b", 2)])).first()) == (False, True)
    assert tuple(joins.compatible(v([("a", 1)]), v([("a", 1)])).first()) == (True, True)
    assert tuple(joins.compatible(v([("a", 1)]), v([("a", 2)])).first()) == (False, False)


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([(2, "x")], "example_id long, response string")
    assert [len(r.responses) for r in evaluation.with_gaps(df).orderBy("example_id").collect()] == [0, 0, 1]
    assert evaluation.with_gaps(df.where("false")).count() == 0


def test_judge_ratios_are_null_over_zero(spark):
    schema = "correct boolean, complete boolean, has_error boolean, error_pos int, within boolean"
    ratios = ["within_of_located", "without_error_of_judged", "parse_failed_of_judged"]
    for rows in ([], [(True, True, None, None, None), (None, False, None, None, None)]):  # none is judged
        got = evaluation.judge_summary(spark.createDataFrame(rows, schema)).first()
        assert got.total_seen == len(rows) and got.judged == 0 and [got[c] for c in ratios] == [None] * 3
    one = spark.createDataFrame([(True, True, False, None, None)], schema)
    assert evaluation.judge_summary(one).first().judged == 0 and evaluation.judge_summary(one, judge_all=True).first().without_error == 1


def test_two_stage_keeps_the_rule(spark):
    rule = spark.createDataFrame([(1, True), (2, False), (3, False)], "k int, ok boolean")
    model = spark.createDataFrame([(2, True), (1, False)], "k int, ok boolean")
    assert [r.ok for r in joins.two_stage(rule, model, ["k"]).orderBy("k").collect()] == [True, True, False]


def test_gaps_query_groups_every_document(spark):
    from conftest import SF

    from quern.plans import registry

    got = registry.queries()["A11_D20_gaps"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sum(r.n for r in got) == len(docs) and {r.example_id for r in got} == set(range(max(r.example_id for r in got) + 1))
    assert {r.example_id for r in got if r.n == 0} == set(range(1, len(got), 2))
    assert "".join(
        sorted("".join(r.responses for r in got).replace(",", ""))
    ) == "".join(sorted("".join(d.text for d in docs).replace(",", "")))
