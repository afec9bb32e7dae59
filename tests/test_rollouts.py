"""Completions: stops, padding, horizons, boxed answers, weighted means."""

from pyspark.sql import functions as F

from quern.operators import masked, rollouts, sequence

STOPS = {1: ["student_tokenizer"], 2: ["teacher_tokenizer"], 9: ["configured_extra"]}


def cut(spark, ids, pad=0, horizon=10, stops=STOPS):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    return rollouts.truncated(df, stops, pad, horizon).first()


def test_stop_reasons(spark):
    assert [cut(spark, [5, i, 6]).stop_reason for i in (1, 2, 9)] == ["student_eos", "teacher_eos", "configured_eos"]


def test_teacher_stop_before_padding(spark):
    r = cut(spark, [5, 6, 2, 0, 0])
    assert (r.token_ids, r.stop_token_id, r.emitted_eos) == ([5, 6, 2], 2, True)


def test_padding_that_is_a_stop(spark):
    r = cut(spark, [5, 1, 1, 1], pad=1)
    assert (r.token_ids, r.stop_reason) == ([5, 1], "student_eos")


def test_padding_alone(spark):
    r = cut(spark, [5, 6, 0, 0])
    assert (r.token_ids, r.stop_reason, r.hit_horizon) == ([5, 6], "padding", False)


def test_horizon(spark):
    r = cut(spark, [5, 6, 7, 8, 1], horizon=3)
    assert (r.token_ids, r.stop_reason, r.hit_horizon, r.raw_tensor_length) == ([5, 6, 7], "max_length", True, 3)


def test_end_of_sequence_and_empty(spark):
    assert cut(spark, [5, 6]).stop_reason == "sequence_end"
    r = cut(spark, [])
    assert (r.token_ids, r.stop_reason) == ([], "sequence_end")


def test_repeated_ratio(spark):
    df = spark.createDataFrame([([1, 2, 1, 2, 1, 2],), ([1],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(sequence.repeated_ratio(F.col("ids"), 2)).collect()] == [1 - 2 / 5, 0.0, 0.0]


def final(spark, pieces, horizon=None, **more):
    df = spark.createDataFrame([(list(range(10, 10 + len(pieces))), pieces)], "ids array<int>, pieces array<string>")
    return rollouts.finalized(rollouts.truncated(df, STOPS, 0, 20), eos_id=1, horizon=F.lit(horizon) if horizon else None, **more).first()


def test_boxed_tail_goes_and_an_end_is_appended(spark):
    r = final(spark, ["so ", "\\boxed{", "3}", "\n", "again ", "\\boxed{3}"])
    assert (
        r.token_ids,
        r.stop_reason,
        r.appended_eos,
        r.emitted_eos,
        r.raw_boxed_count,
    ) == ([10, 11, 12, 13, 1], "boxed_answer", True, False, 2)


def test_no_room_for_an_end(spark):
    r = final(spark, ["\\boxed{3}\n", "x", "y"], horizon=1)
    assert (r.token_ids, r.appended_eos) == ([10], False)


def test_empty_box_is_passed_over(spark):
    assert final(spark, ["\\boxed{}", " text"]).stop_reason == "sequence_end"


def test_sequence_mean_and_zero_weights(spark):
    df = spark.createDataFrame(
        [(1, True, 2.0, 1.0), (1, True, 4.0, 1.0), (2, True, 10.0, 0.5), (3, False, 99.0, 1.0)],
        "seq_id int, active boolean, v double, seq_weight double",
    )
    assert masked.sequence_mean(df, "v").first()[0] == (3 + 5) / 1.5
    assert masked.sequence_mean(df.withColumn("seq_weight", F.lit(0.0)), "v").first()[0] == 0.0
    half = df.where("seq_id = 2")
    assert masked.sequence_mean(half, "v").first()[0] == 5.0  # divided by 1, not by the weight


def test_empty_masks_are_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    none = F.col("x") > 5
    r = df.agg(
        masked.masked_mean(F.col("x"), none).alias("m"),
        masked.masked_correlation(F.col("x"), F.col("y"), ~none).alias("r"),
    ).first()
    assert tuple(r) == (0.0, 0.0)
    assert tuple(masked.masked_quantiles(df, [], {"x": F.col("x")}, none, (0.5,)).first()) == (0.0,)
