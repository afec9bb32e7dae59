"""Completions of a generator: cutting, finishing and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.answers import boxed_count, first_boxed_line_end
from quern.operators.quantiles import quantiles
from quern.operators.sequence import bound, first_n, repeated_ratio
from quern.sources.tables import stored


def normalised_ids(value: Column, kind: str) -> Column:
    """``array<int>`` of a null, a single id or a list of ids."""
    if kind == "array":
        return F.coalesce(F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: x.cast("int")), F.array().cast("array<int>"))
    return F.when(value.isNull(), F.array().cast("array<int>")).otherwise(F.array(value.cast("int")))


def stop_reason(stop_id: Column, sources: DataFrame | dict[int, list[str]]) -> Column:
    """Who defined the stop id: the student, else the teacher, else the configuration; null ends with the sequence."""
    out = F.when(stop_id.isNull(), F.lit("sequence_end"))
    for name in ("student", "teacher"):
        ids = [i for i, s in sources.items() if any(x.startswith(name) for x in s)]
        if ids:
            out = out.when(stop_id.isin(ids), F.lit(f"{name}_eos"))
    return out.otherwise(F.lit("configured_eos"))


def truncate(ids: Column, stop_ids: list[int], pad_id: int | None, horizon: Column | int, pad_first: bool = False) -> dict[str, Column]:
    """Cut at the first stop id, padding or the horizon; a stop id is kept, and seen before padding unless ``pad_first``."""
    horizon = F.greatest(F.lit(horizon) if isinstance(horizon, int) else horizon, F.lit(0))
    raw = F.slice(ids, F.lit(1), horizon)
    none = F.lit(1 << 30)
    positions = [F.nullif(F.array_position(raw, F.lit(i)), F.lit(0).cast("long")) for i in sorted(set(stop_ids))]
    stop_at = F.coalesce(F.least(*positions, none), none) if len(positions) > 0 else none
    pad_at = F.coalesce(F.nullif(F.array_position(raw, F.lit(pad_id)), F.lit(0).cast("long")), none) if pad_id is not None else none
    stopped = (stop_at < none) & ((stop_at < pad_at) if pad_first else (stop_at <= pad_at))
    length = F.when(stopped, stop_at).otherwise(F.least(pad_at - 1, F.size(raw))).cast("int")
    stop_id = F.when(stopped, F.get(raw, (stop_at - 1).cast("int")))
    hit = ~stopped & (length >= horizon)
    return {
        "token_ids": F.slice(raw, F.lit(1), length),
        "raw_tensor_length": F.size(raw),
        "stop_token_id": stop_id,
        "hit_horizon": hit,
        "padded": ~stopped & ~hit & (length < F.size(raw)),
    }


def truncated(
    rows: DataFrame,
    stop_sources: dict[int, list[str]],
    pad_id: int | None,
    horizon: Column | int,
    ids: str = "ids",
) -> DataFrame:
    """Rows with the cut, its reason and flags."""
    cut = truncate(F.col(ids), list(stop_sources), pad_id, horizon)
    out = rows.withColumns(cut)
    reason = F.when(
        F.col("stop_token_id").isNotNull(),
        stop_reason(F.col("stop_token_id"), stop_sources),
    ).when(F.col("hit_horizon"), "max_length").when(F.col("padded"), "padding").otherwise("sequence_end")
    return out.withColumn("stop_reason", reason).withColumn("emitted_eos", F.col("stop_token_id").isNotNull()).drop("padded")


def boxed_trim(pieces: Column) -> tuple[Column, Column, Column]:
    """(tokens kept, whether any went, boxes in the text) of additive text pieces.

    Keeps the fewest pieces whose text reaches the end of the line with the first complete box.
    The text is joined once, and one fold finds the first piece whose end reaches the line's.
    """

    def of(p: Column, text: Column) -> Column:
        def reach(end: Column) -> Column:
            start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("reach"))
            step = lambda a, x: F.struct(
                (a["sum"] + F.length(x)).alias("sum"),
                (a["n"] + 1).alias("n"),
                F.when((a["reach"] == 0) & (a["sum"] + F.length(x) >= end), a["n"] + 1).otherwise(a["reach"]).alias("reach"),
            )
            return F.nullif(F.aggregate(p, start, step, lambda a: a["reach"]), F.lit(0))

        kept = bound(first_boxed_line_end(text), lambda end: F.when(end.isNotNull(), reach(end)))
        return F.struct(F.coalesce(kept, F.size(p)).alias("kept"), F.size(p).alias("size"), boxed_count(text).alias("boxes"))

    found = bound(pieces, lambda p: bound(F.array_join(p, ""), lambda text: of(p, text)))
    return found["kept"], found["kept"] < found["size"], found["boxes"]


def finalized(
    rows: DataFrame,
    n: int = 4,
    cut: bool = True,
    append_eos: bool = True,
    eos_id: int = 0,
    stopped_online: Column | None = None,
    horizon: Column | None = None,
) -> DataFrame:
    """The boxed-answer boundary on rows of :func:`truncated` with ``pieces``: an appended end is never an emitted one."""
    kept, less, boxes = boxed_trim(F.col("pieces"))
    online = stopped_online if stopped_online is not None else F.lit(False)
    rows = rows.withColumns(
        {"kept_": kept, "less_": less, "raw_boxed_count": boxes, "raw_repeated_ngram_ratio": repeated_ratio(F.col("token_ids"), n)}
    )
    apply = F.lit(cut) & ~F.col("emitted_eos") & (F.col("less_") | online)
    room = F.lit(True) if horizon is None else F.col("kept_") < horizon
    append = F.lit(append_eos) & room
    ids = first_n(F.col("token_ids"), F.col("kept_"))
    return rows.withColumns({
        "token_ids": F.when(apply, F.when(append, F.concat(ids, F.array(F.lit(eos_id)))).otherwise(ids)).otherwise(F.col("token_ids")),
        "stop_reason": F.when(apply, "boxed_answer").otherwise(F.col("stop_reason")),
        "raw_hit_horizon": F.when(apply & online, F.lit(False)).otherwise(F.col("hit_horizon")),
        "hit_horizon": F.when(apply, F.lit(False)).otherwise(F.col("hit_horizon")),
        "boxed_truncated": apply,
        "appended_eos": apply & append,
    }).drop("kept_", "less_")


def sequence_weight(truncated_: Column, weight: float = 0.0) -> Column:
    return F.when(truncated_, F.lit(weight)).otherwise(F.lit(1.0))


def effective_horizon(requested: Column, configured: Column, model: Column, prompt: Column) -> Column:
    """min(requested, min(limits) - prompt); raises where nothing is left."""
    left = F.least(requested, F.least(configured, model) - prompt)
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("no room for a completion")).cast("int"))


def scheduled_horizon(schedule: str, full: int, short: int) -> int:
    if schedule not in ("full", "esr"):
        raise ValueError(f"unknown schedule {schedule}")
    return full if schedule == "full" else short


def cut_length(error_chunk: Column, has_error: Column, chunks: Column, total: Column, fallback: str | int = "full") -> Column:
    """Tokens to keep by a judge's decision: up to the start of the chunk of the first error; else the fallback."""
    start = F.get(chunks, error_chunk)["start_token"]
    other = total if fallback == "full" else F.lit(0) if fallback == "skip" else F.least(total, F.lit(int(fallback)))
    return F.when(has_error.isNull(), other).when(~has_error, total).otherwise(F.coalesce(start, other))


def error_position(chunk_id: Column, chunks: Column, threshold: int = 100) -> tuple[Column, Column]:
    """(one-based start of the chunk with the first error, whether it is within the threshold)."""
    at = F.get(chunks, chunk_id)["start_token_pos"]
    return at, F.coalesce(at <= threshold, F.lit(False))


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def report(rollouts: DataFrame, n: int = 4) -> DataFrame:
    """The rollout metrics, one aggregation but for the median; columns as made by the operators of this module."""
    rollouts = stored(rollouts, "rollouts")
    length, raw = F.size("token_ids"), F.col("raw_tensor_length")
    reason = F.col("stop_reason")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    median = quantiles(rollouts, [], {"n": length}, (0.5,)).select(F.lit(1).alias("__one"), F.col("n_p50").alias("median_generated_tokens"))
    means = rollouts.agg(
        F.coalesce(F.max("horizon"), F.lit(0)).alias("horizon"),
        F.coalesce(F.max("requested_horizon"), F.lit(0)).alias("requested_horizon"),
        F.coalesce(F.max("total_length_limit"), F.lit(0)).alias("total_length_limit"),
        mean(length).alias("mean_generated_tokens"),
        mean(raw).alias("raw_mean_generated_tokens"),
        mean(F.greatest(raw - length, F.lit(0))).alias("mean_removed_tokens"),
        mean("prompt_tokens").alias("mean_prompt_tokens"),
        mean(F.col("prompt_tokens") + length).alias("mean_total_effective_tokens"),
        _share(F.col("horizon") < F.col("requested_horizon")).alias("context_limited_fraction"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_generated_tokens"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_generated_tokens"),
        _share(F.col("emitted_eos")).alias("eos_fraction"),
        _share(F.col("hit_horizon")).alias("truncated_fraction"),
        _share(F.col("raw_hit_horizon")).alias("raw_truncated_fraction"),
        _share(reason == "boxed_answer").alias("boxed_answer_stop_fraction"),
        _share(F.col("boxed_truncated")).alias("boxed_truncation_fraction"),
        _share(F.col("appended_eos")).alias("appended_eos_fraction"),
        *[_share(reason == f"{s}_eos").alias(f"{s}_eos_fraction") for s in ("student", "teacher", "configured")],
        _share(~F.col("emitted_eos")).alias("no_eos_fraction"),
        mean("raw_repeated_ngram_ratio").alias(f"repeated_{n}gram_ratio"),
        mean(repeated_ratio(F.col("token_ids"), n)).alias(f"effective_repeated_{n}gram_ratio"),
        _share(F.col("raw_boxed_count") > 1).alias("multi_boxed_fraction"),
        mean("seq_weight").alias("mean_sequence_loss_weight"),
    )
    return means.withColumn("__one", F.lit(1)).join(median, "__one").drop("__one")
