"""Statistics of token positions grouped by token, route, overlap decile and position bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEANS = {"mean_overlap": "overlap", "mean_reverse_kl": "reverse_kl", "mean_forward_kl": "forward_kl", "mean_final_loss": "final_loss"}
LOGPS = {"mean_student_target_logp": "student_logp", "mean_teacher_target_logp": "teacher_logp"}


def overlap_bin(overlap: Column) -> Column:
    """Decile label such as ``[0.3,0.4]``; values are clamped and 1.0 falls in the last bin."""
    k = F.least(F.floor(F.greatest(F.least(overlap, F.lit(1.0)), F.lit(0.0)) * 10), F.lit(9))
    return F.concat(
        F.lit("[0."),
        k.cast("string"),
        F.lit(","),
        F.when(k == 9, "1.0").otherwise(F.concat(F.lit("0."), (k + 1).cast("string"))),
        F.lit("]"),
    )


def position_bin(position: Column, width: int = 50) -> tuple[Column, Column]:
    """(number, label) of the bin of a one-based position; sort by the number."""
    k = F.floor((position - 1) / width)
    return k, F.concat((k * width + 1).cast("string"), F.lit("-"), ((k + 1) * width).cast("string"))


def _means() -> list[Column]:
    out = [F.count("*").alias("count")]
    out += [F.avg(c).alias(n) for n, c in MEANS.items()]
    # means of log-probabilities are over the rows that have them; none is 0
    return out + [F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in LOGPS.items()]


def route_json(entries: Column) -> Column:
    """A histogram as JSON with sorted keys, from an array of (route, n)."""
    return F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(F.array_sort(entries), lambda e: F.concat(F.lit('"'), e["route"], F.lit('": '), e["n"].cast("string"))),
            ", ",
        ),
        F.lit("}"),
    )


_ADDED = [*MEANS.values(), *LOGPS.values()]


def group_sums(tokens: DataFrame, *keys: str) -> DataFrame:
    """Counts and sums by ``keys`` and route, from which statistics follow; those of parts of the tokens add up."""
    sums = [F.count("*").alias("n")]
    for c in _ADDED:
        sums += [F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}")]
    return tokens.groupBy(*keys, F.col("route").alias("route_")).agg(*sums)


def stats_of(sums: DataFrame, *keys: str) -> DataFrame:
    """Count, means and route histogram by ``keys``, from sums of several parts."""
    added = [F.sum(c).alias(c) for c in ["n", *[f"{a}_{c}" for c in _ADDED for a in "sn"]]]
    return _stats(sums.groupBy(*keys, "route_").agg(*added), *keys)


def _stats(inner: DataFrame, *keys: str) -> DataFrame:
    mean = lambda c: F.sum(f"s_{c}") / F.greatest(F.sum(f"n_{c}"), F.lit(1))
    out = [F.sum("n").alias("count")] + [F.coalesce(mean(c), F.lit(0.0)).alias(n) for n, c in (MEANS | LOGPS).items()]
    return inner.groupBy(*keys).agg(*out, route_json(F.collect_list(F.struct(F.col("route_").alias("route"), "n"))).alias("routes"))


def group_stats(tokens: DataFrame, *keys: str) -> DataFrame:
    """Count, means and route histogram by ``keys``, in two levels so that both combine before the shuffle."""
    return _stats(group_sums(tokens, *keys), *keys)


def binned(tokens: DataFrame) -> DataFrame:
    number, label = position_bin(F.col("position"))
    return tokens.withColumns({"overlap_bin": overlap_bin(F.col("overlap")), "position_no": number, "position_bin": label})


def all_groupings(tokens: DataFrame) -> DataFrame:
    """The four groupings in one pass over the tokens, by grouping sets."""
    t = binned(tokens)
    sets = [["token_id", "token"], ["route"], ["overlap_bin"], ["position_bin"]]
    grouped = t.groupingSets([[F.col(c) for c in s] for s in sets], "token_id", "token", "route", "overlap_bin", "position_bin")
    kind = F.when(F.grouping("token_id") == 0, "token").when(F.grouping("route") == 0, "route").when(
        F.grouping("overlap_bin") == 0,
        "overlap",
    ).otherwise("position")
    return grouped.agg(kind.alias("grouping"), *_means()).select(
        "grouping",
        F.coalesce(F.concat_ws(":", F.col("token_id").cast("string"), "token"), F.lit("")).alias("token_key"),
        "route",
        "overlap_bin",
        "position_bin",
        "count",
        *MEANS,
        *LOGPS,
    )


def counters(tokens: DataFrame) -> DataFrame:
    return tokens.agg(
        F.countDistinct("seq_id").alias("samples"),
        F.count("*").alias("tokens"),
        F.countDistinct("token_id", "token").alias("unique_tokens"),
    )


def highest_loss(tokens: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` positions of highest loss; ties go to the later row, as a total order on (loss, row)."""
    return tokens.orderBy(F.desc("final_loss"), F.desc("row_id")).limit(n)
