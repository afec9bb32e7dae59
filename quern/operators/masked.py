"""Means, quantiles and correlations over active positions, with 0 for the empty case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.quantiles import quantiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def masked_mean(value: Column, mask: Column) -> Column:
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def masked_quantiles(
    rows: DataFrame, keys: list[str], values: dict[str, Column], mask: Column, at: tuple[float, ...] = QUANTILES
) -> DataFrame:
    """Exact quantiles over active rows with linear interpolation: ``<name>_p10`` and so on for each group."""
    return quantiles(rows, keys, {n: F.when(mask, v) for n, v in values.items()}, at)


def masked_correlation(x: Column, y: Column, mask: Column) -> Column:
    """Pearson's r over active rows; 0 below two rows or where a deviation is (nearly) nil."""
    x, y = F.when(mask, x).cast("double"), F.when(mask, y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    below = F.sqrt(F.coalesce(F.var_pop(x) * n, F.lit(0.0))) * F.sqrt(F.coalesce(F.var_pop(y) * n, F.lit(0.0)))
    return F.when((n < 2) | (below <= 1e-12), F.lit(0.0)).otherwise(F.covar_pop(x, y) * n / F.when(below > 1e-12, below))


def sequence_mean(facts: DataFrame, value: str, weight: str = "seq_weight") -> DataFrame:
    """Mean in each sequence, then the weighted mean of non-empty ones over max(sum of weights, 1)."""
    inner = facts.where("active").groupBy("seq_id").agg(F.avg(value).alias("m"), F.first(weight).alias("w"))
    return inner.agg(F.coalesce(F.sum(F.col("m") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0)), F.lit(0.0)).alias("loss"))


def token_mean(facts: DataFrame, value: str, weight: str = "seq_weight") -> DataFrame:
    """Weighted mean over active tokens, the sum of weights being 1 at least."""
    on = facts.where("active")
    return on.agg(F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0)), F.lit(0.0)).alias("loss"))


def region(relative: Column) -> Column:
    """Thirds of a response: early, middle, late."""
    return F.when(relative <= 1 / 3, "early").when(relative <= 2 / 3, "middle").otherwise("late")


def region_means(positioned: DataFrame, values: list[str]) -> DataFrame:
    """Means of ``values`` by third of the response, as one row; 0 where a third is empty."""
    r = region(F.col("relative_pos"))
    return positioned.agg(
        *[masked_mean(F.col(v), F.col("active") & (r == name)).alias(f"{v}_{name}") for v in values for name in ("early", "middle", "late")]
    )


def cut_means(
    facts: DataFrame,
    value: str,
    position: str = "response_pos",
    cuts: tuple[int, ...] = (0, 256, 768),
    points: tuple[int, ...] = (0, 100, 300),
) -> DataFrame:
    """Means between absolute cuts and at single positions."""
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], None], strict=True):
        inside = F.col("active") & (F.col(position) >= lo)
        inside &= F.col(position) < hi if hi is not None else F.lit(True)
        out.append(masked_mean(F.col(value), inside).alias(f"{value}_{lo}_{hi if hi is not None else 'end'}"))
    out += [masked_mean(F.col(value), F.col("active") & (F.col(position) == p)).alias(f"{value}_at_{p}") for p in points]
    return facts.agg(*out)


def first_position(facts: DataFrame, condition: Column, position: str = "response_pos", origin: int = 1) -> DataFrame:
    """Per sequence the first active position where the condition holds, from ``origin``; -1 if none."""
    hit = F.min(F.when(F.col("active") & condition, F.col(position) + origin))
    return facts.groupBy("seq_id").agg(F.coalesce(hit, F.lit(-1)).alias("first_pos"))
