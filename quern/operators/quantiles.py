"""Exact quantiles of groups of any size, by selecting ranks in rounds.

A first pass counts values in buckets of a fixed scale, about ``FINE`` to each
doubling, with the least and greatest value of each.  The bucket that holds a
wanted rank is split anew into ``SPLIT`` buckets between its own least and
greatest value, and so on, until the rank is its bucket's first or last value or
the bucket has one value only.  Counts, minima and maxima merge, so map tasks
send a row for each bucket that they have seen and no task holds a group's
values; buckets of one range always separate its least and greatest value, so
every round narrows it.  Between orders of magnitude a range is split by
logarithm, within one evenly, which ends any range of doubles in about ten rounds.

Positions between two ranks are interpolated as in SQL's ``percentile_cont``.
Null values play no part; NaN is greater than all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import stored

FINE, SPLIT = 64, 4_096
#: Ranges that are broadcast to their values at most; beyond it the join shuffles.
BROADCAST_RANGES = 100_000
_TINY = float(2**60)
_FAR = 1 << 40


def _scale(v: Column) -> Column:
    """A function that never falls as ``v`` grows: about the logarithm of large and small numbers, of both signs."""
    return F.signum(v) * F.log2(1.0 + F.abs(v) * _TINY)


def _first_bucket(v: Column) -> Column:
    odd = F.when(F.isnan(v), _FAR).when(v == float("inf"), _FAR - 1).when(v == float("-inf"), -_FAR)
    return F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(odd, F.floor(_scale(v) * FINE)))


def _next_bucket(v: Column, low: Column, high: Column) -> Column:
    a, b = _scale(low), _scale(high)
    share = F.when(b > a, (_scale(v) - a) / (b - a)).otherwise((v - low) / (high - low))
    return F.least(F.floor(share * SPLIT), F.lit(SPLIT - 1))


def _found(ranks: DataFrame) -> DataFrame:
    """Ranks (within their range) with the value they stand for, where that is settled."""
    one, last = F.col("low") == F.col("high"), F.col("rank") == F.col("n") - 1
    value = F.when(one | (F.col("rank") == 0), F.col("low")).when(last, F.col("high"))
    return ranks.withColumns({"settled": one | (F.col("rank") == 0) | last, "value": value})


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], at: tuple[float, ...]) -> DataFrame:
    """For each group of ``keys`` (none: all rows) the columns ``<name>_p<percent>`` of each value; 0 for a group without values."""
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    named = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()])
    melted = stored(rows.select(group.alias("g"), F.explode(named).alias("x")).select("g", "x.name", "x.v"), "values")
    counts = stored(melted.groupBy("g", "name", _first_bucket(F.col("v")).alias("b")).agg(*_counts()), "counts")
    own = Window.partitionBy("g", "name")
    before = F.coalesce(F.sum("n").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.where("b is not null").withColumns({"before": before, "total": F.sum("n").over(own)})
    spot = lambda q: (F.col("total") - 1) * F.lit(float(q))
    ends = [F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(spot(q)).alias("rank")) for i, q in enumerate(at) for up in (False, True)]
    inside = F.filter(F.array(*ends), lambda x: (x["rank"] >= F.col("before")) & (x["rank"] < F.col("before") + F.col("n")))
    wanted = placed.withColumn("x", F.explode(inside))
    ranks = wanted.select("g", "name", "x.q", "x.up", "total", (F.col("x.rank") - F.col("before")).alias("rank"), "n", "low", "high")
    done: list[DataFrame] = []
    while True:
        ranks = stored(_found(ranks), "ranks")
        done.append(ranks.where("settled").select("g", "name", "q", "up", "total", "value"))
        left = ranks.where("not settled").drop("settled", "value")
        ranges = left.select("g", "name", "low", "high").distinct()
        open_ = left.limit(BROADCAST_RANGES + 1).count()
        if not open_:
            break
        near = F.broadcast(ranges) if open_ <= BROADCAST_RANGES else ranges
        hit = melted.join(near, ["g", "name"]).where("v between low and high")
        split = hit.groupBy("g", "name", F.col("low").alias("from"), F.col("high").alias("to"), _next_bucket(F.col("v"), F.col("low"), F.col("high")).alias("b"))
        split = stored(split.agg(*_counts()), "counts")
        of = Window.partitionBy("g", "name", "from", "to").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        split = split.withColumn("before", F.coalesce(F.sum("n").over(of), F.lit(0)))
        asked = left.select("g", "name", "q", "up", "total", "rank", F.col("low").alias("from"), F.col("high").alias("to"))
        met = asked.join(split, ["g", "name", "from", "to"]).where("rank >= before and rank < before + n")
        ranks = met.select("g", "name", "q", "up", "total", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    out = []
    for name in values:
        for i, q in enumerate(at):
            one = lambda up: F.max(F.when((F.col("name") == name) & (F.col("q") == i) & (F.col("up") == up), F.col("value")))  # noqa: B023, E731
            place = F.max(F.when(F.col("name") == name, F.col("total") - 1)) * F.lit(float(q))
            mixed = (F.ceil(place) - place) * one(False) + (place - F.floor(place)) * one(True)
            out.append(F.when(one(False) == one(True), one(False)).otherwise(mixed).alias(f"{name}_p{round(q * 100)}"))
    empty = counts.where("b is null").select("g", "name", F.lit(None).cast("int").alias("q"), F.lit(None).cast("boolean").alias("up"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("double").alias("value"))
    got = every.unionByName(empty).groupBy("g").agg(*out)
    if not keys:
        got = got.groupBy().agg(*[F.max(c).alias(c) for c in got.columns[1:]])
    columns = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in got.columns if c != "g"]
    return got.select(*[F.col(f"g.`{k}`").alias(k) for k in keys], *columns)
