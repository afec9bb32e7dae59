"""Operators along the positions of a sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value`` evaluated once: inside lambdas an expression is otherwise evaluated for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Positions of a range of a sequence.
SPAN = 1 << 16


def running_sums(
    rows: DataFrame, values: dict[str, Column], keys: list[str] | str = "seq_id", order: str = "pos", totals: bool = False, span: int = SPAN
) -> DataFrame:
    """``rows`` with the sums of ``values`` up to each position and, if asked for, ``<name>_total`` of the sequence.

    Sequences are cut into ranges of ``span`` positions: the sums of ranges are
    added up along the sequence, and running sums within a range start from what
    comes before it.  So a sequence of any length is many tasks, and what one
    task holds of it is a row for each range.  ``order`` is a whole number; null
    values count as 0.
    """
    keys = [keys] if isinstance(keys, str) else keys
    own = {f"__{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()}
    place = F.expr(f"cast(`{order}` as bigint) div {span}")
    marked = rows.withColumns({"__k": F.struct(*keys), "__r": place} | own)
    sums = marked.groupBy("__k", "__r").agg(*[F.sum(c).alias(c) for c in own])
    along = Window.partitionBy("__k")
    before = along.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "__k",
        "__r",
        *[F.sum(c).over(before).alias(f"{c}_base") for c in own],
        *([F.sum(c).over(along).alias(f"{c}_total") for c in own] if totals else []),
    )
    if not totals:  # the first range starts from nothing
        bases = bases.where(" or ".join(f"{c}_base is not null" for c in own))
    within = Window.partitionBy("__k", "__r").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.withColumns({c: F.sum(c).over(within) for c in own})
    joined = local.join(bases, ["__k", "__r"], "inner" if totals else "left")
    out = {n: F.col(f"__{n}") + F.coalesce(f"__{n}_base", F.lit(0)) for n in values}
    if totals:
        out |= {f"{n}_total": F.col(f"__{n}_total") for n in values}
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def prune_weights(facts: DataFrame, threshold: float = 0.65, drop: float = 0.01, base: float = 0.5, cumulative: bool = True) -> DataFrame:
    """``weight``: falls by ``drop`` with each low-overlap position so far, not below ``base``; 0 where inactive."""
    low = (F.col("active") & (F.col("overlap") < threshold)).cast("int")
    if cumulative:
        counted = running_sums(facts, {"low_count": low})
        weight = F.least(F.greatest(1.0 - drop * F.col("low_count"), F.lit(base)), F.lit(1.0))
    else:
        counted = facts.withColumn("low_count", low)
        weight = F.when(F.col("low_count") == 1, F.lit(base)).otherwise(F.lit(1.0))
    return counted.withColumn("weight", F.when(F.col("active"), weight).otherwise(F.lit(0.0)))


def response_positions(facts: DataFrame) -> DataFrame:
    """``response_pos`` (active positions before, from 0) and ``relative_pos`` in (0, 1]."""
    counted = running_sums(facts, {"__on": F.col("active").cast("int")}, totals=True)
    at = F.col("__on") - 1
    share = (at + 1) / F.greatest(F.col("__on_total"), F.lit(1))
    return counted.withColumns({"response_pos": at, "relative_pos": share}).drop("__on", "__on_total")


def char_spans(tokens: DataFrame, piece: str = "piece", keys: list[str] | str = "seq_id", order: str = "pos") -> DataFrame:
    """``start_char`` and ``end_char`` of every piece in the concatenation of its sequence."""
    ended = running_sums(tokens, {"end_char": F.length(piece)}, keys, order)
    return ended.withColumn("start_char", F.col("end_char") - F.length(piece))


def shifted(facts: DataFrame, column: str = "label") -> DataFrame:
    """The label that each position predicts: that of the next one; the last position goes."""
    following = F.lead(column).over(Window.partitionBy("seq_id").orderBy("pos"))
    last = F.lead("pos").over(Window.partitionBy("seq_id").orderBy("pos")).isNull()
    return facts.withColumns({"next_label": following, "last_": last}).where("not last_").drop("last_")


def top_k(scores: DataFrame, k: int, keys: list[str], value: str = "score", index: str = "token_id") -> DataFrame:
    """The ``k`` best per key by (value descending, index ascending), with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(index)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def array_top_k(values: Column, k: int) -> Column:
    """Zero-based indices of the ``k`` largest entries, ties by the lower index."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def round_robin(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``part``: the row's number in ``order``, modulo ``n``, numbered in ranges and not in one task."""
    numbered = row_index(rows, order)
    return numbered.withColumn("part", F.pmod("row_index", F.lit(n))).drop("row_index")


def row_index(rows: DataFrame, order: str) -> DataFrame:
    """Zero-based number in ``order`` (a unique whole number): its place in a range plus the rows of the ranges before.

    Ranges of 4,096 are counted within ranges of these, so no task sees more than a small share of the counts.
    """
    marked = rows.withColumn("range_", F.floor(F.col(order) / 4096))
    above = F.floor(F.col("range_") / 4096).alias("above_")
    counts = marked.groupBy("range_").count().select("range_", above, "count")
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = counts.select("range_", "above_", before(Window.partitionBy("above_").orderBy("range_")).alias("base_"))
    tops = counts.groupBy("above_").agg(F.sum("count").alias("count")).select("above_", before(Window.orderBy("above_")).alias("top_"))
    bases = within.join(tops, "above_").select("range_", (F.col("base_") + F.col("top_")).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(order)) - 1
    numbered = marked.withColumn("in_", inside).join(bases, "range_")
    return numbered.withColumn("row_index", F.col("base_") + F.col("in_")).drop("range_", "base_", "in_")


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """``place`` of each row in an order that the seed and the key decide: by MD5, numbered in ranges of its first bits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = rows.withColumns({"digest_": digest, "range_": F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")})
    counts = marked.groupBy("range_").count()  # 65,536 rows at most
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("range_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy("digest_", key)) - 1
    placed = marked.withColumn("in_", inside).join(bases, "range_")
    return placed.withColumn("place", F.col("base_") + F.col("in_")).drop("digest_", "range_", "base_", "in_")


def chunks(ids: Column, size: int) -> Column:
    """Array of (id, start, end) of fixed-size chunks, zero-based with an exclusive end; empty for an empty array."""
    n = F.size(ids)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("id"), s.alias("start_token"), F.least(s + size, n).alias("end_token")))


def one_based_chunks(ids: Column, size: int) -> Column:
    """The same chunks with one-based inclusive positions."""
    return F.transform(
        chunks(ids, size),
        lambda c: F.struct(c["id"].alias("id"), (c["start_token"] + 1).alias("start_token_pos"), c["end_token"].alias("end_token_pos")),
    )


def ngrams(tokens: Column, n: int, of: Callable[[list[Column]], Column] | None = None) -> Column:
    """All runs of ``n`` neighbours, or ``of`` each; empty when there are fewer."""
    of = of or (lambda run: F.array(*run))

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: i + n <= F.size(w))
        return F.transform(starts, lambda i: of([F.get(w, i + k) for k in range(n)]))

    return bound(tokens, runs)


def repeated_ratio(tokens: Column, n: int = 4) -> Column:
    """Share of n-grams that repeat an earlier one; 0 without any."""
    share = lambda g: 1.0 - F.try_divide(F.size(F.array_distinct(g)), F.size(g))
    return F.coalesce(bound(ngrams(tokens, n, lambda run: F.xxhash64(*run)), share), F.lit(0.0))


def last_n(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def first_n(values: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(values, F.lit(1), F.greatest(n, F.lit(0)))
