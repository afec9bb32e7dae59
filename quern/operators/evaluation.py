"""Scores of sampled responses and of judged cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sequence import bound, ngrams
from quern.sources.tables import stored


#: Characters of a key's responses up to which one row holds its n-grams. Of keys with more, grams are counted across tasks.
LARGE = 1 << 20
#: Large keys that are sent to every task; more of them are joined by a shuffle.
MOST_SENT = 100_000


def distinct_n(responses: DataFrame, n: int = 4, key: str = "example_id", text: str = "response") -> DataFrame:
    """Distinct n-grams of words over all of them, pooled for each key; 0 without any.

    Responses are shuffled once, by key, as texts are smaller than their n-grams.
    Those of keys with more than ``LARGE`` characters are taken apart instead and
    their n-grams told apart by two 64-bit hashes, so that no task holds such a key.
    """
    rows = responses.select(key, text)
    split = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    share = lambda some, of: F.coalesce(F.try_divide(some.cast("double"), of), F.lit(0.0)).alias("distinct")
    large = stored(rows.groupBy(key).agg(F.sum(F.length(text)).alias("chars")).where(F.col("chars") > LARGE).select(F.col(key).alias("large")), "large")
    n_large = large.count()
    small = rows
    if n_large:
        own = F.col(key).eqNullSafe(F.col("large"))
        told = F.broadcast(large) if n_large <= MOST_SENT else large
        small = rows.join(told, own, "left_anti")

    grams = F.flatten(F.transform(F.collect_list(text), lambda t: ngrams(split(t), n, lambda run: F.concat_ws(" ", *run))))  # words hold no space
    pooled = small.repartition(F.col(key)).groupBy(key).agg(grams.alias("grams"))
    out = pooled.select(key, bound(F.col("grams"), lambda g: share(F.size(F.array_distinct(g)), F.size(g))).alias("distinct"))
    if not n_large:
        return out
    hashes = lambda run: F.struct(F.xxhash64(*run).alias("a"), F.xxhash64(F.lit(n), *run).alias("b"))
    each = rows.join(told, own, "left_semi").select(key, F.explode_outer(ngrams(split(F.col(text)), n, hashes)).alias("gram"))
    counted = each.groupBy(key, "gram").count()
    some = F.sum(F.when(F.col("gram").isNotNull(), F.col("count")))
    return out.unionByName(counted.groupBy(key).agg(share(F.count("gram"), some)))


#: Ids of a range, within which an id's neighbour is looked for.
SPAN = 1 << 16


def gaps(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """Intervals ``first`` to ``last`` of the ids from 0 to the largest that have no rows.

    Each id is compared with the one before it: within a range of ids by a
    window over the range, at a range's start with the greatest id of the ranges
    before.  Intervals are as many as the ids at most, however far these lie apart.
    """
    ids = rows.where(F.col(key) >= 0).select(F.col(key).cast("long").alias("id")).distinct().withColumn("range", F.expr(f"id div {SPAN}"))
    tops = ids.groupBy("range").agg(F.max("id").alias("top"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    tops = tops.select("range", F.coalesce(F.max("top").over(before), F.lit(-1)).alias("below"))
    near = ids.withColumn("near", F.lag("id").over(Window.partitionBy("range").orderBy("id"))).join(tops, "range")
    found = near.select((F.coalesce("near", "below") + 1).alias("first"), (F.col("id") - 1).alias("last"))
    return found.where("first <= last")


def with_gaps(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """Responses by id from 0 to the largest; ids without rows get an empty list."""
    none = F.array().cast("array<string>")
    grouped = rows.where(F.col(key) >= 0).groupBy(F.col(key).cast("long").alias(key))
    grouped = grouped.agg(F.array_sort(F.collect_list("response")).alias("responses"))
    parts = gaps(rows, key).select("last", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(SPAN))).alias("from"))
    missing = parts.select(F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + SPAN - 1))).alias(key), none.alias("responses"))
    return grouped.unionByName(missing)


def scores(graded: DataFrame, key: str = "example_id") -> DataFrame:
    """avg@n, pass@n, shares solved never and always, and responses without a box; rows have ok and format_error."""
    per = graded.groupBy(key).agg(F.count("*").alias("n"), F.count_if("ok").alias("right"), F.count_if("format_error").alias("bad"))
    share = lambda c: F.avg(c.cast("double"))
    return per.agg(
        F.avg(F.col("right") / F.col("n")).alias("avg_at_n"),
        share(F.col("right") > 0).alias("pass_at_n"),
        share(F.col("right") == 0).alias("solve_none"),
        share(F.col("right") == F.col("n")).alias("solve_all"),
        F.sum("bad").alias("format_errors"),
        F.sum("n").alias("responses"),
    )


def judge_summary(cases: DataFrame, judge_all: bool = False) -> DataFrame:
    """Counters of all cases in one pass, and ratios that are null over zero.

    Cases have ``correct`` (null: unknown), ``complete`` (problem and generation
    are there), ``has_error`` (null: not to be read) and ``error_pos`` (null:
    not located) with ``within``.  Correct cases are skipped unless
    ``judge_all``; of the others those that are complete are judged.
    """
    skipped = F.lit(False) if judge_all else F.coalesce(F.col("correct"), F.lit(False))
    judged = ~skipped & F.col("complete")
    wrong, none = judged & F.col("has_error"), judged & ~F.col("has_error")
    located = wrong & F.col("error_pos").isNotNull()
    counters = {
        "total_seen": F.lit(True),
        "judged": judged,
        "skipped_correct": skipped,
        "missing_problem_or_generation": ~skipped & ~F.col("complete"),
        "parse_failed": judged & F.col("has_error").isNull(),
        "wrong_or_unknown_judged": judged & ~F.coalesce(F.col("correct"), F.lit(False)),
        "wrong_without_error": none & ~F.col("correct"),
        "without_error": none,
        "with_error": wrong,
        "error_located": located,
        "error_unlocated": wrong & F.col("error_pos").isNull(),
        "error_within": located & F.col("within"),
        "error_beyond": located & ~F.col("within"),
    }
    n = {name: F.count_if(F.coalesce(c, F.lit(False))) for name, c in counters.items()}
    share = lambda a, b: F.try_divide(n[a].cast("double"), n[b])
    return cases.agg(
        *[c.alias(name) for name, c in n.items()],
        share("error_within", "error_located").alias("within_of_located"),
        share("without_error", "judged").alias("without_error_of_judged"),
        share("parse_failed", "judged").alias("parse_failed_of_judged"),
    )


def aligned_loss(terms: DataFrame, clip: float | None = None) -> DataFrame:
    """Summed log-probabilities of alignment groups, their clipped difference, mean per sequence, weighted mean."""
    group = terms.groupBy("seq_id", "group_id").agg(
        F.sum("student_logp").alias("s"),
        F.sum("teacher_logp").alias("t"),
        F.first("seq_weight").alias("w"),
    )
    raw = F.col("s") - F.col("t")
    term: Column = raw if clip is None else F.greatest(F.least(raw, F.lit(clip)), F.lit(-clip))
    per = group.groupBy("seq_id").agg(F.avg(term).alias("m"), F.first("w").alias("w"))
    return per.agg(F.coalesce(F.sum(F.col("m") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0)), F.lit(0.0)).alias("loss"))
