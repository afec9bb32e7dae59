"""Numeric band join: every item with the lines of other items at a near unit price.

Prices become cents, and a line's unit price ``u`` is its amount by its
quantity.  An item of price ``p`` pairs with the lines whose gap ``|u - p|`` is
at most ``max(CENTS, p div SHARE)``, which is a closed interval of ``u`` whose
both ends grow with ``p``.

Lines are added up by (u, item) and then by u before they are dealt out, with
counts, sums of checksums and the first lines; so no number of equal lines
weighs more than one row.  What is left is cut into ranges of ``u`` at its
quantiles.  Items go to each range that their interval meets.  A range with
many items or lines is split by the hash of the item: an item's own lines,
which it must not pair with, meet it there, while the sums by ``u``, a few rows,
go to every part.  In each part items by price and sums by ``u`` are merged:
three pointers that only go forward hold the sums of the window, own lines are
taken off by prefix sums, and the nearest lines are read outwards from the
price.  Sums and nearest lines of a few ranges are merged for each item.

For a window of all lines but those of one item the first ``FIRST`` are among
the first ``2 * FIRST`` of those that are left when each (u, item) keeps its
first ``FIRST``; so each ``u`` keeps that many lines and loses none that counts.

Defined results: equal items (item_id and price) are equal rows each; repeated
lines each count and take a rank each.  A line pairs with nothing if sale_id,
item_id, quantity or amount is null, its quantity is 0, its amount is not finite
or its cents do not fit 64 bits; so does an item without item_id or with such a
price: its row has rank 0.  A null line_no comes before others.  Sums stop at
the largest 64-bit number.  Empty tables give no rows, or items without pairs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, parts

#: Gap in cents that is always near, and the price's share that is near else: p / SHARE.
CENTS, SHARE = 10, 500
#: Pairs listed for each item.
FIRST = 5
#: Ranges of u, and parts in all, as a multiple of the shuffle partitions.
RANGES, PIECES = 1, 2
#: Copies of a row of the result that one task writes out.
COPIES = 10_000
_MOST = 2**63 - 1
_LINE = "struct<sale_id:bigint,line_no:bigint,line_item_id:bigint>"
_PAIR = "struct<gap:bigint,u:bigint,sale_id:bigint,line_no:bigint,line_item_id:bigint>"
_ROW = f"kind int, u bigint, item_id bigint, hash bigint, n bigint, crc bigint, first array<{_LINE}>"
_PART = f"item_id bigint, p bigint, copies bigint, n_pairs bigint, gap_sum bigint, lines_crc bigint, first array<{_PAIR}>"
#: Kinds of rows: sums of all lines of one u, those of one item's lines, items.
ALL, OWN, ITEM = 0, 1, 2


def cents(x: Column) -> Column:
    """floor(100 x + 0.5) in doubles; null where that is no 64-bit number."""
    scaled = x.cast("double") * 100 + 0.5
    return F.floor(F.when(F.abs(scaled) < float(2**63), scaled))


def _floor_units(a: Column, q: Column) -> Column:
    """floor((2 a + q) / (2 q)) for q > 0: what a leaves by q is rounded half up, so nothing exceeds 64 bits."""
    rest = F.pmod(a, q)
    return F.call_function("div", a - rest, q) + F.when(rest >= q - rest, 1).otherwise(0)


def reach(p: int) -> int:
    """The largest gap that is near a price of ``p`` cents."""
    return max(CENTS, p // SHARE)


def _near_lines(lines: DataFrame) -> DataFrame:
    """u, item and place of the lines that can pair, with the checksum of each."""
    ids = [F.col(c).cast("bigint").alias(c) for c in ("sale_id", "line_no", "item_id")]
    got = lines.where("quantity <> 0 and sale_id is not null and item_id is not null")
    got = got.select(*ids, cents(F.col("amount")).alias("a"), F.col("quantity").cast("bigint").alias("q")).where("a is not null")
    below = F.col("q") < 0
    u = F.when(below, _floor_units(-F.col("a"), -F.col("q"))).otherwise(_floor_units(F.col("a"), F.col("q")))
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "line_no", "item_id")])
    return got.select("sale_id", "line_no", "item_id", u.alias("u"), F.crc32(text).alias("crc"))


def _first(lines: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first lines of each group; Spark's limit of window groups cuts before the shuffle, too."""
    names = ", ".join(by)
    order = ", ".join(c for c in ("sale_id", "line_no", "item_id") if c not in by)
    rank = F.expr(f"row_number() over (partition by {names} order by {order})")
    return lines.withColumn("k", rank).where(F.col("k") <= most).drop("k")


def summed(lines: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sums of lines by (u, item), and those by u with the first lines."""
    cells = keep.table(lines.groupBy("u", "item_id").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "cells")
    few = _first(_first(lines.select("u", "item_id", "sale_id", "line_no"), ["u", "item_id"], FIRST), ["u"], 2 * FIRST)
    first = few.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("sale_id", "line_no", F.col("item_id").alias("line_item_id")))).alias("first"))
    sums = cells.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    return cells, keep.table(sums.join(first, "u"), "sums")


def _dealt(batches: Iterator[pa.RecordBatch], cuts: list[int], splits: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Rows with their range and the split in it; items once for each range they meet, sums for each split."""
    cuts_, many = np.array(cuts, np.int64), np.array(splits or [1] * (len(cuts) + 1), np.int64)
    for batch in batches:
        kind, u, hashed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "u", "hash"))
        width = np.where(kind == ITEM, np.maximum(CENTS, u // SHARE), 0)
        low = np.where(u < -(2**63) + width, -(2**63), u - width)
        high = np.where(u > _MOST - width, _MOST, u + width)
        a, b = (np.searchsorted(cuts_, x, "right") for x in (low, high))
        n = b - a + 1
        at = np.repeat(np.arange(len(u)), n)
        part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + a[at]
        to_all = kind[at] == ALL
        copies = np.where(to_all, many[part], 1)
        first = np.cumsum(copies) - copies
        order = np.repeat(np.arange(len(at)), copies)
        split = np.where(to_all[order], np.arange(len(order)) - first[order], hashed[at][order] % many[part][order])
        rows = batch.take(pa.array(at[order])) if splits else batch.select(["kind"]).take(pa.array(at[order]))
        named = {"part": pa.array(part[order], pa.int32()), "split": pa.array(split, pa.int32())}
        yield pa.RecordBatch.from_pydict(named | {c: rows.column(c) for c in rows.schema.names})


def merged(table: pa.Table) -> pa.Table:
    """Items of one part with its lines: counts, sums and nearest lines, for one range of u."""
    kind = table.column("kind").to_numpy()
    took = {k: table.take(pa.array(np.flatnonzero(kind == k))) for k in (ALL, OWN, ITEM)}
    sums = took[ALL].sort_by("u")
    us, ns, crcs, lines = (sums.column(c).to_pylist() for c in ("u", "n", "crc", "first"))
    cells = took[OWN].sort_by([("item_id", "ascending"), ("u", "ascending")])
    owner, at_u, own_n, own_crc = (cells.column(c).to_pylist() for c in ("item_id", "u", "n", "crc"))
    sum_n, sum_crc = [0, *accumulate(own_n)], [0, *accumulate(own_crc)]
    sum_u = [0, *accumulate(n * u for n, u in zip(own_n, at_u, strict=True))]
    span: dict[int, tuple[int, int]] = {}
    for k, item in enumerate(owner):
        span[item] = (span.get(item, (k,))[0], k + 1)
    items = took[ITEM].sort_by("u")
    left = mid = right = below_n = below_u = above_n = above_u = crc = 0
    out = []
    for item, p, copies in zip(*(items.column(c).to_pylist() for c in ("item_id", "u", "n")), strict=True):
        low, high = p - reach(p), p + reach(p)
        while right < len(us) and us[right] <= high:
            above_n, above_u, crc = above_n + ns[right], above_u + ns[right] * us[right], crc + crcs[right]
            right += 1
        while mid < right and us[mid] <= p:
            above_n, above_u = above_n - ns[mid], above_u - ns[mid] * us[mid]
            below_n, below_u = below_n + ns[mid], below_u + ns[mid] * us[mid]
            mid += 1
        while left < mid and us[left] < low:
            below_n, below_u, crc = below_n - ns[left], below_u - ns[left] * us[left], crc - crcs[left]
            left += 1
        a, b = span.get(item, (0, 0))
        x, y, z = (bisect_left(at_u, low, a, b), bisect_right(at_u, p, a, b), bisect_right(at_u, high, a, b))
        n = below_n + above_n - (sum_n[z] - sum_n[x])
        under = p * (below_n - sum_n[y] + sum_n[x]) - (below_u - sum_u[y] + sum_u[x])
        over = (above_u - sum_u[z] + sum_u[y]) - p * (above_n - sum_n[z] + sum_n[y])
        first: list[tuple] = []
        i, j = mid - 1, mid
        while len(first) < min(FIRST, n) and (i >= left or j < right):
            if i >= left and (j >= right or p - us[i] <= us[j] - p):
                k, i = i, i - 1
            else:
                k, j = j, j + 1
            for line in lines[k]:
                if line["line_item_id"] != item and len(first) < FIRST:
                    first.append({"gap": abs(us[k] - p), "u": us[k], **line})
        out.append((item, p, copies, n, min(under + over, _MOST), min(crc - (sum_crc[z] - sum_crc[x]), _MOST), first))
    names = ("item_id", "p", "copies", "n_pairs", "gap_sum", "lines_crc", "first")
    columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
    pair = pa.struct([(c, pa.int64()) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")])
    kinds = [pa.int64()] * 6 + [pa.list_(pair)]
    return pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, kinds, strict=True)})


def near_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """The first pairs of each item, by gap, u, sale_id, line_no and line_item_id, and sums over all its pairs.

    ``lines`` has sale_id, line_no, item_id, quantity and amount, ``items`` has
    item_id and price.  An item without pairs has one row of rank 0.
    """
    spark = lines.sparkSession
    keep = Scratch(spark)
    many = parts(spark)
    cells, sums = summed(_near_lines(lines), keep)
    priced = items.select(F.col("item_id").cast("bigint").alias("item_id"), cents(F.col("price")).alias("p"))
    can = F.col("item_id").isNotNull() & F.col("p").isNotNull()
    asked = priced.where(can).groupBy("item_id", "p").agg(F.count("*").alias("n"))
    none = F.lit(None)
    empty = F.array().cast(f"array<{_LINE}>")
    hashed = F.pmod(F.xxhash64("item_id"), F.lit(2**62)).alias("hash")
    rows = (
        sums.select(F.lit(ALL).alias("kind"), "u", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("hash"), "n", "crc", "first")
        .unionByName(cells.select(F.lit(OWN).alias("kind"), "u", "item_id", hashed, "n", "crc", empty.alias("first")))
        .unionByName(asked.select(F.lit(ITEM).alias("kind"), F.col("p").alias("u"), "item_id", hashed, "n", none.cast("bigint").alias("crc"), empty.alias("first")))
    )
    rows = keep.table(rows, "rows")
    at = [k / (RANGES * many) for k in range(1, RANGES * many)]
    owned = F.when(F.col("kind") == OWN, F.col("u"))
    copies = F.max(F.when(F.col("kind") == ITEM, F.col("n")))
    asks = rows.agg(F.percentile_approx(owned, at or [0.5], 100 * many).alias("cuts"), copies.alias("copies")).first()
    cuts = sorted(set(asks["cuts"] or []))
    # rows of each range: a few numbers for each, as many as the shuffle partitions ask for
    weigh = rows.where(F.col("kind") != ALL).select("kind", "u", "hash")
    weight = weigh.mapInArrow(lambda b: _dealt(b, cuts, None), "part int, split int, kind int").groupBy("part").count().collect()
    total = sum(w["count"] for w in weight)
    splits = [1] * (len(cuts) + 1)
    for w in weight:
        splits[w["part"]] = -(-w["count"] * PIECES * many // max(1, total))
    spread = rows.mapInArrow(lambda b: _dealt(b, cuts, splits), f"part int, split int, {_ROW}")
    found = spread.groupBy("part", "split").applyInArrow(merged, _PART)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, FIRST)
    totals = [F.coalesce(F.try_sum(c), F.lit(_MOST)).alias(c) for c in ("n_pairs", "gap_sum", "lines_crc")]
    each = found.groupBy("item_id", "p", "copies").agg(*totals, best.alias("first"))
    lost = priced.where(~can).select("item_id", F.lit(1).cast("bigint").alias("copies"), *[F.lit(0).cast("bigint").alias(c) for c in ("n_pairs", "gap_sum", "lines_crc")])
    each = each.drop("p").unionByName(lost.withColumn("first", F.array().cast(f"array<{_PAIR}>")))
    return _ranked(_copied(each, (asks["copies"] or 0) > COPIES))


def _copied(each: DataFrame, many: bool) -> DataFrame:
    """A row for each copy; many copies are written out by several tasks."""
    last = F.col("copies") - 1
    sets = each.withColumn("set", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / COPIES))))
    if many:
        sets = sets.repartition(parts(each.sparkSession), "item_id", "set")
    of_set = F.sequence(F.col("set") * COPIES, F.least(last, F.col("set") * COPIES + COPIES - 1))
    return sets.withColumn("copy", F.explode(of_set)).drop("copies", "set", "copy")


def _ranked(each: DataFrame) -> DataFrame:
    each = each.select("*", F.posexplode_outer("first"))
    wide = [F.col(f"col.{c}").alias(c) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")]
    rank = F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("rank")
    return each.select("item_id", rank, *wide, "n_pairs", "gap_sum", "lines_crc")
