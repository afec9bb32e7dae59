"""Minimax contiguous partition of ordered atomic groups into shards.

Documents with equal text form a group that is never cut; groups are ordered
by the hash of their text.  The least capacity at which a greedy pass needs no
more than the given number of shards is found by binary search, and the cuts
are made there.

The search needs group sizes only near the cuts.  It starts from the totals of
4,096 ranges of the hash, derives a lower bound of the capacity (ranges with
more than one group may be cut anywhere) and an upper bound (ranges are
whole), and asks for finer ranges only where some capacity between the bounds
could cut; it ends when the bounds meet.  Each round is one aggregation whose
result is bounded by the number of shards, not by the data.

Null texts have no bytes and form one group; null ids are kept; repeated rows
are rows of their own.  An empty table gives an empty result.  DataFrame
functions only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

FIRST_BITS, MORE_BITS, ROW_BYTES, CELL_ROWS = 12, 5, 16, 50_000


@dataclass(frozen=True)
class Unit:
    """A range of ordered hashes: those whose leading ``bits`` equal ``bin`` (signed)."""

    bin: int
    bits: int
    total: int
    atomic: bool
    most: int  # bytes of its largest group

    @property
    def start(self) -> int:
        return self.bin << (64 - self.bits)


def _greedy(units: list[Unit], capacity: int, split: bool) -> list[int] | None:
    """Byte positions of the cuts; None where a unit that stays whole exceeds the capacity."""
    cuts, filled, at = [], 0, 0
    for u in units:
        left = u.total
        if split and not u.atomic:
            while filled + left > capacity:
                part = capacity - filled
                at, left, filled = at + part, left - part, 0
                cuts.append(at)
            filled, at = filled + left, at + left
            continue
        if left > capacity:
            return None
        if filled + left > capacity:
            cuts.append(at)
            filled = 0
        filled, at = filled + left, at + left
    return cuts


def _least(units: list[Unit], shards: int, split: bool) -> int:
    total = sum(u.total for u in units)
    low, high = max(1, -(-total // shards), *(u.most for u in units)), max(1, total)
    while low < high:
        middle = (low + high) // 2
        cuts = _greedy(units, middle, split)
        if cuts is not None and len(cuts) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def _open(units: list[Unit], low: int, high: int, shards: int) -> set[int]:
    """Places of the units with several groups where a capacity in [low, high] may cut."""
    starts = [0, *accumulate(u.total for u in units)]
    latest = _greedy(units, high, True) or []
    # a shard that begins at s ends no earlier than the start of the unit that holds s + low,
    # and two shards in a row hold more than the capacity
    earliest = [0, 0]
    for _ in range(shards - 1):
        s = earliest[-1]
        unit = bisect_right(starts, s + low) - 1
        earliest.append(max(s, starts[min(unit, len(units))], earliest[-2] + low if len(earliest) > 2 else 0))
    out = set()
    for j in range(shards - 1):
        a, b = earliest[j + 2], latest[j] if j < len(latest) else starts[-1]
        if a >= starts[-1]:
            break
        first, last = max(0, bisect_left(starts, a) - 1), min(len(units), bisect_right(starts, b))
        out |= {i for i in range(first, last) if not units[i].atomic}
    return out


def cuts_of(groups: DataFrame, shards: int) -> list[int]:
    """Least hash of every shard but the first; ``groups`` has key (long) and bytes (long), a row for each key."""

    def totals(of: DataFrame, bits: int) -> list[Unit]:
        got = of.groupBy(F.shiftright("key", 64 - bits).alias("bin")).agg(
            F.sum("bytes").alias("total"),
            F.count("*").alias("n"),
            F.max("bytes").alias("most"),
        )
        return sorted((Unit(r.bin, bits, r.total, r.n == 1, r.most) for r in got.collect()), key=lambda u: u.start)

    bits = FIRST_BITS
    units = totals(groups, bits)
    while units:
        low, high = _least(units, shards, True), _least(units, shards, False)
        finer = {i for i in _open(units, low, high, shards) if units[i].bits == bits} if low < high else set()
        if not finer:
            cuts, out, at, j = _greedy(units, high, False), [], 0, 0
            for u in units:
                while j < len(cuts) and cuts[j] == at:
                    out.append(u.start)
                    j += 1
                at += u.total
            return out
        wanted = groups.sparkSession.createDataFrame([(units[i].bin,) for i in sorted(finer)], "bin long")
        inside = groups.withColumn("bin", F.shiftright("key", 64 - bits)).join(F.broadcast(wanted), "bin", "left_semi")
        bits = min(64, bits + MORE_BITS)
        units = sorted([u for i, u in enumerate(units) if i not in finer] + totals(inside, bits), key=lambda u: u.start)
    return []


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    keep = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("u"),
    )
    rows = keep.table(rows, "rows")
    groups = keep.table(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    cuts = cuts_of(groups, shards)
    number = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    cells = max(1, -(-rows.count() // (shards * CELL_ROWS)))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        number.cast("int").alias("shard"),
        F.pmod(F.xxhash64("u"), F.lit(cells)).alias("cell"),
        "u",
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().select(
        "shard",
        "cell",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"),
    )
    inside = placed.withColumn("r", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("u")))
    return inside.join(offsets, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("r") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
