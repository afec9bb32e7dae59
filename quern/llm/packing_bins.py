"""Best-fit packing of token pieces by minimum bin slack.

A document is its token ids and a closing id.  Documents longer than a bin are
cut into whole bins, the first piece taking the rest.  Pieces of one length
are alike, so packing works on the counts of lengths, which are bounded by the
capacity however many documents there are: for each bin the largest remaining
length is taken, a bitset of the sums that other remaining lengths can reach
finds the fullest feasible combination, and that pattern is repeated as often
as the counts allow.  Pieces are then dealt to the places of the patterns by
their number within their length.

Null and empty texts are the closing id alone; null ids are carried; repeated
rows are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch
from quern.llm.tokens import VOCABULARY, ids_of

CAPACITY, CLOSING, CELL_ROWS = 2048, 0, 50_000


def _pieces(name: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, closing = ids_of(name), np.array([CLOSING], "<u4")
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(len(texts)):
                all_ids = np.concatenate([ids(texts[i].as_py()), closing])
                first = len(all_ids) - capacity * ((len(all_ids) - 1) // capacity)
                at = 0
                for k, end in enumerate(range(first, len(all_ids) + 1, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(all_ids[at:end].tobytes()))
                    at = end
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, none used above its count, with the greatest sum up to ``room``; larger lengths first."""
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for x in lengths:
        n, step = min(counts[x], room // x), 1
        while n and not reach >> room & 1:  # counts in binary parts: 1, 2, 4 ... and the rest
            part = min(step, n)
            layers.append((x * part, x, part, reach))
            reach |= reach << x * part & mask
            n, step = n - part, step * 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, []
    for weight, x, part, before in reversed(layers):
        if not before >> left & 1:
            left -= weight
            out += [x] * part
    return out


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, times) until every counted piece is placed."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        bin_ = [largest, *fullest(left, capacity - largest)]
        left[largest] += 1
        use = {x: bin_.count(x) for x in bin_}
        times = min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        out.append((bin_, times))
    return out


def _places(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first number, end, pieces per bin, place in the length's run, first bin, offset)."""
    taken: dict[int, int] = {}
    out, bins = [], 0
    for bin_, times in found:
        per = {x: bin_.count(x) for x in bin_}
        seen: dict[int, int] = {}
        offset = 0
        for x in bin_:
            k = seen.get(x, 0)
            seen[x] = k + 1
            out.append((x, taken.get(x, 0), taken.get(x, 0) + times * per[x], per[x], k, bins, offset))
            offset += x
        for x, n in per.items():
            taken[x] = taken.get(x, 0) + times * n
        bins += times
    return out


def pack_sequences(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark, keep = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = keep.table(pieces.withColumn("u", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = spark.createDataFrame(
        _places(patterns(counts, capacity)),
        "length long, lo long, hi long, per long, k long, bins long, offset long",
    )
    cells = max(1, -(-sum(counts.values()) // CELL_ROWS))
    celled = pieces.withColumn("cell", F.pmod(F.xxhash64("u"), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = celled.groupBy("length", "cell").count().select(
        "length",
        "cell",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"),
    )
    inside = celled.withColumn("r", F.row_number().over(Window.partitionBy("length", "cell").orderBy("u")) - 1)
    numbered = inside.join(base, ["length", "cell"]).withColumn("n", F.col("base") + F.col("r"))
    # the runs of a length, in order, as one array: a few entries for each length
    runs = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "per", "k", "bins", "offset"))).alias("runs"))
    chosen = F.filter("runs", lambda x: (x.lo <= F.col("n")) & (F.col("n") < x.hi) & (F.pmod(F.col("n") - x.lo, x.per) == x.k))[0]
    placed = numbered.join(F.broadcast(runs), "length").withColumn("x", chosen)
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("x.bins") + F.floor((F.col("n") - F.col("x.lo")) / F.col("x.per"))).cast("long").alias("sequence_id"),
        F.col("x.offset").alias("offset"),
    )
