"""Connected components of a table of edges, by alternating large-star and small-star steps.

What is left of the edges is solved by one task once it has no more than
``ONE_TASK`` rows, a bound on that task's memory; both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch


#: Edges that one task may hold, about 100 MB in its worker.
ONE_TASK = 300_000


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, keep: Scratch, tag: str = "cc") -> DataFrame:
    """(id, component) of every vertex in ``edges`` (a long, b long): the smallest id reachable.

    Each step groups and joins on vertices and is written to the shared folder;
    vertices of high degree are aggregated before the shuffle and their joins
    are split by adaptive execution.  Nothing but a count and a checksum
    reaches the driver.  Self loops and repeated edges are allowed.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before, step = keep.table(both, f"{tag}0"), None, 0
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said[0] <= ONE_TASK:
            return keep.table(now.coalesce(1).mapInArrow(_solved, "id long, component long"), f"{tag}_solved")
        if said == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = said
        # large star: neighbours above u move to the least neighbour of u
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours move to the least of them
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        now = keep.table(following, f"{tag}{step}")
        keep.drop(f"{tag}{step - 1}")
