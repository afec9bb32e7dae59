"""Near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of ``limit`` is a distance of
eps = sqrt(2 - 2 limit).  Projected on their leading principal directions they
fall into grid cells of side eps; one more coordinate is the length of what the
directions leave out, which differs by no more than the distance either.  Vectors
of a label are sorted by cells and cut into blocks, and two intervals of the sequence are joined recursively
unless their cells are provably more than eps apart in some direction.  Pairs
that remain are judged by the cosine in double precision.

Equal vectors of a label are one vertex that carries its number of copies.
A block holds ``TILE`` bytes of vectors, since a vector is sent to a task once
for each block near its own.  Blocks meet by an equi-join on the cells of the
first direction that they span, widened by one; a block with very many
neighbours is thus shared among tasks of one pair of blocks each.  Each pair of
blocks returns link counts of its members and a spanning forest, never its
pairs, which it holds for one pair of leaves at a time.

Vectors are scaled by a power of two first, which is exact, so that no norm
overflows or vanishes.  Vectors that are null, empty, zero or hold a null or non-finite component, and
those without a label, link with nothing.  Vectors of different lengths never
link.  Null ids are carried and never linked; ids are taken as keys, a repeated
id counts as another vector and shares its component.  Empty tables work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.packing import of_table
from quern.llm.scratch import Scratch

LIMIT, DIRECTIONS, FIT, LEAF = 0.98, 4, 4_000, 128
#: Bytes of the vectors of a block.
TILE = 16 << 20
#: Cosines as close as this to the limit are taken again from the vectors themselves.
CLOSE = 1e-9
#: What cells are wider than the largest distance, so that no rounding parts a pair.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that their largest component is in [0.5, 1)."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(sample: list[list[float]], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of a bounded sample."""
    x = _unit(_scaled(np.array(sample, float)))
    mean = x.mean(axis=0)
    _, _, right = np.linalg.svd(x - mean, full_matrices=False)
    return mean, right[:count]


def _cells(fitted: dict[int, tuple[np.ndarray, np.ndarray]], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            sizes = np.array([len(v) for v in vectors]) if len(vectors) else np.zeros(0, int)
            cells: list[list[int]] = [[] for _ in range(len(vectors))]
            for d in set(sizes.tolist()):
                own = np.flatnonzero(sizes == d)
                mean, right = fitted[d]
                x = _unit(_scaled(_matrix(vectors.take(pa.array(own))))) - mean
                along = x @ right.T
                beside = np.linalg.norm(x - along @ right, axis=1, keepdims=True)
                at = np.floor(np.append(along, beside, axis=1) / eps).astype(np.int64)
                for i, c in zip(own.tolist(), at.tolist(), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cell"])

    return run


class _Pairs:
    """Recursive join of intervals of sorted vectors: link counts, and edges that connect what is linked."""

    def __init__(self, raw: np.ndarray, cells: np.ndarray, copies: np.ndarray, limit: float):
        self.raw, self.unit, self.cells, self.copies, self.limit = raw, _unit(raw), cells, copies, limit
        self.links = np.zeros(len(raw), np.int64)
        self.group = np.arange(len(raw))
        self.edges: list[tuple[int, int]] = []

    def leaf(self, i: int, j: int, k: int, m: int) -> None:
        cosine = self.unit[i:j] @ self.unit[k:m].T
        near = cosine >= self.limit
        x, y = np.nonzero(np.abs(cosine - self.limit) <= CLOSE)
        if len(x):
            u, v = self.raw[x + i], self.raw[y + k]
            near[x, y] = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))) >= self.limit
        if i == k:
            near = np.triu(near, 1)
        if not near.any():
            return
        self.links[i:j] += near @ self.copies[k:m]
        self.links[k:m] += self.copies[i:j] @ near
        x, y = np.nonzero(near & (self.group[i:j, None] != self.group[None, k:m]))
        for a, b in zip((x + i).tolist(), (y + k).tolist(), strict=True):
            if self.group[a] != self.group[b]:
                self.edges.append((a, b))
                self.group[self.group == self.group[b]] = self.group[a]

    def join(self, i: int, j: int, k: int, m: int) -> None:
        """Members i to j with k to m; an interval with itself is halved on both sides at once."""
        if i >= j or k >= m:
            return
        a, b = self.cells[i:j], self.cells[k:m]
        if ((a.min(axis=0) > b.max(axis=0) + 1) | (b.min(axis=0) > a.max(axis=0) + 1)).any():
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.leaf(i, j, k, m)
        elif (i, j) == (k, m):
            h = (i + j) // 2
            self.join(i, h, i, h)
            self.join(i, h, h, j)
            self.join(h, j, h, j)
        elif j - i >= m - k:
            h = (i + j) // 2
            self.join(i, h, k, m)
            self.join(h, j, k, m)
        else:
            h = (k + m) // 2
            self.join(i, j, k, h)
            self.join(i, j, h, m)


def _linked(table: pa.Table, limit: float) -> pa.Table:
    """One task: block p with itself or with block q.  kind 0: id, links and digest of a vertex; kind 1: an edge of ids."""
    block, first = table["block"].to_numpy(), table["p"][0].as_py()
    cells = _matrix(table["cell"])
    order = np.lexsort((table["id"].to_numpy(), *cells.T[::-1], block != first))
    ids, copies = table["id"].to_numpy()[order], table["copies"].to_numpy()[order]
    raw = _scaled(_matrix(table["v"])[order].astype(float))
    pairs = _Pairs(raw, cells[order], copies, limit)
    n, own = len(ids), int((block == first).sum())
    if first == table["q"][0].as_py():
        pairs.join(0, n, 0, n)
    else:
        pairs.join(0, own, own, n)
    some = np.flatnonzero(pairs.links)
    kind = np.append(np.zeros(len(some), np.int32), np.ones(len(pairs.edges), np.int32))
    edges = np.array(pairs.edges, np.int64).reshape(-1, 2)
    a = np.append(ids[some], ids[edges[:, 0]])
    b = np.append(pairs.links[some], ids[edges[:, 1]])
    d = np.append(table["d"].to_numpy()[order][some], np.zeros(len(edges), np.int64))
    return pa.table({"kind": kind, "a": a.astype(np.int64), "b": b.astype(np.int64), "d": d.astype(np.int64)})


def near_vectors(
    vectors: DataFrame,
    limit: float = LIMIT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark, keep = vectors.sparkSession, Scratch(vectors.sparkSession)
    eps = math.sqrt(2 - 2 * limit) * (1 + SLACK) + SLACK
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        v.alias("v"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    rows = keep.table(rows.withColumn("good", good).withColumn("d", F.xxhash64("v", "label")), "rows")
    usable = rows.where("good")
    same = keep.table(usable.groupBy("label", "v", "d").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "same")
    # principal directions of each vector length, from a bounded sample
    h = F.xxhash64("id")
    fitted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (size,) in same.select(F.size("v")).distinct().collect():
        sample = same.where(F.size("v") == size).orderBy(h, "id").limit(FIT).select("v").collect()
        fitted[size] = _directions([r[0] for r in sample], DIRECTIONS)
    group = F.concat_ws(":", F.size("v").cast("string"), "label")
    named = same.select("id", "d", "copies", "v", group.alias("g")).mapInArrow(
        _cells(fitted, eps),
        "id long, d long, copies long, v array<double>, g string, cell array<long>",
    )
    # the sequence in grid order, numbered within each group across range partitions and cut into blocks
    longest = max(fitted, default=1)
    ranges = max(1, -(-same.count() * longest * 8 // TILE))
    placed = named.repartitionByRange(ranges, "g", "cell", "id").sortWithinPartitions("g", "cell", "id").withColumn(
        "m",
        F.monotonically_increasing_id(),
    )
    placed = keep.table(placed, "placed")
    part = F.shiftright("m", 33)
    counts = placed.groupBy("g", part.alias("part")).agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("g", "part", "first", "base")
    rank = F.col("base") + F.col("m") - F.col("first")
    rows_of = F.greatest(F.lit(LEAF), F.lit(TILE) / (8 * F.size("v")))
    block = F.xxhash64("g", F.floor(rank / F.floor(rows_of)))
    numbered = placed.withColumn("part", part).join(bases, ["g", "part"])
    blocked = keep.table(numbered.select("id", "d", "copies", "v", "g", "cell", block.alias("block")), "blocked")
    keep.drop("placed")
    at = [F.get("cell", F.lit(k)) for k in range(DIRECTIONS + 1)]
    sides = [f(c).alias(f"{n}{k}") for k, c in enumerate(at) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = keep.table(blocked.groupBy("block").agg(F.first("g").alias("g"), *sides), "boxes")
    left = boxes.select("g", F.explode(F.sequence("lo0", "hi0")).alias("s"), *[F.col(c).alias(f"p_{c}") for c in boxes.columns if c != "g"])
    right = boxes.select(
        "g",
        F.explode(F.sequence(F.col("lo0") - 1, F.col("hi0") + 1)).alias("s"),
        *[F.col(c).alias(f"q_{c}") for c in boxes.columns if c != "g"],
    )
    near = F.col("p_block") <= F.col("q_block")
    for k in range(1, DIRECTIONS + 1):
        near &= F.coalesce((F.col(f"p_lo{k}") <= F.col(f"q_hi{k}") + 1) & (F.col(f"q_lo{k}") <= F.col(f"p_hi{k}") + 1), F.lit(True))
    pairs = keep.table(
        left.join(right, ["g", "s"]).where(near).select(F.col("p_block").alias("p"), F.col("q_block").alias("q")).distinct(),
        "pairs",
    )
    sides = pairs.select("p", "q", F.col("p").alias("block")).unionByName(pairs.where("p <> q").select("p", "q", F.col("q").alias("block")))
    tasks = sides.join(blocked.select("block", "id", "d", "copies", "v", "cell"), "block")
    found = keep.table(tasks.groupBy("p", "q").applyInArrow(of_table(_linked, limit=limit), "kind int, a long, b long, d long"), "found")
    labels = components(found.where("kind = 1").select("a", "b"), keep)
    links = found.where("kind = 0").groupBy(F.col("a").alias("id"), "d").agg(F.sum("b").alias("more"))
    vertex = same.join(links, ["id", "d"], "left").join(labels, "id", "left").select(
        "label",
        "v",
        "d",
        (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"),
        F.coalesce("component", "id").alias("component"),
    )
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    joined = rows.where("good").join(vertex, ["label", "v", "d"]).select("id", "n", "component").unionByName(alone)
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
