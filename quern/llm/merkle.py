"""Merkle manifest of a dataset: a digest of all rows, and a proof for each row.

A row's leaf is the SHA-256 of its columns, each written as its length in
bytes, ``:`` and its value, or ``-`` for null.  Leaves of a group stand in order
of their key; every ``WIDTH`` neighbours become the digest of their digests
until one is left, the group's subroot, and the subroots in order of the group
(null first) become the root in the same way.

Leaves, not texts, are sorted into ranges by (group, key).  How many leaves a
group has in earlier ranges gives each range the place of its first leaf, so
each range builds every aligned subtree that lies whole within it.  The nodes
at its ragged edges, at most ``2 * WIDTH`` a level and group that goes on in
another range, are shuffled by their coordinate (group, level, run), which
finishes the upper levels; groups that lie in one range leave nothing but their
subroot.  The subroots are the leaves of a second tree of the same make.  Then
the ways from ragged nodes to the root go back to their ranges, where the way of
each leaf through its own subtree is put before them.  A range holds about
``LEAVES`` leaves however large a group is; the driver sees only two numbers.

Defined results: a null group is a group of its own and the first; a null key
comes first in its group; equal keys stand in order of their leaves, and equal
rows are leaves of their own.  An empty table has no rows.  Columns that are not
named play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch, parts

#: Nodes of a run, and leaves of a range about.
WIDTH, LEAVES = 8, 50_000
_WAY = "array<struct<left:string,right:string>>"
_NODE = "part int, g string, start bigint, total bigint, level int, idx bigint, node string"
_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_ORDER = [("g", "ascending"), ("k", "ascending"), ("name", "ascending"), ("leaf", "ascending"), ("tie", "ascending")]


def digest(columns: list[Column]) -> Column:
    """The leaf of a row with these columns."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def subtrees(start: int, total: int, leaves: list[str]) -> list[tuple[int, list[str]]]:
    """Levels of what leaves ``start`` and on make up without others: the first index and the nodes of each."""
    levels = [(start, leaves)]
    while total > 1:
        first, nodes = levels[-1]
        end = first + len(nodes)
        a, b = -(-first // WIDTH), (-(-total // WIDTH) if end == total else end // WIDTH)
        if a >= b:
            break
        runs = range(a * WIDTH - first, b * WIDTH - first, WIDTH)
        levels.append((a, [h("".join(nodes[k : k + WIDTH])) for k in runs]))
        total = -(-total // WIDTH)
    return levels


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=_ORDER, null_placement="at_start"))


def _segments(leaves: pa.Table, places: pa.Table):
    """Rows of each group of a range, with what is known of the group."""
    table = _sorted(leaves)
    known: dict[str, list[dict]] = {}
    for row in places.to_pylist():
        known.setdefault(row["g"], []).append(row)
    groups, at = table.column("g").to_pylist(), 0
    for end in range(1, len(groups) + 1):
        if end == len(groups) or groups[end] != groups[at]:
            yield table.slice(at, end - at), known[groups[at]]
            at = end


def edges(leaves: pa.Table, places: pa.Table) -> pa.Table:
    """The nodes of a range that have no parent in it."""
    out = []
    for segment, (place, *_) in _segments(leaves, places):
        levels = subtrees(place["start"], place["total"], segment.column("leaf").to_pylist())
        for level, (first, nodes) in enumerate(levels):
            a, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
            for k, node in enumerate(nodes, first):
                if not a <= k // WIDTH < a + len(above):
                    out.append(place | {"level": level, "idx": k, "node": node})
    kinds = [("part", pa.int32()), ("g", pa.string()), ("start", pa.int64()), ("total", pa.int64())]
    return pa.Table.from_pylist(out, pa.schema([*kinds, ("level", pa.int32()), ("idx", pa.int64()), ("node", pa.string())]))


def _ways(segment: pa.Table, ways: list[dict]):
    """For each leaf in order its siblings to the left and right at each level up to the root, and all of them joined."""
    start, total = ways[0]["start"], ways[0]["total"]
    levels = subtrees(start, total, segment.column("leaf").to_pylist())
    sides = {(w["level"], w["idx"]): [(s["left"], s["right"]) for s in w["way"]] for w in ways}
    above = {at: (way, "".join(a + b for a, b in way)) for at, way in sides.items()}
    for level in range(len(levels) - 1, -1, -1):
        first, nodes = levels[level]
        for k in range(first, first + len(nodes)):
            if (level, k) in above:
                way = above[level, k]
            else:
                run = k // WIDTH * WIDTH - first
                left, right = "".join(nodes[run : k - first]), "".join(nodes[k - first + 1 : run + WIDTH])
                up, joined = above[level + 1, k // WIDTH]
                way = [(left, right), *up], left + right + joined
            if level:
                above[level, k] = way
            else:
                yield way


def _paths(leaves: pa.Table, places: pa.Table) -> pa.Table:
    """Groups with the way from their subroot to the root."""
    out = []
    for segment, ways in _segments(leaves, places):
        for name, (way, _) in zip(segment.column("name").to_pylist(), _ways(segment, ways), strict=True):
            out.append({"g": name, "root": ways[0]["root"], "way": [{"left": a, "right": b} for a, b in way]})
    return pa.Table.from_pylist(out, pa.schema([("g", pa.string()), ("root", pa.string()), ("way", _SIDES)]))


_PROOF = "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _proofs(leaves: pa.Table, places: pa.Table) -> pa.Table:
    """Leaves with the digest of their proof, and the root that the claimed leaf folds up to."""
    out: dict[str, list] = {c.split()[0]: [] for c in _PROOF.split(", ")}
    for segment, ways in _segments(leaves, places):
        rows = zip(*(segment.column(c).to_pylist() for c in ("k", "leaf", "claimed")), _ways(segment, ways), strict=True)
        for key, leaf, claimed, (way, joined) in rows:
            folded = claimed or leaf
            for left, right in way:
                folded = h(left + folded + right)
            values = (key, leaf, ways[0]["subroot"], ways[0]["root"], h(joined), folded)
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
    kinds = [pa.int64()] + [pa.string()] * 5
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})


class _Forest:
    """A tree for each group of leaves (g, k, name, leaf, tie, claimed)."""

    def __init__(self, leaves: DataFrame, keep: Scratch, name: str):
        self.keep, self.name = keep, name
        spark = leaves.sparkSession
        leaves = keep.table(leaves.withColumn("tie", F.monotonically_increasing_id()), f"{name}-leaves")
        n = leaves.count()
        ranges = max(1, min(parts(spark), n // 1_000), -(-n // LEAVES))
        dealt = leaves.repartitionByRange(ranges, *[F.col(c) for c, _ in _ORDER]).withColumn("part", F.spark_partition_id())
        self.placed = keep.table(dealt, f"{name}-placed")
        counts = self.placed.groupBy("part", "g").agg(F.count("*").alias("n"))
        start = F.expr("coalesce(sum(n) over (partition by g order by part rows between unbounded preceding and 1 preceding), 0)")
        places = counts.select("part", "g", start.alias("start"), F.expr("sum(n) over (partition by g)").alias("total"))
        found = self.placed.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(edges, _NODE)
        self.edges = keep.table(found, f"{name}-edges")
        self._finish()

    def _finish(self) -> None:
        """Runs of the upper levels, from the edges up, and the subroots."""
        most = self.edges.agg(F.max("total")).first()[0] or 0
        self.runs: list[DataFrame] = []
        nodes = self.edges.select("g", "total", "level", "idx", "node")
        here, roots = nodes.where("level = 0"), None
        level, size = 0, F.col("total")
        while True:
            top = here.where(size == 1).select("g", F.col("level"), F.col("node").alias("subroot"))
            roots = top if roots is None else roots.unionByName(top)
            if most <= WIDTH**level:
                break
            order = F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("run")
            runs = here.where(size > 1).groupBy("g", "total", F.expr(f"idx div {WIDTH}").alias("up")).agg(order)
            parent = F.sha2(F.array_join(F.col("run.node"), ""), 256).alias("node")
            runs = self.keep.table(runs.withColumn("node", parent), f"{self.name}-runs{level}")
            self.runs.append(runs)
            level, size = level + 1, F.ceil(size / WIDTH)
            above = runs.select("g", "total", F.lit(level).alias("level"), F.col("up").alias("idx"), "node")
            here = nodes.where(f"level = {level}").unionByName(above)
        self.roots = self.keep.table(roots, f"{self.name}-roots")

    def ways(self, roots: DataFrame) -> DataFrame:
        """The edges with their ways to the root; ``roots`` has g, level, subroot, root and way of each subroot."""
        above = roots.select("g", "level", F.lit(0).cast("bigint").alias("idx"), "subroot", "root", "way")
        tops, found = above, []
        for level in range(len(self.runs), -1, -1):
            here = tops.where(F.col("level") == level)
            if level < len(self.runs):
                side = lambda op: F.array_join(F.transform(F.filter("run", lambda x: op(x["idx"], F.col("child.idx"))), lambda x: x["node"]), "")
                child = self.runs[level].select("g", "up", "run", F.explode("run").alias("child"))
                own = F.struct(side(Column.__lt__).alias("left"), side(Column.__gt__).alias("right"))
                child = child.select("g", "up", F.col("child.idx").alias("idx"), own.alias("own"))
                upper = found[-1].select("g", F.col("idx").alias("up"), "subroot", "root", "way")
                way = F.concat(F.array("own"), "way").cast(_WAY).alias("way")
                down = child.join(upper, ["g", "up"]).select("g", F.lit(level).alias("level"), "idx", "subroot", "root", way)
                here = here.unionByName(down)
            found.append(self.keep.table(here, f"{self.name}-ways{level}"))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return self.edges.drop("node").join(every, ["g", "level", "idx"])

    def each(self, ways: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.placed.groupBy("part").cogroup(ways.groupBy("part")).applyInArrow(f, schema)


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, claimed: dict[str, Column] | None = None) -> DataFrame:
    """A proof for each row: key, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``claimed`` gives other values for some columns; the leaf that they make is
    folded up with the siblings of the true one, and ``verified`` tells whether
    that gives the root.  ``proof_sha256`` is the digest of all siblings from the
    leaf up.  ``key`` is an integer column.
    """
    keep = Scratch(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in columns]
    other = F.lit(None).cast("string")
    if claimed:
        differs = F.lit(False)
        for c, x in claimed.items():
            differs = differs | ~F.col(f"`{c}`").eqNullSafe(x)
        other = F.when(differs, digest([claimed.get(c, x) for c, x in zip(columns, own, strict=True)]))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g")
    leaves = docs.select(named, F.col(f"`{key}`").cast("bigint").alias("k"), F.lit("").alias("name"), digest(own).alias("leaf"), other.alias("claimed"))
    trees = _Forest(leaves, keep, "rows")
    none = F.lit(None).cast("string")
    tops = trees.roots.select(F.lit("").alias("g"), F.lit(0).cast("bigint").alias("k"), F.col("g").alias("name"), F.col("subroot").alias("leaf"), none.alias("claimed"))
    top = _Forest(tops, keep, "groups")
    last = top.roots.withColumn("root", F.col("subroot")).withColumn("way", F.array().cast(_WAY))
    paths = top.each(top.ways(last), _paths, f"g string, root string, way {_WAY}")
    ways = trees.ways(keep.table(trees.roots.join(paths, "g"), "paths"))
    return trees.each(ways, _proofs, _PROOF).withColumn("verified", F.col("folded_root") == F.col("root"))
