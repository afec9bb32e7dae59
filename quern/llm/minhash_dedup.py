"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

A document is the set of its distinct five-word shingles.  Trees branch the
documents by minwise tokens: the root of each of ``TREES`` independent trees
takes two coordinates, so a document follows sixteen paths; a pair of
similarity 0.75 misses all of them with probability 0.25 ** 16.  A node of one
block is compared exhaustively.  In a larger one the members are compared with
a few pivots first, and if they are still in several components the node
chooses two more coordinates by the hash of its path and branches again, until
nodes are small.  The two branches keep a pair at 0.75 with probability 0.89
however deep its path goes, so that one root of it is lost with 0.33 at most
and all sixteen with 0.33 ** 16.  Nodes that are still large after ``LEVELS``
levels, or of few but very long texts, are compared in pairs of blocks.

The first tree links most of what is alike; nodes of the others, and what is
below the first's, are opened only if their members are still in several
components.

Within a node, sketches of 64 minwise values pass pairs that agree in 30 places
or more (a pair at 0.75 fails that once in about a million times) and the
full sets of both texts confirm every link.  Equal sets are one vertex from
the start, nodes with equal members are compared once, and a node's answer is
a spanning forest of its links, so no group emits all of its pairs.

Below the second step only documents of nodes that are still large can be asked
for, so these are dealt anew whenever they have become few, and a level costs
what is left in it, not a pass over the corpus.

Sets hold 64-bit hashes of the shingles, of texts of any size; two different
shingles are equal with probability 2 ** -64.

Null or empty texts have no shingles and link with nothing; with fewer than
five words the whole sequence is the one shingle.  Rows with a null id form
their own component (null) and are kept.  Rows that share an id are one vertex.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.packing import flat, mix, of_table
from quern.llm.scratch import Scratch, parts

TREES, SKETCH, AGREE, LEVELS, PIVOTS = 8, 64, 30, 16, 8
#: What one task compares at most, or twice that for two blocks: members, and shingles of them all.
BLOCK, WEIGHT = 2_048, 4_000_000
#: Members of a task that is compared with others in one call, and members and shingles of such calls, about.
SMALL, BUNDLE, BUNDLE_WEIGHT = 64, 2_048, 200_000
#: Rows of nodes for which there is a task of the executors at least.
ROWS = 8_192
ROOTS = 2 * TREES
_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = mix(np.arange(1001, 1001 + SKETCH, dtype=np.uint64))
#: A set's shingle hashes are random, so their products with random odd numbers order them in ways of their own.
_FACTORS = mix(np.arange(5001, 5001 + SKETCH, dtype=np.uint64)) | np.uint64(1)
_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(6)]
#: Bits by which common shingles are counted from above.
_LOW = 20
_SEVENS, _EIGHTH, _ONES = (np.uint64(x * 0x0101010101010101) for x in (0x7F, 0x80, 0x01))


def shingles(at: np.ndarray, raw: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a flat text column.

    A word's hash sums a random number for each of its bytes at its place, so no
    pattern of letters makes words equal as it can with powers of one base.
    """
    n = len(at) - 1
    none = np.zeros(0, np.uint64)
    if not len(raw):
        return [none] * n
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.append(True, space[:-1]) | edge[:-1]
    after = np.append(space[1:], True) | edge[1:]
    first = ~space & before
    starts, ends = np.flatnonzero(first), np.flatnonzero(~space & after) + 1
    at_byte = np.arange(len(raw))
    place = (at_byte - np.maximum.accumulate(np.where(first, at_byte, 0))).astype(np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mix(_SYMBOL[_LOWER[raw]] + place * np.uint64(_ODD))))
    word = mix(sums[ends] - sums[starts])
    cuts = np.searchsorted(starts, at)
    if len(word) >= size:
        m = len(word) - size + 1
        h = word[:m].copy()
        for k in range(1, size):
            h += word[k : k + m] * _STEP[k]
        h = mix(h)
    else:
        h = none
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(h[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            whole = sum((word[a + k : a + k + 1] * _STEP[k] for k in range(b - a)), np.full(1, 77 + b - a, np.uint64))
            out.append(mix(whole))
        else:
            out.append(none)
    return out


def _slices(at: np.ndarray, size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes, few enough that what is computed of them stays in a processor's cache."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size)))
        j = min(j, len(at) - 1)
        yield i, j
        i = j


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size of the set, two halves of its digest, node keys at the roots, sketch)."""
    for batch in batches:
        at, raw = flat(batch.column(1))
        for i, j in _slices(at):
            sets = shingles(at[i : j + 1] - at[i], raw[at[i] : at[j]])
            n = np.array([len(s) for s in sets], np.int64)
            digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
            least = np.zeros((j - i, SKETCH), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                every = np.concatenate([sets[k] for k in full])
                starts = np.append(0, np.cumsum(n[full])[:-1])
                x = np.empty_like(every)
                for k in range(SKETCH):
                    np.multiply(every, _FACTORS[k], out=x)
                    least[full, k] = np.minimum.reduceat(x, starts)
            keys = mix(least[:, :ROOTS] ^ _SEEDS[:ROOTS]).view(np.int64)
            sketch = (mix(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            offsets = lambda w: pa.array(np.arange(j - i + 1, dtype=np.int32) * w)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(n),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.ListArray.from_arrays(offsets(ROOTS), pa.array(keys.reshape(-1))),
                    pa.ListArray.from_arrays(offsets(SKETCH), pa.array(sketch.reshape(-1))),
                ],
                names=["id", "n", "d1", "d2", "keys", "sketch"],
            )


class _Members:
    """Members of tasks, those of a task together, in it those of side 0 first, by size and id; which of them may link.

    ``side`` 0 is compared with both sides, ``side`` 1 only with 0; members
    that share a label are connected already.
    """

    def __init__(self, table: pa.Table, task: str, n: np.ndarray):
        of, side, ids = (table[c].to_numpy() for c in (task, "side", "id"))
        self.order = np.lexsort((ids, n, side, of))
        self.ids, self.n, self.side, of = ids[self.order], n[self.order], side[self.order], of[self.order]
        self.full = table["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, SKETCH)[self.order]
        # the low byte of each value, eight to a number
        self.low = np.ascontiguousarray((self.full & 0xFF).astype(np.uint8).view(np.uint64).T)
        self.starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        self.ends = np.append(self.starts[1:], len(of))
        self.task = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)

    def small(self) -> np.ndarray:
        """Tasks of which all pairs are looked at together."""
        return self.ends - self.starts <= SMALL

    def pairs(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in all small tasks, in order, that may link."""
        some = self.small()[self.task]
        size = (self.ends - self.starts)[some[self.starts]]
        left, right = [], []
        for d in range(1, int(size.max(initial=0))):
            ok = some[d:] & (self.task[d:] == self.task[:-d]) & (self.side[:-d] == 0) & (label[d:] != label[:-d])
            i = np.flatnonzero(ok)
            least, most = np.minimum(self.n[i], self.n[i + d]), np.maximum(self.n[i], self.n[i + d])
            i = i[100 * least >= 75 * most]
            i = i[(self.full[i] == self.full[i + d]).sum(axis=1) >= AGREE]
            left.append(i)
            right.append(i + d)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((j, i))
        return i[order], j[order]

    def near(self, t: int, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of a task with those behind it that may link with it, by the labels at that time."""
        start, end = int(self.starts[t]), int(self.ends[t])
        first = start + int((self.side[start:end] == 0).sum())
        n = self.n[start:first]
        most = 100 * n // 75
        up_to = start + np.searchsorted(n, most, "right")
        across = self.n[first:end]
        low, high = first + np.searchsorted(across, -(-75 * n // 100)), first + np.searchsorted(across, most, "right")
        for i, *ends in zip(range(start, first), up_to.tolist(), low.tolist(), high.tolist(), strict=True):
            out = []
            for a, b in ((i + 1, ends[0]), (ends[1], ends[2])):
                if a >= b:
                    continue
                # bytes that are equal are zero here; no fewer agree than of the values
                x = self.low[:, a:b] ^ self.low[:, i : i + 1]
                x = ~(((x & _SEVENS) + _SEVENS) | x) & _EIGHTH
                agree = ((x >> np.uint64(7)).sum(axis=0) * _ONES) >> np.uint64(56)
                found = np.flatnonzero((agree >= AGREE) & (label[a:b] != label[i])) + a
                if len(found):
                    out.append(found[(self.full[found] == self.full[i]).sum(axis=1) >= AGREE])
            if out and len(found := np.concatenate(out)):
                yield i, found


def _promising(table: pa.Table) -> pa.Table:
    """Members of tasks with some member of another label that they may link with.

    ``task`` is a digest of what is returned of one, so equal tasks can be told;
    ``alone`` says that it is large.
    """
    members = _Members(table, "key", table["n"].to_numpy())
    label = table["label"].to_numpy()[members.order]
    some = np.zeros(len(label), bool)
    for rows in members.pairs(label):
        some[rows] = True
    for t in np.flatnonzero(~members.small()).tolist():
        for i, near in members.near(t, label):
            some[i] = True
            some[near] = True
    at = np.flatnonzero(some)
    got = table.select(["id", "label", "side", "n"]).take(pa.array(members.order[at]))
    said = np.stack([got[c].to_numpy().astype(np.int64) for c in ("id", "label", "side")], axis=1)
    cuts = np.searchsorted(members.task[at], np.unique(members.task[at])).tolist()
    name, alone = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for a, b in zip(cuts, cuts[1:] + [len(at)] * bool(cuts), strict=True):
        name[a:b] = int.from_bytes(hashlib.blake2b(said[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
        alone[a:b] = b - a > SMALL or members.n[at[a:b]].sum() > BUNDLE_WEIGHT
    return got.add_column(0, "task", pa.array(name)).append_column("alone", pa.array(alone))


def _links(table: pa.Table) -> pa.Table:
    """A spanning forest of the confirmed links of each task."""
    at, raw = flat(table["text"])
    sets = [s for i, j in _slices(at) for s in shingles(at[i : j + 1] - at[i], raw[at[i] : at[j]])]
    members = _Members(table, "task", np.array([len(s) for s in sets]))
    n, sets = members.n, [sets[i] for i in members.order]
    names, label = np.unique(table["label"].to_numpy()[members.order], return_inverse=True)
    group = members.task * len(names) + label
    a, b = [], []

    def confirm(i: int, near: list[int]) -> None:
        for j in near:
            if group[i] == group[j]:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= 75 * (n[i] + n[j] - common):
                a.append(int(members.ids[i]))
                b.append(int(members.ids[j]))
                own = group[members.starts[members.task[i]] : members.ends[members.task[i]]]
                own[own == group[j]] = group[i]

    for i, j in zip(*(x.tolist() for x in members.pairs(group)), strict=True):
        confirm(i, [j])
    seen, low = np.zeros(1 << _LOW, bool), {}
    for t in np.flatnonzero(~members.small()).tolist():
        low = {i: (sets[i] & np.uint64((1 << _LOW) - 1)).astype(np.uint32) for i in range(members.starts[t], members.ends[t])}
        for i, near in members.near(t, group):
            # shingles with the same low bits as one of i are no fewer than the common ones
            seen[low[i]] = True
            hit = seen[np.concatenate([low[j] for j in near.tolist()])]
            most = np.add.reduceat(hit, np.append(0, np.cumsum(n[near])[:-1]), dtype=np.int64)
            seen[low[i]] = False
            confirm(i, near[100 * most >= 75 * (n[i] + n[near] - most)].tolist())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class _Join:
    """The links found so far and what finding more of them needs: ``docs`` has id, n, sketch and text, dealt by id."""

    def __init__(self, docs: DataFrame, keep: Scratch):
        self.docs, self.keep = docs, keep
        self.all = self.asked = docs.count()
        self.dealt = "asked"
        self.edges: list[DataFrame] = []
        self.labels: DataFrame | None = None
        self.step = 0

    def components(self) -> DataFrame | None:
        """(id, component) by the links found so far."""
        if self.labels is None and self.edges:
            self.labels = components(reduce(DataFrame.unionByName, self.edges), self.keep, f"label{len(self.edges)}_")
        return self.labels

    def nodes(self, members: DataFrame) -> DataFrame:
        """(key, id, n, label, size, blocks) of the nodes that still have several labels, those of equal members once."""
        self.step += 1
        labels = self.components()
        if labels is None:
            named = members.select("key", "id", "n", F.col("id").alias("label"))
        else:
            named = members.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("label"))
        signed = named.groupBy("key").agg(
            F.count("*").alias("size"),
            F.sum("n").alias("weight"),
            (F.min("label") < F.max("label")).alias("mixed"),
            *_signature(),
        )
        once = signed.where("mixed").groupBy("size", "s", "x").agg(F.min("key").alias("key"), F.first("weight").alias("weight"))
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("long")
        found = named.join(once.select("key", "size", blocks.alias("blocks")), "key")
        return self.keep.table(found.select("key", "id", "n", "label", "size", "blocks"), f"nodes{self.step}")

    def compare(self, nodes: DataFrame, last: bool = False) -> DataFrame | None:
        """Find the links in nodes: all pairs in those of up to ``BLOCK`` members, pivots in larger ones.

        Returns the larger ones, if there are any; the ``last`` time these are compared in all pairs, too.
        """
        most, rows = nodes.agg(F.max("size"), F.count("*")).first()
        if most is None:
            return None
        small = F.lit(True) if last else F.col("size") <= BLOCK
        tasks = _pairs(nodes.where(small))
        large = None if last or most <= BLOCK else nodes.where(~small)
        if large is not None:
            tasks = tasks.unionByName(_pivots(large))
        # sketches first, and the texts of what they let through; both meet the documents where these lie
        sketched = tasks.hint("shuffle_hash").join(self.docs.select("id", "n", "sketch"), "id")
        n = max(1, min(parts(self.keep.spark), rows // ROWS))  # by the work, not by the few bytes of sketches
        sketched = sketched.withColumn("bundle", _bundle("key", F.col("size") <= SMALL, rows // BUNDLE)).repartition(n, "bundle")
        found = sketched.groupBy("bundle").applyInArrow(of_table(_promising), "task long, id long, label long, side int, n long, alone boolean")
        near = self.keep.table(found.dropDuplicates(["task", "id"]), f"near{self.step}")
        few = near.where("not alone").agg(F.count("*"), F.sum("n")).first()
        if few[0] or not near.isEmpty():
            bundles = max(4 * few[0] // BUNDLE, (few[1] or 0) // BUNDLE_WEIGHT)
            full = near.drop("n").hint("shuffle_hash").join(self.docs.select("id", "sketch", "text"), "id")
            full = full.withColumn("bundle", _bundle("task", ~F.col("alone"), bundles)).drop("alone")
            links = full.groupBy("bundle").applyInArrow(of_table(_links), "a long, b long")
            edges = self.keep.table(links, f"edges{self.step}")
            if not edges.isEmpty():
                self.edges.append(edges)
                self.labels = None
        return large

    def narrow(self, nodes: DataFrame) -> None:
        """Deal the documents of ``nodes`` anew if they are few of those dealt; no others are below these nodes."""
        ids = nodes.select("id").distinct()
        left = ids.count()
        if left * 2 > self.asked:
            return
        buckets = max(1, -(-parts(self.keep.spark) * left // self.all))
        before, self.asked, self.dealt = self.dealt, left, f"asked{self.step}"
        self.docs = self.keep.dealt(self.docs.join(ids, "id", "left_semi"), "id", self.dealt, buckets)
        self.keep.drop(before)

    def children(self, nodes: DataFrame) -> DataFrame:
        """Members of the two nodes below each, by coordinates that the node's path chooses."""
        spread = nodes.hint("shuffle_hash").join(self.docs.select("id", "sketch"), "id").withColumn(
            "b",
            F.explode(F.array(F.lit(0), F.lit(1))),
        )
        at = F.pmod(F.xxhash64("key", "b"), F.lit(SKETCH)).cast("int")
        return spread.select(F.xxhash64("key", "b", at, F.get("sketch", at)).alias("key"), "id", "n")

    def trees(self, members: DataFrame) -> None:
        """Join the nodes (c, key, id, n) below the roots, those of the first tree before the others."""
        first = self.nodes(members.where("c < 2"))
        large = self.compare(first)
        members = members.where("c >= 2").select("key", "id", "n")
        members = members if large is None else members.unionByName(large.select("key", "id", "n"))
        for level in range(LEVELS + 1):
            large = self.compare(self.nodes(members), level == LEVELS)
            if large is None:
                return
            self.narrow(large)
            members = self.children(large)


def _pivots(nodes: DataFrame) -> DataFrame:
    """Tasks that compare every member of a node with a few of them, in blocks."""
    every = F.greatest(F.lit(1), F.floor(F.col("size") / (2 * PIVOTS)))
    some = F.when(F.pmod(F.xxhash64("id", F.lit(5)), every) == 0, F.struct("id", "label"))
    chosen = nodes.groupBy("key").agg(
        F.array_sort(F.collect_set(some)).alias("some"),
        F.min(F.struct("id", "label")).alias("first"),
        F.first("blocks").alias("blocks"),
    )
    heads = F.array_distinct(F.concat(F.array("first"), F.slice("some", 1, PIVOTS)))
    spread = chosen.select("key", "blocks", F.explode(heads).alias("h")).select(
        "key", "h.id", "h.label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")
    )
    first = spread.select(F.xxhash64("key", "k").alias("key"), "id", "label", F.lit(0).alias("side"))
    rest = nodes.select(F.xxhash64("key", _block()).alias("key"), "id", "label", F.lit(1).alias("side"))
    both = first.unionByName(rest).groupBy("key", "id", "label").agg(F.min("side").alias("side"))
    return both.withColumn("size", F.lit(BLOCK).cast("long"))


def _pairs(nodes: DataFrame) -> DataFrame:
    """Tasks that compare all members of a node whose labels differ, in pairs of blocks."""
    own = nodes.withColumn("own", _block())
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == i, 0).otherwise(1).alias("side")
    return both.select(F.xxhash64("key", i, j).alias("key"), "id", "label", side, "size")


def _bundle(task: str, small: Column, bundles: int) -> Column:
    """Small tasks share a call by their hash; they stay tasks of their own in it."""
    return F.when(small, F.pmod(F.xxhash64(task), F.lit(max(1, bundles)))).otherwise(F.col(task))


def _block() -> Column:
    return F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))


def _signature(*more: str) -> list[Column]:
    """A checksum of a node's members; with ``size`` it tells nodes of other members apart."""
    return [
        F.sum(F.xxhash64("id", *more).cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("id", *more, F.lit(7))).alias("x"),
    ]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (see the module's text)."""
    keep = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    all_marks = keep.table(rows.mapInArrow(_sketches, "id long, n long, d1 long, d2 long, keys array<long>, sketch array<int>"), "marks")
    some = all_marks.where("n > 0 and id is not null")
    by_id = some.groupBy("id").agg((F.min(F.struct("d1", "d2")) != F.max(F.struct("d1", "d2"))).alias("more"), F.count("*").alias("n"))
    several, repeated = by_id.agg(F.max("more"), F.max("n") > 1).first()
    if several:
        return _by_row(rows, keep)
    # a vertex for each distinct set: the least of its ids
    sets = keep.table(all_marks.select("id", "n", "d1", "d2"), "sets")
    reps = keep.table(some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    once_each = (lambda df: df.dropDuplicates(["id"])) if repeated else (lambda df: df)
    marks = once_each(some.join(reps.select(F.col("rep").alias("id")), "id", "left_semi"))
    marks = keep.table(marks.select("id", "n", "keys", "sketch"), "rep_marks")
    keep.drop("marks")
    # roots that several vertices share, those of equal members once; only their documents can be asked for
    roots = marks.select(F.posexplode("keys").alias("c", "key"), "id", "n")
    shared = roots.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("c"), *_signature()).where("size > 1")
    once = shared.groupBy("size", "s", "x").agg(F.min_by("key", F.struct("c", "key")).alias("key"))
    members = keep.table(roots.join(once.select("key"), "key").select("c", "key", "id", "n"), "roots")
    asked = marks.select("id", "n", "sketch").join(members.select("id").distinct(), "id", "left_semi")
    join = _Join(keep.dealt(once_each(rows.join(asked, "id")), "id", "asked"), keep)
    join.trees(members)
    labels = join.components()
    keep.drop("roots", join.dealt, *[f"{name}{i}" for name in ("nodes", "near", "edges") for i in range(join.step + 1)])
    if labels is None:
        labels = marks.select("id", F.col("id").alias("component")).limit(0)
    one = sets.where("n = 0 or id is null").select("id", "n", F.col("id").alias("rep"))
    rep = sets.where("n > 0 and id is not null").join(reps.where("copies > 1"), ["d1", "d2"], "left")
    rep = rep.select("id", "n", F.coalesce("rep", "id").alias("rep")).unionByName(one)
    done = rep.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _by_row(rows: DataFrame, keep: Scratch) -> DataFrame:
    """Ids that repeat with different texts: link rows under ids of their own, then tie equal ids."""
    each = rows.where("id is not null").groupBy("id", "text").agg(F.count("*").alias("copies"))
    each = keep.table(each.withColumn("row", F.monotonically_increasing_id()), "each")
    found = near_duplicates(each.select("row", "text"), "row", "text").toDF("row", "n", "component", "kept")
    named = keep.table(each.select("row", "id", "copies").join(found.drop("kept"), "row"), "named")
    first = named.groupBy("id").agg(F.min("component").alias("a"))
    ties = named.join(first, "id").select("a", F.col("component").alias("b"))
    tied = components(ties, keep, "ties")
    whole = named.join(
        tied.withColumnRenamed("id", "c").withColumnRenamed("component", "t"),
        F.col("component") == F.col("c"),
        "left",
    ).select("id", "n", F.coalesce("t", "component").alias("t"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    least = whole.groupBy("t").agg(F.min("id").alias("least"))
    some = whole.join(least, "t").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("least").alias("component_id"),
        (F.col("id") == F.col("least")).alias("kept"),
    )
    null = rows.where("id is null").mapInArrow(_null_rows, "doc_id long, n_shingles long")
    return some.unionByName(null.withColumns({"component_id": F.lit(None).cast("long"), "kept": F.lit(True)}))


def _null_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, raw = flat(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in shingles(at, raw)], pa.int64())],
            names=["doc_id", "n_shingles"],
        )
