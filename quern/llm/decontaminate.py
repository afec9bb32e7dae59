"""Benchmark decontamination by spaced-seed hashing.

Texts are sequences of words (runs of letters and digits, lower case).  The
document leaks the item if some run of ``RUN`` item words (or the whole item,
if shorter) has at least ``NEED`` of ``RUN`` of its words equal in place.

A seed is the hash of the words that a mask keeps of neighbours, with others
between them ignored; items and documents give the seeds of every position and
meet in an equi-join.  No leak is lost by this: masks are taken from
``FAMILIES``, heaviest first, such that whatever words of a run the rule lets
differ, some mask at some place keeps none of them.  This is found by trying all
sets of differing words (at most 286), as is the least number of seeds that
remain, which the diagonal (document position minus item position) of a leak has
at least.  Runs of 13, 12, 11, 8 and 7 words have two masks of four words, others
of four words and more have masks of three, those of three words keep the first
and the last, and items of one or two words must be equal.  Documents give the
seeds of those masks that some item has.  Along diagonals with enough seeds the
words of both are compared; words of the item that stick out of the document
count as substituted.

Seeds of items are broadcast behind a count.  Beyond it they are shuffled, in
``SALTS`` copies each, so that a seed that is frequent in documents is many tasks.

Null or empty
texts match nothing; null ids are carried.  Empty tables give empty results;
repeated rows give their rows once.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

RUN, NEED = 13, 10
#: Places that masks keep: sets of masks, the most selective first.
FAMILIES = [((0, 1, 2, 4), (0, 1, 3, 4)), ((0, 1, 3),), ((0, 1, 3), (0, 2, 3)), ((0, 2),), ((0, 1),), ((0,),)]
#: Seeds, words of items, and hits that are broadcast at most; beyond these the joins shuffle.
BROADCAST_SEEDS = 1_000_000
#: Copies of each item's seed in a shuffle.
SALTS = 32


def least_seeds(n: int, family: tuple[tuple[int, ...], ...]) -> int:
    """Seeds that a run of ``n`` words keeps at least when as many words differ as the rule allows."""
    places = [{p + m for m in mask} for mask in family for p in range(n - mask[-1])]
    differ = n - -(-NEED * n // RUN)
    return min(sum(not kept.intersection(gone) for kept in places) for gone in combinations(range(n), differ))


def family_of(n: int) -> tuple[tuple[tuple[int, ...], ...], int]:
    """The masks of runs of ``n`` words and the seeds that are left of a leak at least."""
    return next((family, least) for family in FAMILIES if (least := least_seeds(n, family)) > 0)


#: For each length of a run its masks and the least number of seeds.
MASKS_OF = {n: family_of(n) for n in range(1, RUN + 1)}
MASKS = sorted({mask for family, _ in MASKS_OF.values() for mask in family}, key=lambda m: (-len(m), m))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, h: str, n: str, mask: tuple[int, ...], keep: list[str], place: str) -> DataFrame:
    """The columns to keep, the place and hash ``s`` of a mask's seeds at every position."""
    span = mask[-1] + 1
    every = F.transform(
        F.sequence(F.lit(0), F.col(n) - span),
        lambda i: F.xxhash64(F.lit(sum(1 << k for k in mask)), *[F.get(h, i + k) for k in mask]),
    )
    return rows.where(F.col(n) >= span).select(*keep, F.posexplode(F.when(F.col(n) >= span, every)).alias(place, "s"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, item_words, doc_word (where the item begins; may be negative), n_equal, best_run of every leak."""
    items = benchmark.select(
        F.col(f"`{item_col}`").alias("item_id"),
        _hashes(F.col(f"`{item_text_col}`")).alias("b"),
    ).withColumn("nb", F.size("b")).where("nb > 0")
    run = F.least(F.lit(RUN), F.col("nb"))
    least = F.element_at(F.array(*[F.lit(MASKS_OF[n][1]) for n in range(1, RUN + 1)]), run)
    items = items.withColumn("need", least)
    lengths = {r[0] for r in items.select(run.alias("run")).distinct().collect()}  # RUN at most
    # the first mask stays for tables without items, so that there is always a plan
    masks = [m for m in MASKS if any(m in MASKS_OF[n][0] for n in lengths)] or MASKS[:1]
    parts = [
        _seeds(items.where(run.isin([n for n in MASKS_OF if mask in MASKS_OF[n][0]])), "b", "nb", mask, ["item_id", "need"], "ip")
        for mask in masks
    ]
    seeds = reduce(DataFrame.unionByName, parts).distinct()
    few = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    small = (items.agg(F.sum("nb")).first()[0] or 0) <= BROADCAST_SEEDS
    # a row is its id and the hash of its text: seeds carry these alone, and texts are read again for hits only
    read = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).withColumn("t", F.xxhash64("text"))
    rows = read.select("doc_id", "t", _hashes(F.col("text")).alias("h")).withColumn("n", F.size("h"))
    spread = reduce(DataFrame.unionByName, [_seeds(rows, "h", "n", mask, ["doc_id", "t"], "dp") for mask in masks])
    if few:
        met = spread.join(F.broadcast(seeds), "s")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = spread.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t", "dp"), F.lit(SALTS)).cast("int")).join(salted, ["s", "salt"])
    found = met.select(
        "doc_id",
        "t",
        "item_id",
        "need",
        (F.col("dp") - F.col("ip")).alias("diagonal"),
    )
    found = found.groupBy("doc_id", "t", "item_id", "diagonal").agg(F.count("*").alias("seeds"), F.min("need").alias("need"))
    found = found.where("seeds >= need").select(F.col("doc_id").alias("id"), F.col("t").alias("u"), "item_id", "diagonal")
    hits = Scratch(docs.sparkSession).table(found, "hits")
    some = hits.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    asked = hits.select("id", "u").distinct()
    same = (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("id"))
    # words are hashed once for each document with a hit
    worded = read.join(F.broadcast(asked) if some else asked, same, "left_semi").select("doc_id", "t", _hashes(F.col("text")).alias("h"))
    worded = worded.withColumn("n", F.size("h")).join(F.broadcast(hits) if some else hits, same)
    sized = worded.join(F.broadcast(items) if small else items, "item_id")
    # the document's words along the diagonal, padded where the item sticks out of the document
    before = F.greatest(-F.col("diagonal"), F.lit(0))
    inside = F.slice(
        "h",
        F.greatest(F.col("diagonal"), F.lit(0)) + 1,
        F.greatest(F.least(F.col("nb") - before, F.col("n") - F.greatest(F.col("diagonal"), F.lit(0))), F.lit(0)),
    )
    beside = sized.select(
        "doc_id",
        "item_id",
        "nb",
        "diagonal",
        "b",
        F.concat(F.array_repeat(F.lit(None).cast("long"), before), inside).alias("w"),
    ).dropDuplicates(["doc_id", "item_id", "diagonal", "w"])
    same_words = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda i: F.coalesce((F.get("w", i) == F.get("b", i)).cast("int"), F.lit(0)),
    )
    sums = F.transform(
        F.sequence(F.lit(1), F.col("nb") - run + 1),
        lambda i: F.aggregate(F.slice("e", i, run), F.lit(0), lambda a, x: a + x),
    )
    judged = beside.withColumn("e", same_words).withColumn("best_run", F.array_max(sums)).withColumn(
        "n_equal",
        F.aggregate("e", F.lit(0), lambda a, x: a + x),
    )
    bad = judged.where(F.col("best_run") * RUN >= F.lit(NEED) * run)
    best = bad.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("nb", "diagonal", "n_equal", "best_run"), F.struct("best_run", "n_equal", -F.col("diagonal"))).alias("r")
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("r.nb").alias("item_words"),
        F.col("r.diagonal").alias("doc_word"),
        F.col("r.n_equal").alias("n_equal"),
        F.col("r.best_run").alias("best_run"),
    )
