"""Language identification with bit-sliced Bloom filters of n-grams.

The most frequent n-grams of each language (``TOP`` of each length, from a
bounded sample of at most ``SAMPLE`` documents a language, those with the
least hash of id and text, equal rows once) go into one table of
``CELLS`` cells whose bits stand for languages, eight to a slice: the bits that
are set in all of an n-gram's cells are all languages that contain it.  A text
gets, for each language, the count of its n-grams with that bit, less the part
that false positives must have added (a language's filled share to the power
of the number of hashes); the largest corrected count decides and its share of
all of them is the score.

Null texts and texts without a letter are ``und`` with score 0; a text whose
letters hit no filter gets the language with most documents in the sample and
score 0.  Repeated rows are alike; without training rows all is ``und``.  Of more
than ``LANGS`` values of the language those with most documents are learned, of
equally many the first by name; so the filters take ``CELLS * LANGS / 8`` bytes at
most, whatever the column holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.packing import flat, mix, rolling
from quern.session import ship

LENGTHS, TOP, SAMPLE, CELLS, HASHES = (3, 4, 5), 1_500, 1_500, 1 << 18, 3
#: Languages that are learned at most.
LANGS = 1_024
_FOLD = np.full(256, 32, np.uint8)  # all but letters counts as a space
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))
_PART = 1 << 18


def _grams(raw: np.ndarray) -> list[np.ndarray]:
    """For each length the hash of the n-gram at every position; the rest at the end is left out."""
    return [mix(h + np.uint64(n)) for n, h in zip(LENGTHS, rolling(_SYMBOL[_FOLD[raw]], LENGTHS), strict=True)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, length, n-gram, count) of a batch."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        at, raw = flat(batch.column(0))
        for lang in sorted(set(langs)):
            own = np.concatenate(
                [np.append(raw[at[i] : at[i + 1]], 32) for i in np.flatnonzero(langs == lang)] or [raw[:0]]
            ).astype(np.uint8)
            for n, h in zip(LENGTHS, _grams(own), strict=True):
                gram, count = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(gram), pa.string()),
                        pa.array(np.full(len(gram), n, np.int32)),
                        pa.array(gram.view(np.int64)),
                        pa.array(count),
                    ],
                    names=["lang", "n", "gram", "count"],
                )


class Filters:
    """Bit slices of eight languages, each a table of cells."""

    def __init__(self, grams: dict[str, np.ndarray], common: str | None, cells: int = CELLS):
        self.langs, self.common, self.cells = sorted(grams), common, cells
        self.slices = [np.zeros(cells, np.uint8) for _ in range(-(-len(self.langs) // 8))]
        filled = []
        for i, lang in enumerate(self.langs):
            for at in self.places(grams[lang]):
                self.slices[i // 8][at] |= np.uint8(1 << i % 8)
            filled.append(np.count_nonzero(self.slices[i // 8] >> np.uint8(i % 8) & np.uint8(1)) / cells)
        self.false = np.array(filled) ** HASHES

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 // HASHES)
        return [((h >> shift * np.uint64(k)) % np.uint64(self.cells)).astype(np.int32) for k in range(HASHES)]

    def counts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) n-grams with the language's bit, and all n-grams of each text."""
        hits, total = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1)
        for n, h in zip(LENGTHS, _grams(raw), strict=True):
            inside = np.maximum(np.diff(at) - n + 1, 0)
            total += inside
            some = np.flatnonzero(inside)
            if not len(some):
                continue
            # sums over [start, start + inside) by pairs of bounds; every second one counts
            bounds = np.stack([at[some], at[some] + inside[some]], axis=1).reshape(-1)
            places = self.places(h)
            for s, cells in enumerate(self.slices):
                mask = cells[places[0]]
                for p in places[1:]:
                    mask &= cells[p]
                for b in range(min(8, len(self.langs) - 8 * s)):
                    run = np.append(0, np.cumsum(mask >> np.uint8(b) & np.uint8(1), dtype=np.int64))
                    hits[some, 8 * s + b] += run[bounds[1::2]] - run[bounds[::2]]
        return hits, total

    def decide(self, column: pa.Array) -> tuple[list[str], list[float]]:
        at, raw = flat(column)
        langs, scores = [], []
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, min(len(at) - 1, int(np.searchsorted(at, at[i] + _PART))))
            part, where = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            hits, total = self.counts(part, where)
            right = np.maximum(0, (hits - self.false * total[:, None]) / np.maximum(1e-9, 1 - self.false))
            every = right.sum(axis=1)
            best = right.argmax(axis=1) if self.langs else None
            plain = np.append(0, np.cumsum((_FOLD[part] > 32) & (part < 128)))
            lettered = plain[where[1:]] > plain[where[:-1]]
            for k in range(j - i):
                if not self.langs or not (
                    lettered[k] or any(c.isalpha() for c in part[where[k] : where[k + 1]].tobytes().decode("utf-8", "ignore"))
                ):
                    langs.append("und")
                    scores.append(0.0)
                elif every[k] > 0:
                    langs.append(self.langs[best[k]])
                    scores.append(float(right[k, best[k]] / every[k]))
                else:
                    langs.append(self.common)
                    scores.append(0.0)
            i = j
        return langs, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from at most ``sample`` documents of each language, those with the least hash of their id and text."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    # a part of the hash range that holds the least ones for certain, so that few rows are sorted
    parts = [(r["lang"], min(1.0, 2 * (sample + 100) / r["count"])) for r in sizes]
    shares = labelled.sparkSession.createDataFrame(parts, "lang string, share double")
    part = F.pmod(F.shiftright("h", 20), F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40))
    near = rows.join(F.broadcast(shares), "lang").where(part).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("place", place).where(F.col("place") <= sample).select("text", "lang")
    counted = chosen.mapInArrow(
        _counts,
        "lang string, n int, gram long, count long",
    ).groupBy("lang", "n", "gram").agg(F.sum("count").alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    got = counted.withColumn("r", rank).where(F.col("r") <= TOP).select("lang", "gram").toArrow().sort_by("lang")
    langs, at = np.unique(got.column("lang").to_numpy().astype(str), return_index=True)
    grams = np.split(got.column("gram").to_numpy().view(np.uint64), at[1:])
    return Filters(dict(zip(langs.tolist(), grams, strict=False)), sizes[0]["lang"] if sizes else None)


def identified(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row, each from its whole text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(filters)  # CELLS bytes for eight languages
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = held.value.decide(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))
