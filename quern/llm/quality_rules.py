"""Quality rules as a short-circuit cascade.

Every document has a few base figures, and a verdict that they alone give.  What
passes it meets further rules, each of which rejects or not; a document is kept
if none rejects.  Rules cost time of their own: a rule is evaluated only if none
before it has rejected, so their order sets the cost and never the verdict.

The order comes from a sample: all rules run on it, each timed, and their
rejections are counted in combination.  Then, again and again, the rule that
rejects most of what is left per second goes next.  Rules that reject nothing
there come last, the cheapest first.  The sample is taken over the whole table
by a seeded draw of about ``SAMPLE`` rows; the driver sees one row for each
combination of rejecting rules, at most two to the power of the rules.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null text has none, all its
figures are 0, it fails the base and is not kept.  Rows with a null key and equal
rows are rows like others.  An empty table has no rows, and the order of its
rules is that of their names.  Columns that are not asked for play no part.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import ship

#: Rows that the order of the rules is learned from, about, and the seed of their draw.
SAMPLE, SEED = 2_000, 11
#: Texts of more words have their windows sorted as numbers, not hashed as strings.
LONG = 100_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = re.compile("[#*$%&|<>]")
_LETTER, _UPPER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}"), re.compile("[0-9]")


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that are there twice or more."""
    if len(words) < 4:
        return 0
    if len(words) > LONG:
        ids: dict[str, int] = {}
        seen = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        pairs = np.unique(seen[:-1] * len(ids) + seen[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1] * len(ids) + seen[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[window] > 1)
    else:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count = Counter(windows)
        twice = np.fromiter((k for k, w in enumerate(windows) if count[w] > 1), np.int64)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[twice + k] = True
    return int(inside.sum())


class Text:
    """A text and its figures, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: What rejects a text, by name: shares of symbols, of words with a letter, of lines said before, of
#: capitals, digits and the most frequent word, and the length of words.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "letters": lambda t: 5 * sum(1 for w in t.words if _LETTER.search(w)) < 4 * t.n_words,
    "lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "capitals": lambda t: 2 * len(_UPPER.findall(t.text)) > len(_LETTER.findall(t.text)),
    "digits": lambda t: 2 * len(_DIGIT.findall(t.text)) > t.word_chars,
    "one_word": lambda t: 10 * max(Counter(t.words).values(), default=0) > 3 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
}
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _tried(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of texts that pass the base, which rules reject, as bits, and the seconds of each rule."""
    for batch in batches:
        out: list[tuple[int, list[float]]] = []
        for value in batch.column(0):
            text = Text(value.as_py())
            if text.base_failed:
                continue
            _ = [getattr(text, c) for c in FIGURES]  # there anyway
            mask, took = 0, []
            for k, name in enumerate(names):
                began = time.perf_counter()
                mask |= RULES[name](text) << k
                took.append(time.perf_counter() - began)
            out.append((mask, took))
        masks, times = [m for m, _ in out], [t for _, t in out]
        yield pa.RecordBatch.from_pydict({"mask": pa.array(masks, pa.int64()), "took": pa.array(times, pa.list_(pa.float64()))})


def ordered(cost: dict[str, float], rejected: Counter[frozenset[str]]) -> list[str]:
    """Rules by rejections per cost among what those before them leave."""
    left, rest, out = dict(rejected), sorted(cost), []
    while rest:
        gain = {r: sum(n for names, n in left.items() if r in names) for r in rest}
        best = max(rest, key=lambda r: (gain[r] / max(cost[r], 1e-12), -cost[r], -rest.index(r)))
        out.append(best)
        rest.remove(best)
        left = {names: n for names, n in left.items() if best not in names}
    return out


def learned_order(docs: DataFrame, text: str = "text") -> list[str]:
    """The order of the rules from a sample of ``docs``."""
    ship(docs.sparkSession)
    names = sorted(RULES)
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    rows = texts.count()
    drawn = texts.sample(fraction=min(1.0, SAMPLE / max(1, rows)), seed=SEED)
    tried = drawn.mapInArrow(lambda b: _tried(b, names), "mask bigint, took array<double>")
    sums = [F.sum(F.col("took")[k]).alias(name) for k, name in enumerate(names)]
    got = tried.groupBy("mask").agg(F.count("*").alias("n"), *sums).collect()
    rejected = Counter({frozenset(r for k, r in enumerate(names) if row["mask"] >> k & 1): row["n"] for row in got})
    return ordered({name: sum(row[name] for row in got) for name in names}, rejected)


_TYPES = [*[pa.int64()] * len(FIGURES), pa.bool_(), pa.bool_(), pa.string()]
_NAMES = [*FIGURES, "base_failed", "kept", "rejected_by"]


def _judged(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _NAMES]
        for value in batch.column(1):
            text = Text(value.as_py())
            by = "base" if text.base_failed else next((r for r in order if RULES[r](text)), None)
            for column, x in zip(out, (*(getattr(text, c) for c in FIGURES), text.base_failed, by is None, by), strict=True):
                column.append(x)
        made = [pa.array(v, t) for v, t in zip(out, _TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", *_NAMES])


def judged(docs: DataFrame, columns: list[str], order: list[str], text: str = "text") -> DataFrame:
    """``row`` with ``columns``, the base figures, base_failed, kept, and rejected_by, the first rule of ``order`` that rejects."""
    ship(docs.sparkSession)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    made = T.StructType([row.schema["row"], *[T.StructField(c, T.LongType()) for c in FIGURES]])
    made = made.add("base_failed", "boolean").add("kept", "boolean").add("rejected_by", "string")
    return row.mapInArrow(lambda b: _judged(b, order), made)
