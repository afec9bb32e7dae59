"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of the labelled documents: of each label the
``EXAMPLES`` ids with the least hash, as long as their distinct words are no
more than ``POSTINGS`` in all.  Every word of their texts is a term, weighted by
TF-IDF: 1 + log(count) times the inverse document frequency among the examples
of label 0, the background, raised to the power ``SHARP``, so that what a text
has beside common words decides which examples are near.  Where the sample has
one label's examples more often than the corpus, their counts and votes are
scaled back.

The inverted index keeps the examples of a term in blocks of ``BLOCK`` with the
largest weight in each.  For a document the blocks are visited by falling upper
bound until no block can still reach the ``K`` best: the neighbours are exact,
and those that tie with the last are all taken.  Votes are weighted by
1 / (distance + ``NEAR``) and drawn to the base rate by ``PRIOR`` votes, which
keeps few or distant neighbours from giving certain scores.  A line through the
log-odds of votes, fitted to up to ``FITTED`` examples of each label that do not
vote on themselves, makes them probabilities.

The index and its size are bounded by these parameters, whatever the corpus;
every document is scored from its whole text.  Texts that are null, empty or
without any word of the examples get the rate of such examples.  Labels of null
are no examples; an id that is labelled several times is one example, toxic if
any of its labels says so, and of documents that share its id the text with the
least hash is taken.  Without examples the score is 0.  Evidence lists the ids of the
nearest examples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.scratch import Scratch
from quern.session import ship

#: Examples of a label, and distinct words of all of them, that the index may hold.
EXAMPLES, POSTINGS = 2_000, 2_000_000
K, BLOCK, FIRST, NEAR, PRIOR, EVIDENCE = 15, 256, 2, 0.05, 1.0, 3
#: Power of the inverse document frequency; examples of a label that calibrate the votes, and how few leave them as they are.
SHARP, FITTED, FEW = 4, 500, 10
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from start to end, one after the other."""
    size = end - start
    at = np.cumsum(size)
    total = int(at[-1]) if len(at) else 0
    return np.arange(total) + np.repeat(start - at + size, size)


class Index:
    """Examples in an inverted index of blocks, with the largest weight of each term in each block."""

    def __init__(self, examples: pa.Table, shares: tuple[float, float] = (1.0, 1.0)):
        """``examples``: id, label, term and n (lists of terms and counts); ``shares``: what an example of label 0, and 1, counts."""
        ids, label = (examples[c].to_numpy().astype(np.int64) for c in ("id", "label"))
        worth = np.array(shares, float)[label]
        total = float(worth.sum())
        self.rate = float(worth[label == 1].sum()) / total if total else 0.0
        words = examples["term"].combine_chunks()
        size = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        self.number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        row, term = np.repeat(np.arange(len(ids)), size), coded.indices.to_numpy().astype(np.int64)
        n = examples["n"].combine_chunks().flatten().to_numpy().astype(float)
        have = np.bincount(term, (worth * (label == 0))[row], len(self.number))
        self.weight = np.maximum(np.log((1 + total) / (1 + have)), 1e-3) ** SHARP
        w = (1 + np.log(n)) * self.weight[term]
        norm = np.sqrt(np.bincount(row, w * w, len(ids)))
        w = w / np.maximum(norm, 1e-300)[row]
        bare = size == 0
        self.bare = (float((worth * label)[bare].sum()) + self.rate) / (float(worth[bare].sum()) + 1)
        # examples with the same heaviest term stand in the same blocks
        o = np.lexsort((-w, row))
        first = np.zeros(len(ids), int)
        heads = o[np.append(True, row[o][1:] != row[o][:-1])] if len(o) else o
        first[row[heads]] = term[heads]
        order = np.lexsort((ids, first, label))
        order = order[~bare[order]]
        place = np.zeros(len(ids), int)
        place[order] = np.arange(len(order))
        self.ids, self.label, self.worth = ids[order], label[order], worth[order]
        self.blocks = -(-len(order) // BLOCK)
        # postings by term and example; the rows of a term's blocks point into them
        entry = place[row]
        o = np.lexsort((entry, term))
        self.entry, self.w, term = entry[o].astype(np.int32), w[o], term[o]
        block = self.entry // BLOCK
        new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])) if len(o) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(o))
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.w, self.start) if len(o) else self.w
        self.row = np.searchsorted(term[self.start], np.arange(len(self.number) + 1))
        self.slope, self.shift = 1.0, 0.0
        self._calibrate(ids, words, n, size)

    def _calibrate(self, ids: np.ndarray, words: pa.Array, n: np.ndarray, size: np.ndarray) -> None:
        """The line through the log-odds of votes that examples give examples."""
        at = dict(zip(ids.tolist(), np.append(0, np.cumsum(size)[:-1]).tolist(), strict=True)) if len(ids) else {}
        long = dict(zip(ids.tolist(), size.tolist(), strict=True))
        chosen = [np.flatnonzero(self.label == x) for x in (0, 1)]
        chosen = [c[np.unique(np.linspace(0, len(c) - 1, FITTED).astype(int))] if len(c) else c for c in chosen]
        if min(map(len, chosen)) < FEW:
            return
        terms_ = words.flatten()
        x, y, w = [], [], []
        for mark, places in enumerate(chosen):
            share = float(self.worth[self.label == mark].sum()) / len(places)
            for i in self.ids[places].tolist():
                own = slice(at[i], at[i] + long[i])
                found = np.array([self.number[t] for t in terms_[own].to_pylist()])
                order = np.argsort(found)
                v = (1 + np.log(n[own][order])) * self.weight[found[order]]
                x.append(_odds(self.vote(found[order], v / np.sqrt(v @ v), i)[0]))
                y.append(mark)
                w.append(share)
        self.slope, self.shift = _line(np.array(x), np.array(y), np.array(w))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of a text's terms that the examples have, of length one."""
        found = [i for i in map(self.number.get, terms(text)) if i is not None]
        if not found:
            return np.zeros(0, int), np.zeros(0)
        at, n = np.unique(np.array(found), return_counts=True)
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / np.sqrt(w @ w)

    def neighbours(self, at: np.ndarray, q: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the ``K`` nearest and of those that tie with the last; ``own`` is an id to leave out."""
        first, last = self.row[at], self.row[at + 1]
        rows, weight = _ranges(first, last), np.repeat(q, last - first)
        block = self.block[rows]
        bound = np.bincount(block, weight * self.most[rows], self.blocks)
        order = np.argsort(-bound, kind="stable")
        left = np.flatnonzero(self.ids == own) if own is not None else None
        score, kth, i, step = np.zeros(self.blocks * BLOCK), 0.0, 0, FIRST
        while i < len(order) and bound[order[i]] > 0 and bound[order[i]] >= kth - 1e-12:
            end = min(i + step, int(np.searchsorted(-bound[order], -(kth - 1e-12), "right")))
            chosen = np.zeros(self.blocks, bool)
            chosen[order[i:end]] = True
            some = np.flatnonzero(chosen[block])
            a = self.start[rows[some]]
            size = self.end[rows[some]] - a
            hit = _ranges(a, a + size)
            score += np.bincount(self.entry[hit], np.repeat(weight[some], size) * self.w[hit], len(score))
            if left is not None:
                score[left] = 0
            i, step = end, self.blocks
            kth = max(0.0, np.partition(score, -K)[-K]) if len(score) >= K else 0.0
        found = np.flatnonzero((score >= kth - 1e-12) & (score > 0))
        found = found[np.lexsort((self.ids[found], -score[found]))]
        return found, score[found]

    def vote(self, at: np.ndarray, q: np.ndarray, own: int | None = None) -> tuple[float, list[int]]:
        """The toxic share of the neighbours' votes, and the nearest of them."""
        near, cosine = self.neighbours(at, q, own)
        vote = self.worth[near] / (np.maximum(0, 1 - cosine) + NEAR)
        some = PRIOR / (1 + NEAR)
        toxic = float(vote[self.label[near] == 1].sum())
        return (toxic + some * self.rate) / (float(vote.sum()) + some), self.ids[near[:EVIDENCE]].tolist()

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * _odds(vote) + self.shift))))

    def score(self, text: str | None, own: int | None = None) -> tuple[float, list[int]]:
        at, q = self.vector(text)
        if not len(at):
            return self.bare, []
        vote, evidence = self.vote(at, q, own)
        return self.calibrated(vote), evidence


def _odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds of y on x with weights w, drawn to even odds by one example of each label."""
    ones, zeros = (w * y).sum(), (w * (1 - y)).sum()
    want = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(line[0] * x + line[1], -30, 30)))
        g, h = w * (p - want), w * p * (1 - p) + 1e-9
        curve = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(curve, [(g * x).sum(), g.sum()])
        line -= np.clip(step, -2, 2)
    return max(0.05, float(line[0])), float(line[1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(terms(x.as_py())) for x in batch.column(2)]
        words = pa.array([list(c) for c in counts], pa.list_(pa.string()))
        n = pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
        size = pa.array([len(c) for c in counts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, n, size], names=["id", "label", "term", "n", "size"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES
) -> Index:
    """The index of a bounded sample of ``labels`` (id, label 0 or 1) and the texts of ``docs`` with their ids."""
    keep = Scratch(docs.sparkSession)
    mark = F.col(f"`{label_col}`")
    marked = labels.where(mark.isin(0, 1)).select(F.col(f"`{id_col}`").cast("long").alias("id"), mark.cast("int").alias("label"))
    marked = marked.where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    marked = keep.table(marked, "marked")
    known = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    # at most ``examples`` rows of a label, so they can go to every task and no text is shuffled
    least = [marked.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(examples) for x in (0, 1)]
    chosen = F.broadcast(keep.table(least[0].unionByName(least[1]), "chosen"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.join(chosen, "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = keep.table(found.mapInArrow(_counted, "id long, label int, term array<string>, n array<long>, size long"), "sample")
    held = {0: [], 1: []}
    for r in sorted(sample.select("id", "label", "size", F.xxhash64("id").alias("h")).collect(), key=lambda r: (r.h, r.id)):
        held[r.label].append((r.id, r.size))
    kept: list[int] = []
    for rows in held.values():
        room = POSTINGS // 2
        for i, n in rows:  # a text too long for what is left is skipped, not what follows it
            if n <= room:
                room -= n
                kept.append(i)
    wanted = docs.sparkSession.createDataFrame([(i,) for i in kept], "id long")
    got = sample.join(F.broadcast(wanted), "id").select("id", "label", "term", "n").toArrow().sort_by("id")
    counts = Counter(got["label"].to_pylist())
    every = sum(known.get(x, 0) for x in counts)
    shares = [known.get(x, 0) / every * len(got) / counts[x] if counts[x] else 1.0 for x in (0, 1)]
    return Index(got, tuple(shares))


def scored(
    docs: DataFrame,
    index: Index,
    id_col: str = "doc_id",
    text_col: str = "text",
    leave_own: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """``row`` (a struct of ``columns``, by default all of the input's), score, predicted, evidence.

    With ``leave_own`` a document that is an example itself does not vote on itself.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the parameters above
    carried = docs.columns if columns is None else columns
    # the text goes to Python once: inside the row where that has it
    inside = carried.index(text_col) if text_col in carried and dict(docs.dtypes)[text_col] == "string" else None
    own = F.col(f"`{id_col}`").cast("long") if leave_own else F.lit(None).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")
    text = [] if inside is not None else [F.col(f"`{text_col}`").cast("string").alias("text")]
    rows = docs.select(row, own.alias("own"), *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(0).field(inside) if inside is not None else batch.column(2)
            got = [known.score(x.as_py(), i) for x, i in zip(texts, batch.column(1).to_pylist(), strict=True)]
            score = np.array([g[0] for g in got], float)
            evidence = pa.array([g[1] for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), evidence],
                names=["row", "score", "predicted", "evidence"],
            )

    kind = rows.select("row").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, kind.add("evidence", T.ArrayType(T.LongType())))
