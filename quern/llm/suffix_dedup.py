"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed where it is covered by a ``threshold``-byte string that also
starts in a document with a smaller id.  Suffixes are ordered only through
``threshold`` bytes, most significant digit first, and after every pass those
that share their digit with no other document are settled:

1. *First digit.*  In every window of ``threshold`` bytes the least hash of its
   ``gram``-byte strings is the window's anchor; equal windows have equal
   anchors, so only anchors (about 8 % of the positions) are exchanged.  Each
   block of documents sends one entry per distinct anchor and digest of all
   bytes that its windows can touch.  Entries equal in both are settled: all
   windows at the later document are repeats.  An anchor that a block has with
   more than ``LOCAL`` digests sends one entry in place of them all, with the
   least and greatest document.
2. *Remaining digits.*  Anchors seen with different surroundings send these
   surroundings as bytes, and the windows inside are radix sorted by eight-byte
   digits.  Equal groups after the last digit are exactly the repeated windows.
   An anchor with very many surroundings, in one block or in all, sends single
   windows dealt out by their own hash, so no task holds all of a common phrase.
3. Blocks turn the answers into byte intervals and cut.

So a block sends at most ``LOCAL`` entries of an anchor, and a window once,
however often they occur: what a hot passage brings into one task grows with the
number of blocks, not of documents.

Nulls: a null text is empty; a row with a null id is left whole and takes part
in nothing.  Rows with the same id never remove each other's bytes.  Repeated
rows get the same result.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.packing import _B, _FULL, flat, mix, of_table, of_tables, pack, unpack
from quern.llm.scratch import Scratch

#: Bytes of text in a block, entries in a bucket of anchors, surroundings of
#: one anchor that are compared in one task.
#: A block sends each bucket a cell, so cells grow with the square of the corpus: buckets are as large as a task holds.
BLOCK_BYTES, BUCKET_ENTRIES, COMMON = 4 << 20, 1_200_000, 20_000
#: Surroundings of one anchor that a block names one by one.
LOCAL = 16
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


class _Depth:
    """The lengths that follow from the threshold."""

    def __init__(self, threshold: int):
        if threshold < 16:
            raise ValueError("threshold must be 16 bytes or more")
        self.t = threshold
        self.gram = threshold // 2 + 1
        self.w = threshold - self.gram + 1  # grams in a window
        self.left = self.w - 1  # bytes that a window can reach before its anchor
        self.around = self.left + threshold


def _runs(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length()) if length >> k & 1]


def _slide(a: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = least(a[:-size], a[size:])
        size *= 2
    return least(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(at: np.ndarray, raw: np.ndarray, z: _Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, position, gram hash, surroundings digest) of all anchors."""
    total = len(raw)
    valid = np.ones(total, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        valid[max(a, b - z.t + 1) : b] = False
    places, grams, digests = [], [], []
    step = 1 << 16
    full = max(z.gram, z.around)
    for lo in range(0, total, step):
        hi = min(total, lo + step)
        a, b = lo - z.left, hi + z.around + z.w
        part = np.zeros(b - a, np.uint8)
        part[max(0, -a) : min(total, b) - a] = raw[max(0, a) : min(total, b)]
        runs = {1: _SYMBOLS[part]}
        size = 1
        while size * 2 <= full:
            cur = runs[size]
            runs[size * 2] = cur[:-size] * np.uint64(pow(_B, size, _FULL)) + cur[size:]
            size *= 2
        have, g = 0, None
        n = len(part) - z.gram + 1
        for bit in _runs(z.gram):
            cur = runs[bit][have : have + n]
            g = cur.copy() if g is None else g * np.uint64(pow(_B, bit, _FULL)) + cur
            have += bit
        g = mix(g) | np.uint64(1)
        # windows that start in [lo - left, hi) and hold some position of [lo, hi)
        low = _slide(g, z.w, np.minimum)[: hi - lo + z.left]
        ok = np.zeros(len(low), bool)
        ok[max(0, -a) :] = valid[max(0, a) : a + len(low)]
        low = np.where(ok, low, np.uint64(0))
        top = _slide(low, z.w, np.maximum)
        own = g[z.left : z.left + hi - lo]
        found = np.flatnonzero(top == own)
        if len(found):
            have, c = 0, None
            for bit in _runs(z.around):
                cur = runs[bit][found + have]
                c = cur if c is None else c * np.uint64(pow(_B, bit, _FULL)) + cur
                have += bit
            places.append(found + lo)
            grams.append(own[found])
            digests.append(mix(c))
    if not places:
        e = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), e, e
    p, g, c = np.concatenate(places), np.concatenate(grams), np.concatenate(digests)
    d = np.searchsorted(at, p, side="right") - 1
    # at a document's ends the surroundings are shorter; their digest says so
    left, right = p - at[d], at[d + 1] - p
    for i in np.flatnonzero((left < z.left) | (right < z.t)).tolist():
        x, y = min(z.left, int(left[i])), min(z.t, int(right[i]))
        said = raw[p[i] - x : p[i] + y].tobytes() + bytes((x % 251, y % 251)) + f"{x},{y}".encode()
        c[i] = int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little")
    return d, p, g, c


class _Block:
    """The distinct documents of a block and their distinct anchors, in a fixed order."""

    def __init__(self, table: pa.Table, z: _Depth, buckets: int, sort: bool = True):
        key = np.stack([table["__id"].to_numpy(), table["__th"].to_numpy()], axis=1)
        self.docs, first, self.of_row = np.unique(key, axis=0, return_index=True, return_inverse=True)
        self.of_row = self.of_row.reshape(-1)
        self.ids = np.ascontiguousarray(self.docs[:, 0])
        self.at, self.raw = flat(table["__text"].combine_chunks().take(pa.array(first)))
        if not sort:
            return
        self.d, self.p, self.g, self.c = anchors(self.at, self.raw, z)
        order = np.lexsort((self.d, self.c, self.g))
        self.d, self.p, self.g, self.c = self.d[order], self.p[order], self.g[order], self.c[order]
        n = len(order)
        new = np.ones(n, bool)
        new[1:] = (self.g[1:] != self.g[:-1]) | (self.c[1:] != self.c[:-1])
        self.first = np.flatnonzero(new)
        self.unique_of = np.cumsum(new) - 1
        # what is sent: an item for each of these, or for all those of an anchor with many
        g = self.g[self.first]
        anchor = np.ones(len(g), bool)
        anchor[1:] = g[1:] != g[:-1]
        starts = np.flatnonzero(anchor)
        many = np.diff(np.append(starts, len(g))) > LOCAL
        lead = anchor | ~many[np.cumsum(anchor) - 1]
        self.item_of = np.cumsum(lead) - 1
        self.items = self.first[lead]
        self.common = self.item_of[starts[many]]
        docs = self.ids[self.d[self.first]]
        self.least, self.most = (f.reduceat(docs, starts)[many] if len(starts) else docs for f in (np.minimum, np.maximum))
        bucket = _bucket(self.g[self.items], buckets, z.w)
        self.keys, self.starts = np.unique(bucket, return_index=True)


def _pieces(k: np.ndarray):
    """Each value of a sorted array with the range of its places."""
    keys, starts = np.unique(k, return_index=True)
    ends = np.append(starts, len(k))[1:]
    return zip(keys.tolist(), starts.tolist(), ends.tolist(), strict=True)


def _bucket(g: np.ndarray, buckets: int, of: int = 1) -> np.ndarray:
    """Buckets in the order of hashes that are the least ``of`` so many, about equally full.

    Least hashes crowd near 0; their distribution function spreads them evenly.
    """
    share = -np.expm1(of * np.log1p(-np.minimum(g.astype(np.float64) * 2.0**-64, 1 - 2.0**-53)))
    return np.minimum((share * buckets).astype(np.int64), buckets - 1)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


_MESSAGE = pa.schema([("__kind", pa.int32()), ("__bucket", pa.int64()), ("__block", pa.int64()), ("__cell", pa.binary())])
_MESSAGE_DDL = "__kind int, __bucket long, __block long, __cell binary"


def _first_digit(table: pa.Table, threshold: int, buckets: int) -> pa.Table:
    b = _Block(table, _Depth(threshold), buckets)
    block = table["__block"][0].as_py()
    out = []
    plain = np.ones(len(b.items), bool)
    plain[b.common] = False
    for k, x, y in zip(b.keys.tolist(), b.starts.tolist(), np.append(b.starts, len(b.items))[1:].tolist(), strict=True):
        u = b.items[x:y][plain[x:y]]
        i, j = np.searchsorted(b.common, (x, y))
        w = (b.common[i:j] - x).astype(np.uint32)
        out.append((0, k, block, pack(b.g[u], b.c[u], b.ids[b.d[u]], w, b.g[b.items[b.common[i:j]]], b.least[i:j], b.most[i:j])))
    return _rows(out, _MESSAGE)


def _settle_first(table: pa.Table) -> pa.Table:
    """Per item: 1 all its windows are repeats, 2 compare surroundings, 3 compare single windows."""
    order = np.argsort(table["__block"].to_numpy(), kind="stable")
    cells, blocks = table["__cell"], table["__block"].to_numpy()[order]
    got = [unpack(cells[int(i)].as_py()) for i in order]
    places = [(len(x[0]), x[3].astype(np.int64)) for x in got]
    g, c, doc, common, lo, hi = (np.concatenate([x[i] for x in got]) for i in (0, 1, 2, 4, 5, 6))
    del got
    o = np.lexsort((doc, c, g))
    g, c, doc = g[o], c[o], doc[o]
    group = np.ones(len(g), bool)
    group[1:] = g[1:] != g[:-1]
    new = group.copy()
    new[1:] |= c[1:] != c[:-1]
    # entries of the least document, of which several blocks may hold rows, are no repeats
    later = doc > doc[new][np.cumsum(new) - 1] if len(g) else new
    starts = np.flatnonzero(group)
    counts = np.diff(np.append(starts, len(g)))
    contexts = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else starts
    least, most = (
        f.reduceat(np.where(new, doc, doc[np.repeat(starts, counts)]), starts) if len(starts) else starts for f in (np.minimum, np.maximum)
    )
    # anchors that are common in some block are so in all
    names, of = np.unique(common, return_inverse=True)
    low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(low, of, lo)
    np.maximum.at(high, of, hi)
    at = np.searchsorted(names, g[starts])
    also = at < len(names)
    also[also] = names[at[also]] == g[starts][also]
    low[at[also]] = np.minimum(low[at[also]], least[also])
    high[at[also]] = np.maximum(high[at[also]], most[also])
    least[also], most[also] = low[at[also]], high[at[also]]
    single = also | (contexts > COMMON)
    ask = np.where((also | (contexts > 1)) & (least < most), np.where(single, 3, 2), 0).astype(np.uint8)
    flag = np.where(later, 1, np.repeat(ask, counts)).astype(np.uint8)
    back = np.empty(len(o), np.uint8)
    back[o] = flag
    of_common = np.where(low < high, 3, 0).astype(np.uint8)[of]
    out, at, past = [], 0, 0
    for block, (size, w) in zip(blocks.tolist(), places, strict=True):
        own = np.zeros(size + len(w), np.uint8)
        plain = np.ones(len(own), bool)
        plain[w] = False
        own[plain], own[w] = back[at : at + size], of_common[past : past + len(w)]
        at, past = at + size, past + len(w)
        some = np.flatnonzero(own).astype(np.uint32)
        if len(some):
            out.append((0, table["__bucket"][0].as_py(), block, pack(np.diff(some, prepend=np.uint32(0)), own[some])))
    return _rows(out, _MESSAGE)


def _around(b: _Block, d: np.ndarray, p: np.ndarray, z: _Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = np.minimum(z.left, p - b.at[d]), np.minimum(z.t, b.at[d + 1] - p)
    where = p[:, None] - z.left + np.arange(z.around)
    inside = (where >= (p - left)[:, None]) & (where < (p + right)[:, None])
    m = np.where(inside, b.raw[np.clip(where, 0, len(b.raw) - 1)], 0).astype(np.uint8)
    return m, left.astype(np.uint8), right.astype(np.uint8)


def _ask(texts: pa.Table, answers: pa.Table, threshold: int, buckets: int) -> pa.Table:
    """Kind 1 to buckets: surroundings to compare.  Kind 2 to the block itself: intervals and open questions."""
    if not texts.num_rows:
        return _rows([], _MESSAGE)
    z = _Depth(threshold)
    b = _Block(texts, z, buckets)
    block = texts["__block"][0].as_py()
    flag = np.zeros(len(b.items), np.uint8)
    for k, cell in zip(answers["__bucket"].to_pylist(), answers["__cell"].to_pylist(), strict=True):
        some, said = unpack(cell)
        flag[b.starts[np.searchsorted(b.keys, k)] + np.cumsum(some.astype(np.int64))] = said
    mine = flag[b.item_of][b.unique_of]
    later = b.ids[b.d] > b.ids[b.d[b.first]][b.unique_of]
    done = (mine == 1) | later
    lo = np.maximum(b.at[b.d], b.p - z.left)[done]
    hi = (np.minimum(b.p, b.at[b.d + 1] - z.t) + z.t)[done]
    lo, hi = _merged(lo, hi)
    out, asked = [], []
    # surroundings
    two = np.flatnonzero((mine == 2) & ~done)
    u, number = np.unique(b.unique_of[two], return_inverse=True)
    k = _bucket(b.g[b.first[u]], buckets, z.w)
    asked.append((k[number], _numbers(k)[number], b.d[two], b.p[two]))
    for key, x, y in _pieces(k):
        f = b.first[u[x:y]]
        m, left, right = _around(b, b.d[f], b.p[f], z)
        out.append((1, key, block, pack(b.g[f], b.ids[b.d[f]], left, right, m.reshape(-1))))
    # single windows, whose hash is their own anchor
    three = np.flatnonzero((mine == 3) & ~done)
    if len(three):
        s = b.p[three][:, None] - z.left + np.arange(z.w)
        d = np.broadcast_to(b.d[three][:, None], s.shape)
        fit = (s >= b.at[d]) & (s + z.t <= b.at[d + 1])
        s, i = np.unique(s[fit], return_index=True)
        d = d[fit][i]
        m = np.lib.stride_tricks.sliding_window_view(b.raw, z.t)[s]
        h = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=8).digest() for x in m), np.uint64)
        o = np.lexsort((d, h))
        s, d, m, h = s[o], d[o], m[o], h[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1]).any(axis=1)
        f = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        known = b.ids[d] > b.ids[d[f]][of]
        lo, hi = _merged(np.concatenate([lo, s[known]]), np.concatenate([hi, s[known] + z.t]))
        k = _bucket(h[f], buckets) + buckets
        asked.append((k[of][~known], _numbers(k)[of][~known], d[~known], s[~known]))
        for key, i, j in _pieces(k):
            x = f[i:j]
            wide = np.zeros((len(x), z.around), np.uint8)
            wide[:, z.left :] = m[x]
            none = np.zeros(len(x), np.uint8)
            out.append((1, key, block, pack(h[x], b.ids[d[x]], none, none + np.uint8(z.t), wide.reshape(-1))))
    key, number, d, p = (np.concatenate([a[i] for a in asked]).astype(np.int64) for i in range(4))
    out.append((2, -1, block, pack(lo.astype(np.int64), hi.astype(np.int64), key, number, d, p)))
    return _rows(out, _MESSAGE)


def _numbers(k: np.ndarray) -> np.ndarray:
    """The place of each entry in the message to its bucket."""
    order = np.argsort(k, kind="stable")
    s = k[order]
    start = np.searchsorted(s, s)
    out = np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - start
    return out


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; those of two documents meet at most at an edge, and are kept apart there."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, hi = lo[o], np.maximum.accumulate(hi[o])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    last = np.append(new[1:], True)
    return lo[new], hi[last]


def _radix(key: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that equal another of their key through all bytes, and their group; by digits of eight bytes."""
    rows = np.arange(len(key))
    wide = np.zeros((len(key), -(-windows.shape[1] // 8) * 8), np.uint8)
    wide[:, : windows.shape[1]] = windows
    digits = wide.view(">u8").astype(np.uint64)
    group = key
    for j in range(digits.shape[1]):
        digit = digits[rows, j]
        o = np.lexsort((digit, group))
        rows, group, digit = rows[o], group[o], digit[o]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        rows = rows[~alone]
        if not len(rows):
            break
    return rows, group


def _settle_rest(table: pa.Table, threshold: int) -> pa.Table:
    z = _Depth(threshold)
    got = [unpack(x.as_py()) for x in table["__cell"]]
    sizes = [len(x[0]) for x in got]
    g, doc, left, right = (np.concatenate([x[i] for x in got]) for i in range(4))
    m = np.concatenate([x[4].reshape(-1, z.around) for x in got])
    del got
    hits = np.zeros((len(g), z.w), bool)
    for o in range(z.w):
        fit = np.flatnonzero((o >= z.left - left.astype(int)) & (o + z.t <= z.left + right.astype(int)))
        if len(fit) < 2:
            continue
        rows, group = _radix(g[fit], m[fit, o : o + z.t])
        if not len(rows):
            continue
        rows = fit[rows]
        order = np.lexsort((doc[rows], group))
        rows, group = rows[order], group[order]
        new = np.ones(len(rows), bool)
        new[1:] = group[1:] != group[:-1]
        least = doc[rows][new][np.cumsum(new) - 1]
        hits[rows[doc[rows] > least], o] = True
    out, at = [], 0
    for block, size in zip(table["__block"].to_pylist(), sizes, strict=True):
        i, o = np.nonzero(hits[at : at + size])
        at += size
        if len(i):
            out.append((3, table["__bucket"][0].as_py(), block, pack(i.astype(np.uint32), o.astype(np.uint8 if z.w < 256 else np.uint32))))
    return _rows(out, _MESSAGE)


def _cut(texts: pa.Table, said: pa.Table, threshold: int, schema: pa.Schema, with_text: bool) -> pa.Table:
    if not texts.num_rows:
        return schema.empty_table()
    z = _Depth(threshold)
    b = _Block(texts, z, 1, sort=False)
    kinds, keys, cells = (said[c].to_pylist() for c in ("__kind", "__bucket", "__cell"))
    lo = hi = np.zeros(0, np.int64)
    for kind, cell in zip(kinds, cells, strict=True):
        if kind == 2:
            lo, hi, key, number, d, p = unpack(cell)
            order = np.lexsort((number, key))
            key, number, d, p = key[order], number[order], d[order], p[order]
    for kind, k, cell in zip(kinds, keys, cells, strict=True):
        if kind != 3:
            continue
        i, o = unpack(cell)
        a, e = np.searchsorted(key, k), np.searchsorted(key, k, side="right")
        first = np.searchsorted(number[a:e], i)
        count = np.searchsorted(number[a:e], i, side="right") - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()) + a
        s = p[at] - z.left + np.repeat(o.astype(np.int64), count)
        lo, hi = np.concatenate([lo, s]), np.concatenate([hi, s + z.t])
    gone = np.zeros(len(b.raw) + 1, np.int32)
    np.add.at(gone, lo, 1)
    np.add.at(gone, hi, -1)
    gone = np.cumsum(gone)[:-1] > 0
    edges = gone.copy()
    edges[1:] &= ~gone[:-1]
    begins = b.at[:-1][np.diff(b.at) > 0]
    edges[begins] = gone[begins]
    n_gone, n_edge = (np.append(0, np.cumsum(x, dtype=np.int64)) for x in (gone, edges))
    keep = ~gone
    sha, text, taken, spans = [], [], [], []
    for x, y in zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True):
        left = b.raw[x:y][keep[x:y]].tobytes() if n_gone[y] > n_gone[x] else b.raw[x:y].tobytes()
        sha.append(hashlib.sha256(left).hexdigest())
        text.append(left.decode("utf-8", "ignore") if with_text else None)
        taken.append(int(n_gone[y] - n_gone[x]))
        spans.append(int(n_edge[y] - n_edge[x]))
    long = np.diff(b.at)
    r = b.of_row
    pick = lambda x, kind: pa.array([x[i] for i in r.tolist()], kind)
    return pa.Table.from_arrays(
        [
            texts["row"].combine_chunks(),
            pa.array(long[r]),
            pick(taken, pa.int64()),
            pick(spans, pa.int64()),
            pick(sha, pa.string()),
            pick(text, pa.string()),
        ],
        schema=schema,
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = 50,
    columns: list[str] | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Cut repeated strings; see the module's text for the rule and for nulls, ties and empty input.

    Returns ``row`` (a struct of ``columns``, by default all of the input, so
    that no name can clash), ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``kept_text`` (null unless ``with_text``; bytes of
    characters cut in part are left out of it, though not of the digest).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, keep = docs.sparkSession, Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    blocks, buckets = max(8, total // BLOCK_BYTES), max(8, int(total * 0.085 / BUCKET_ENTRIES))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    # rows of one id, and copies of one row, are dealt to many blocks; the table fixes the deal
    dealt = F.pmod(F.xxhash64("__id", "__th", F.spark_partition_id()), F.lit(blocks))
    texts = rows.where("__id is not null").withColumn("__block", dealt)
    # texts are shuffled once, into the buckets of their blocks; every step reads them there
    texts = keep.dealt(texts, "__block", "blocked")
    small = texts.select("__block", "__id", "__th", "__text")
    once = small.groupBy("__block").applyInArrow(of_table(_first_digit, threshold=threshold, buckets=buckets), _MESSAGE_DDL)
    first = keep.table(once.groupBy("__bucket").applyInArrow(_settle_first, _MESSAGE_DDL), "first")
    again = small.groupBy("__block").cogroup(first.groupBy("__block"))
    asked = keep.table(again.applyInArrow(of_tables(_ask, threshold=threshold, buckets=buckets), _MESSAGE_DDL), "asked")
    keep.drop("first")
    rest = asked.where("__kind = 1").groupBy("__bucket").applyInArrow(of_table(_settle_rest, threshold=threshold), _MESSAGE_DDL)
    said = keep.table(asked.where("__kind = 2").unionByName(rest), "said")
    keep.drop("asked")
    counts = {name: F.lit(0).cast("long").alias(name) for name in ("n_bytes", "n_removed", "n_spans")}
    out = rows.select("row", *counts.values(), F.lit("").alias("kept_sha256"), F.lit("").alias("kept_text")).schema
    for f in out:
        f.nullable = True
    cutting = of_tables(_cut, threshold=threshold, schema=to_arrow_schema(out), with_text=with_text)
    cut = texts.groupBy("__block").cogroup(said.groupBy("__block")).applyInArrow(cutting, out)
    whole = rows.where("__id is null").select(
        "row",
        F.octet_length("__text").cast("long").alias("n_bytes"),
        counts["n_removed"],
        counts["n_spans"],
        F.sha2("__text", 256).alias("kept_sha256"),
        (F.col("__text") if with_text else F.lit(None).cast("string")).alias("kept_text"),
    )
    return cut.unionByName(whole)
