"""Arrow text columns as flat byte arrays, and arrays packed into binary cells.

Shuffling one Arrow cell with thousands of packed values costs far less than
thousands of rows, so operators that must exchange an entry per text position
send blocks made by :func:`pack`.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


#: Arrays of up to so many values are packed as they are: planes would cost more than they save.
FEW = 48
#: Numbers of up to so many values lose the bytes that none of them needs; more of them are compressed by planes.
#: A cell's cost then follows its values: compressing the planes of a hundred values costs as much as those of a thousand.
SOME = 4_096


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any integer type as one cell; small values cost little, and short arrays little more than their bytes."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code, few = a.dtype.str.encode(), len(a) <= FEW
        out.append(struct.pack("<B", len(code) + 128 * few) + code + struct.pack("<B" if few else "<Q", len(a)))
        if few:
            out.append(a.tobytes())
            continue
        if len(a) <= SOME and a.itemsize > 1:
            least = int(a.min())
            wide = max(1, ((int(a.max()) - least).bit_length() + 7) // 8)
            over = (a - a.dtype.type(least)).view(np.uint8).reshape(len(a), a.itemsize)[:, :wide]
            out.append(struct.pack("<B", wide) + a.dtype.type(least).tobytes() + over.tobytes())
            continue
        for plane in a.view(np.uint8).reshape(len(a), a.itemsize).T:
            plane = np.ascontiguousarray(plane)
            raw = plane.tobytes()
            # random planes stay as they are; others are mostly zero or repetitive
            sample = plane[:4096]
            small = zlib.compress(raw, 1) if np.count_nonzero(np.bincount(sample, minlength=256)) < 200 else raw
            small = small if len(small) < len(raw) else raw
            out.append(struct.pack("<Q", len(small)) + small)
    return b"".join(out)


def unpack(cell: bytes) -> list[np.ndarray]:
    n, at, out = cell[0], 1, []
    for _ in range(n):
        few, letters = cell[at] >= 128, cell[at] % 128
        kind = np.dtype(cell[at + 1 : at + 1 + letters].decode())
        at += 1 + letters
        if few:
            size = cell[at]
            out.append(np.frombuffer(cell, kind, size, at + 1).copy())
            at += 1 + size * kind.itemsize
            continue
        (size,) = struct.unpack_from("<Q", cell, at)
        at += 8
        if size <= SOME and kind.itemsize > 1:
            wide, least = cell[at], np.frombuffer(cell, kind, 1, at + 1)[0]
            at += 1 + kind.itemsize
            over = np.zeros((size, kind.itemsize), np.uint8)
            over[:, :wide] = np.frombuffer(cell, np.uint8, size * wide, at).reshape(size, wide)
            at += size * wide
            out.append(over.view(kind).reshape(size) + least)
            continue
        planes = np.empty((kind.itemsize, size), np.uint8)
        for i in range(kind.itemsize):
            (length,) = struct.unpack_from("<Q", cell, at)
            raw = cell[at + 8 : at + 8 + length]
            planes[i] = np.frombuffer(raw if length == size else zlib.decompress(raw), np.uint8)
            at += 8 + length
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
    return out


_B = 0xD6E8FEB86659FD93
_FULL = 1 << 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_B)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def rolling(symbols: np.ndarray, lengths: tuple[int, ...], base: int = _B) -> list[np.ndarray]:
    """Polynomial hashes of every run of so many symbols, by doubling."""
    runs = {1: symbols}
    size = 1
    while size * 2 <= max(lengths):
        cur = runs[size]
        runs[size * 2] = cur[:-size] * np.uint64(pow(base, size, _FULL)) + cur[size:] if len(cur) > size else cur[:0]
        size *= 2
    out = []
    for length in lengths:
        have, got = 0, None
        for bit in (1 << k for k in range(length.bit_length()) if length >> k & 1):
            cur = runs[bit]
            n = len(symbols) - have - bit + 1
            if n <= 0:
                got = symbols[:0]
                break
            got = cur[:n] if got is None else got[:n] * np.uint64(pow(base, bit, _FULL)) + cur[have : have + n]
            have += bit
        out.append(got)
    return out


def of_table(f, **fixed):
    """``f`` with parameters set, in the form that ``applyInArrow`` recognises."""

    def call(table: pa.Table) -> pa.Table:
        return f(table, **fixed)

    return call


def of_tables(f, **fixed):
    """The same for cogrouped tables."""

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right, **fixed)

    return call
