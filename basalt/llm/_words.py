"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow batches.

Words are maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased.
Texts are worked through in segments of a few MB that end between words, so one
very long text needs no more memory than its own words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 21
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tuple(tables)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _segments(data: np.ndarray, at: np.ndarray):
    """Ends of segments: at the end of a text, or else between two words."""
    pos, n = 0, len(data)
    while pos < n:
        end = min(pos + SEGMENT, n)
        if end < n:
            k = at[np.searchsorted(at, end, "right") - 1]
            if k > pos:
                end = int(k)
            else:
                space = np.flatnonzero(_SPACE[data[pos:end]])
                if len(space):
                    end = pos + int(space[-1]) + 1
                else:
                    stop = int(at[np.searchsorted(at, end, "left")])
                    end = next((i for s in range(end, stop, SEGMENT) for i in (s + np.flatnonzero(_SPACE[data[s : min(s + SEGMENT, stop)]])[:1]).tolist()), stop)
        yield pos, end
        pos = end


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word in order, and the n + 1 offsets of each text's words."""
    hashes, firsts = [], []
    for lo, hi in _segments(data, at):
        b = data[lo:hi]
        word = ~_SPACE[b]
        inner = at[(at > lo) & (at < hi)] - lo
        fresh = np.ones(len(b), bool)
        fresh[1:] = ~word[:-1]
        fresh[inner] = True
        last = np.ones(len(b), bool)
        last[:-1] = ~word[1:]
        last[inner - 1] = True
        start, end = np.flatnonzero(word & fresh), np.flatnonzero(word & last) + 1
        up, down = _power_tables(max(len(b), 1))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP))
        firsts.append(start + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), at, "left")


def shingle_sets(hashes: np.ndarray, at: np.ndarray, k: int):
    """Yields each text's sorted distinct k-word shingles; a text of fewer words is one shingle."""
    n = len(hashes)
    if n >= k:
        run = hashes[: n - k + 1].copy()
        for j in range(1, k):
            run = run * _STEP + hashes[j : n - k + 1 + j]
        run = mix(run)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= k:
            yield np.unique(run[lo : hi - k + 1])
        elif hi > lo:
            h = np.uint64(hi - lo)
            for x in hashes[lo:hi]:
                h = mix(np.array([h], np.uint64) * _STEP + x)[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
