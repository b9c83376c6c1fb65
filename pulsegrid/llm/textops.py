"""Vectorised word and shingle hashing over Arrow string columns.

Everything here works on whole texts, a few megabytes of text at a time, so the
memory a task needs does not depend on how many rows a batch or partition has
(a single longer text is handled alone).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: bijective for a fixed seed."""
    with np.errstate(over="ignore"):
        z = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


#: What a worker keeps from task to task, by name: how to let go of it.
HELD: dict = {}


def released(run, own: str | None = None):
    """``run`` over Arrow batches; what it held goes back to the system at its end, as workers live on between tasks.

    Whatever other operators keep in this worker is let go of first, but for what is called ``own``.
    """

    def again(batches):
        for name, forget in HELD.items():
            if name != own:
                forget()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return again


_BYTE = mix(np.arange(256, dtype=U64), 11)
_BYTE_LOWER = _BYTE[_LOWER]
_P = 0x5851F42D4C957F2D | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i <= n."""
    if len(_powers.get("p", ())) <= n:
        m = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", _P_INV)):
                a = np.full(m, base, dtype=U64)
                a[0] = 1
                _powers[key] = np.cumprod(a, dtype=U64)
    return _powers["p"], _powers["q"]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string_view(texts.type) or pa.types.is_large_string(texts.type) or pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(texts))
        o = offsets[i : j + 1]
        yield i, j, raw[o[0] : o[-1]], o - o[0]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes, and each text's range in them."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_GAP[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[at] = solid[at]
    last = at[1:] - 1
    end[last] = solid[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lowered if asked."""
    p, q = _power(len(data))
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, U64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[: len(data)], out=c[1:])
        return mix((c[ends] - c[starts]) * q[starts], 3)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of every text, end to end, and their offsets.

    A text of 1 to k-1 words has one shingle, its whole word sequence; one without words has none.
    """
    starts, ends, wo = words(data, offsets)
    w = word_hashes(data, starts, ends)
    n = np.diff(wo)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    so = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=so[1:])
    h = np.zeros(so[-1], U64)
    with np.errstate(over="ignore"):
        if len(w):
            # index of each shingle's first word
            first = np.arange(so[-1]) - np.repeat(so[:-1] - wo[:-1], count)
            short = np.repeat(n < k, count)
            full = first[~short]
            acc = np.zeros(len(full), U64)
            for j in range(k):
                acc = acc * U64(0xD6E8FEB86659FD93) + w[full + j]
            h[~short] = mix(acc, 5)
            for i in np.flatnonzero((n > 0) & (n < k)):
                acc1 = U64(0)
                for j in range(int(n[i])):
                    acc1 = acc1 * U64(0xD6E8FEB86659FD93) + w[wo[i] + j]
                h[so[i]] = mix(np.array([acc1], U64), 100 + int(n[i]))[0]
    for i in np.flatnonzero(count > 1):
        h[so[i] : so[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[so[:-1][count > 0]] = True
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return h[keep], kept[so]
