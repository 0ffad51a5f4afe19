"""Words of texts and their hashes, in numpy over a batch's bytes.

Words are the runs of bytes outside ``\\x20\\x09-\\x0D``, with A-Z lower-cased. A word's hash is a
polynomial of its bytes modulo 2**64, mixed; it depends on the bytes alone, so all workers agree.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; only a single longer text exceeds it.
CHUNK = 2 << 20
#: Bytes hashed at once, in words as a whole.
PIECE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PART = np.zeros(256, bool)
PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LETTER = mix(np.arange(1, 257, dtype=U))
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE * 2, n)
    if size not in _POW:
        _POW.clear()
        _POW[size] = powers(BASE, size), powers(INVERSE, size)
    return _POW[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]`` for ascending spans that don't overlap."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(LETTER[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0x632BE59BD9B4E019)
        at = to
    return mix(out)


class Texts(NamedTuple):
    """Some rows of a batch: ids (with validity) and the bytes of their texts, end to end."""

    ids: np.ndarray
    valid: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, the words' starts and ends, and at which word each text begins (with the end)."""
        data = LOWER[self.data]
        starts, ends = self._runs(~SPACE[data])
        return data, starts, ends, np.searchsorted(starts, self.offsets)

    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for runs of letters and digits (and of bytes beyond ASCII)."""
        data = LOWER[self.data]
        starts, ends = self._runs(PART[data])
        return data, starts, ends, np.searchsorted(starts, self.offsets)

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = self.offsets[:-1]
        edges = edges[edges < len(inside)]
        begin[edges] = inside[edges]
        starts = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        stop[last] = inside[last]
        return starts, np.flatnonzero(stop) + 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What a worker keeps for its next tasks, with when it was last used; dropped by release() when IDLE seconds have gone by.
KEPT: dict[object, list] = {}
IDLE = 15


def kept(key: object, make: Callable[[], object]) -> object:
    if key not in KEPT:
        KEPT[key] = [0.0, make()]
    KEPT[key][0] = time.monotonic()
    return KEPT[key][1]


def release() -> None:
    """Drop what is idle and give freed memory back to the system: a worker is idle, or another stage's, after its task."""
    for key in [k for k, (used, _) in KEPT.items() if time.monotonic() - used > IDLE]:
        del KEPT[key]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[Texts]:
    """Batches of (id, text), cut into pieces of about ``chunk`` bytes; no text is cut."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        valid = ~np.asarray(ids.is_null())
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = buffers(column)
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1)
            yield Texts(keys[at:to], valid[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        del batch, ids, column, data, offsets
    release()


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, in order; one for each place where a run of n fits."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, U)
    out = np.zeros(k, U)
    for j in range(n):
        out *= U(BASE)
        out += h[j : j + k]
    return mix(out)
