"""Vectorised text kernels over Arrow string columns.

Texts are handled as UTF-8 bytes: all separators of interest are ASCII, so byte
classes split UTF-8 exactly.  Words and n-grams are named by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 20  # bytes handled at once, unless one text is longer


def _byte_names() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_NAMES = _byte_names()
_LOWER_NAMES = _NAMES.copy()
_LOWER_NAMES[65:91] = _NAMES[97:123]

#: Word bytes: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions 0 to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _powers[:] = [_geometric(_BASE, size), _geometric(_INVERSE, size)]
    return _powers[0], _powers[1]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Words:
    """The words of some rows: ``hashes`` in order, and ``first[i]:first[i + 1]`` of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> None:
        offsets = offsets.astype(np.int64)
        base = offsets[0]
        data = data[base : offsets[-1]]
        offsets = offsets - base
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
            return
        inside = word_bytes[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        power, inverse = _tables(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_LOWER_NAMES[data] * power[:n], out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        self.hashes = mix(raw ^ (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words (row borders are up to the caller)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = out * _STEP + hashes[k : k + m]
    return mix(out ^ np.uint64(n))


def shingle_sets(words: Words, n: int):
    """For each row the sorted distinct n-gram hashes; shorter rows are one sequence; no words: empty."""
    grams = ngrams(words.hashes, n)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngrams(words.hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes: the planes of leading zeros compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``Words`` names them."""
    data, offsets = utf8(pa.array(words, pa.string()))
    return Words(data, offsets, ALNUM).hashes


def release() -> None:
    """Give freed memory back to the system: a worker is kept for later tasks, and its memory with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(kernel):
    """A kernel over Arrow batches that ends with ``release``."""

    @functools.wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            release()

    return run
