"""Vectorised text kernels over Arrow string columns: words, word hashes and hashed word windows.

White space is the ASCII set of the contracts, ``[\\x20\\x09-\\x0D]``.  A batch is
cut into slices of half a megabyte, so memory does not follow the batch size;
one text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one slice, unless a single text is longer.
SLICE_BYTES = 512 << 10

#: Rows of an Arrow batch: texts and sets are kilobytes each, and a batch is held on both sides of the pipe.
BATCH_ROWS = 500


def bounded_batches(spark) -> None:
    """Let the session hand rows to Python in batches of BATCH_ROWS at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give memory that is free back to the system: a reused worker otherwise keeps the most it ever needed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with :func:`trim` at its end."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return own


def bounded_sample(df, keys: list[str], most: int, columns: list) -> list:
    """At most ``most`` rows of ``columns``, those whose ``keys`` hash lowest, in that order.

    A bound on the hash lets about twice the sample pass, so neither one task
    nor the driver sees more rows as partitions grow.
    """
    from pyspark.sql import functions as F

    total = df.count()
    hashed = df.select(F.xxhash64(*keys).alias("_hash"), *columns)
    if total > 2 * most:
        hashed = hashed.where(F.col("_hash") < 2 * most * 2**64 // total - 2**63)
    order = [c for c in hashed.columns if c != "_hash"]
    return hashed.orderBy("_hash", *order).limit(most).select(*order).collect()


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Random values of bytes and, per worker, of places in a word: a sum of products of the two has no texts that always collide.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[LOWER]
_places = [np.zeros(0, np.uint64)]


def places(n: int) -> np.ndarray:
    """Odd random values of the first ``n`` places; kept up to a usual word's length."""
    if n <= len(_places[0]):
        return _places[0][:n]
    out = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    if n <= 1 << 16:
        _places[0] = out
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, null ones empty, and the bounds of each."""
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; faster here than np.unique, which hashes them first."""
    out = np.sort(values)
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out


class Words:
    """The words of a slice of texts: runs of bytes outside ``space``.

    ``data``/``off``: bytes and text bounds; ``start``/``end``: byte bounds of the
    words; ``first``: index of each text's first word, one more at the end.
    """

    def __init__(self, texts: pa.Array, space: np.ndarray = SPACE):
        self.data, self.off = text_bytes(texts)
        n = len(self.data)
        self.solid = solid = ~space[self.data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        own = self.off[:-1][self.off[1:] > self.off[:-1]]
        begins[own] = solid[own]
        own = self.off[1:][self.off[1:] > self.off[:-1]] - 1
        ends[own] = solid[own]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off) if n else np.zeros(len(self.off), np.int64)

    def __len__(self) -> int:
        return len(self.off) - 1

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; A-Z are lowered first if asked."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        data = self.data[self.solid]
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), size)
        value = (_BYTE_LOWER if lower else _BYTE).take(data)
        value *= places(int(size.max())).take(place)
        return mix(np.add.reduceat(value, begin) + np.uint64(0x632BE59BD9B4E019) * size.astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours in an array of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h += words[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix(h)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row bounds of slices with at most ``most`` bytes each, or one row."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        stop = max(stop, at + 1)
        yield at, stop
        at = stop


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``k``-word shingle hashes; a shorter text is one shingle, none if without words."""
    for a, b in slices(texts):
        words = Words(texts.slice(a, b - a))
        h = words.hashes(lower=True)
        all_windows = windows(h, k)
        for i in range(len(words)):
            lo, hi = words.first[i], words.first[i + 1]
            if hi - lo >= k:
                yield distinct(all_windows[lo : hi - k + 1])
            else:
                yield windows(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)
