"""Vectorised text primitives shared by the operators of this subpackage.

An Arrow string column is read as one byte buffer plus offsets; words, lines and hashes of all rows of a
chunk are then found by a fixed number of numpy passes, with no loop over rows. Chunks hold about
``CHUNK_BYTES`` of text, so temporaries stay at a few dozen MB whatever the size of the Arrow batch.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
ARROW_ROWS = "2000"
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def small_batches(spark) -> None:
    """Arrow batches of at most 2,000 rows, so that a worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def one_thread() -> None:
    """Keep this worker's matrix products on one core: as many workers run as there are cores, and numpy's BLAS
    otherwise starts threads in each that wait for each other, which costs several times the time."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        limit = getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None)
        if limit is not None:
            limit(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works in place on its argument when that is a fresh array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _U64], np.uint64))[0])


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), CHUNK_BYTES)
        for base, keep in ((_BASE, "_powers"), (_BASE_INVERSE, "_inverses")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[keep] = np.cumprod(steps)
    return _powers, _inverses


class Hasher:
    """Hashes of any ranges of a sequence of 64-bit codes, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of that many codes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of that width, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique hashes instead of sorting, which is many times slower here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def as_column(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a ``text`` column that hold about ``limit`` bytes of it, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def all_chunks(batches) -> Iterator[pa.RecordBatch]:
    """The chunks of all batches of a task; what they took is then given back."""
    for batch in batches:
        yield from chunks(batch)
    trim()


def trim() -> None:
    """Give memory that is no longer used back to the system: workers live on after a task, beside those of others."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken; names differ in more than case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every row: byte ranges, row numbers, and row offsets into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.ones(len(data) + 1, bool)  # a word also ends where its row does
        edge[1:-1] = self.blank[:-1]
        edge[offsets] = True
        ends = np.zeros(len(data) + 1, bool)
        ends[:-1] = self.blank
        ends[offsets] = True
        self.starts = np.flatnonzero(edge[:-1] & ~self.blank)
        self.ends = np.flatnonzero(ends[1:] & ~self.blank) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._bytes: Hasher | None = None

    @property
    def bytes(self) -> Hasher:
        if self._bytes is None:
            self._bytes = Hasher(BYTE_CODES[self.data])
        return self._bytes

    def hashes(self) -> np.ndarray:
        return self.bytes.ranges(self.starts, self.ends)


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in every row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets
