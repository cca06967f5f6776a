"""Whole Arrow string columns as flat numpy arrays: words, hashes and counts without a Python loop per word.

A column's texts lie one after the other in one buffer. Every function here works on that buffer at once and cuts at
the document bounds, so nothing ever spans two texts. Nulls count as empty texts. Offsets are in bytes of UTF-8.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BY_SPACE = ~SPACE

#: Letters, digits and everything outside ASCII.
WORD_ALNUM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_ALNUM[_low:_high] = True

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes that begin a code point.
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Texts:
    """Some texts: ``data`` holds their bytes, text i is ``data[bounds[i]:bounds[i + 1]]``; ``first`` is the row of text 0."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes of each text are marked."""
        return run_totals(flags, self.bounds)


def run_totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def give_back() -> None:
    """Return freed memory to the system. Workers live on after a task, and what one kept would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows and bytes of an Arrow batch of whole texts. Both sides of a worker's pipe hold one, so it is kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches within BATCH_ROWS and BATCH_BYTES; smaller settings stay as they are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        said = spark.conf.get(name).lower().rstrip("b")
        now = int(said.rstrip("kmgtp") or 0) << 10 * ("kmgtp".find(said[-1:] or "-") + 1)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def lean(run: Callable) -> Callable:
    """A task's function over batches that gives memory back after each batch and at its end."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())
        give_back()

    return inner


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column, in order, a slice at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        end = min(end, n)
        low, high = bounds[at], bounds[end]
        yield Texts(flat[low:high], bounds[at : end + 1] - low, at)
        at = end


def spans(texts: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes: their starts, their ends (exclusive), and the bounds of each text's runs."""
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(texts) + 1, np.int64)
    cut = texts.bounds[1:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    at = cut[cut < n]
    begins[at] = inside[at]
    at = cut[cut > 0] - 1
    ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, texts.bounds)


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            tables.append(table)
        if n > SLICE_BYTES * 2:  # a very long text's tables go with it
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class SpanHasher:
    """64-bit hashes of any byte ranges of one buffer, from one running polynomial sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


#: Multipliers of the words of a window, by place.
PLACE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words of one text, and the bounds of each text's windows.

    The windows of a text of n words stand at its first n - size + 1 words; shorter texts have none.
    """
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out_bounds[1:])
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), out_bounds
    sums = words[:n] * PLACE[0]
    for i in range(1, size):
        sums += words[i : i + n] * PLACE[i]
    total = int(out_bounds[-1])
    at = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], counts)
    return mixed(sums[at]), out_bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each item of the runs within ``bounds`` the number of its run."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
