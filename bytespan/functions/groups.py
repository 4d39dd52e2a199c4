"""Numpy over the bytes of many blobs at once.

A group holds some blobs end to end. What is counted by blob and key is one sort of whole numbers in which blob, key and
place are packed, so a byte is an element of an array, never a row, and the work is in proportion to the bytes. A group has
256 KiB at most, so that its arrays stay in a core's cache, or one blob that is larger; no task holds more than a batch of
blobs and the arrays of one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytespan.functions.workers import ship

#: Bytes and blobs of a group.
GROUP, BLOBS = 1 << 18, 1 << 12
#: From this estimate of bytes on, rows are dealt over all shuffle partitions; below, adaptive execution joins small ones.
LARGE = 1 << 26


def width(n: int) -> int:
    """Bits of the numbers below n."""
    return max(int(n) - 1, 0).bit_length()


def dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys by one small number, in the order of the keys, and its bits."""
    found, at = np.unique(key, return_inverse=True)
    return at.astype(np.uint64), width(len(found))


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal elements begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


class Group:
    def __init__(self, data: np.ndarray, offset: np.ndarray):
        self.data, self.offset, self.n = data, offset, len(offset) - 1
        self.size = np.diff(offset)
        self.blob = np.repeat(np.arange(self.n, dtype=np.uint64), self.size)
        self.place = np.arange(len(data)) - np.repeat(offset[:-1], self.size)

    def back(self, k: int) -> np.ndarray:
        """For every byte the one k places before it in its blob, 0 before the start."""
        out = np.zeros(len(self.data), np.uint8)
        if k < len(out):
            out[k:] = self.data[: len(out) - k]
        out[self.place < k] = 0
        return out.astype(np.uint64)

    def context(self, order: int) -> tuple[np.ndarray, int]:
        """The order bytes before every byte as one number, and its bits; long contexts are numbered."""
        key, bits = np.zeros(len(self.data), np.uint64), 0
        for k in range(order, 0, -1):
            if bits + 8 > 40:
                key, bits = dense(key)
            key, bits = key << np.uint64(8) | self.back(k), bits + 8
        return key, bits

    def by_place(self, key: np.ndarray, bits: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, starts): all places, or those to keep, ordered by blob, key and place, and where in that order another
        key begins."""
        own, low = width(self.n), width(len(self.data))
        if own + bits + low > 64:
            key, bits = dense(key)
        packed = key << np.uint64(low) | np.arange(len(key), dtype=np.uint64)
        if own:
            packed |= self.blob << np.uint64(bits + low)
        if keep is not None:
            packed = packed[keep]
        packed.sort()
        return (packed & np.uint64((1 << low) - 1)).astype(np.int64), run_starts(packed >> np.uint64(low))

    def seen(self, key: np.ndarray, bits: int) -> np.ndarray:
        """For every byte how often its key occurred before in its blob."""
        at, starts = self.by_place(key, bits)
        out = np.empty(len(at), np.int64)
        out[at] = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        return out

    def previous(self, key: np.ndarray, bits: int, keep: np.ndarray | None = None) -> np.ndarray:
        """For every byte the last place in the group with the same key in its blob, else -1; keep: only among these."""
        at, starts = self.by_place(key, bits, keep)
        out = np.full(len(self.data), -1, np.int64)
        out[at[1:]] = at[:-1]
        out[at[starts]] = -1
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by blob; no blob may be empty."""
        return np.add.reduceat(values, self.offset[:-1]) if self.n else np.zeros(0, values.dtype)


#: log2(n!) up to 2^16.
FACTORIALS = np.cumsum(np.r_[0, np.log2(np.arange(1, (1 << 16) + 1, dtype=np.longdouble))]).astype(np.float64)


def log2_factorial(n: np.ndarray) -> np.ndarray:
    out = FACTORIALS[np.minimum(n, len(FACTORIALS) - 1)]
    large = np.flatnonzero(n >= len(FACTORIALS))
    if len(large):
        x = n[large].astype(np.float64)
        out[large] = ((x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)) / np.log(2)
    return out


def code_lengths(g: Group, context: np.ndarray, bits: int, blob: np.ndarray | None = None, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bits, contexts) of every blob under an adaptive model of these contexts; blob and n: other numbers of the blobs."""
    blob, n = g.blob if blob is None else blob, g.n if n is None else n
    if width(n) + bits + 8 > 64:
        context, bits = dense(context)
    key = blob << np.uint64(bits + 8) | context << np.uint64(8) | g.data
    if width(n) + bits + 8 <= 32:  # half the bytes are sorted in half the time
        key = key.astype(np.uint32)
    key.sort()
    starts = run_starts(key)
    counts = np.diff(np.r_[starts, len(key)])
    of = key[starts] >> 8
    first = run_starts(of)
    if not len(first):
        return np.zeros(n), np.zeros(n, np.int64)
    total, inner = np.add.reduceat(counts, first), np.add.reduceat(log2_factorial(counts), first)
    owner = (of[first] >> bits).astype(np.int64)
    cost = log2_factorial(total + 255) - FACTORIALS[255] - inner
    return np.bincount(owner, cost, n), np.bincount(owner, minlength=n)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offset) of a binary column without nulls; nothing is copied."""
    _, offsets, values = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offset = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8), offset


def cuts(size: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows that make a group of most bytes (GROUP), by the bytes of each row."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (most or GROUP), "right"))
        b = min(max(b, a + 1), a + BLOBS, len(size))
        yield a, b
        a = b


def groups(batch: pa.RecordBatch, name: str, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, Group]]:
    """Rows of a batch and the group of their blobs, the binary column name."""
    if not batch.num_rows:
        return
    data, offset = bytes_of(batch.column(name))
    for a, b in cuts(np.diff(offset), most):
        yield batch.slice(a, b - a), Group(data[offset[a] : offset[b]], offset[a : b + 1] - offset[a])


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out by columns: over all shuffle partitions where they are many, else as adaptive execution has it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by) if table_bytes(rows) >= LARGE else rows.repartition(*by)


def table_bytes(rows: DataFrame) -> int:
    """Spark's estimate of the bytes of rows, 0 where it has none (rows that were made by a program)."""
    n = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def over_batches(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """f over the batches of rows; it yields columns by name."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def over_groups(rows: DataFrame, f: Callable[[pa.RecordBatch, Group], dict], schema: str, name: str = "data", empty: bool = False, most: int | None = None) -> DataFrame:
    """f over groups of the blobs in the binary column name, with their rows; it returns columns by name. Empty blobs are
    left out, unless empty says otherwise; most: bytes of a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for found, g in groups(batch, name, most):
                yield f(found, g)

    return over_batches(rows if empty else rows.filter(F.octet_length(name) > 0), run, schema)
