r"""Words and word shingles of many texts at once, as 64-bit hashes in flat numpy arrays.

Words are runs of bytes other than \x20 and \x09-\x0D, as the contracts define;
A-Z count as a-z where asked. No Python object is made per word: a word's hash
is the sum of its bytes' random values, each times a power of an odd constant
by the byte's place, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUE = np.where(SPACE, np.uint64(0), _values)
LOWER_VALUE = VALUE.copy()
LOWER_VALUE[65:91] = VALUE[97:123]
POWER = np.uint64(0x9E3779B97F4A7C15)
ODD = _values[:64] | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashes of all words of some texts, in order, and where each text's begin (one more: the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        """data: the texts' bytes, one after another; offsets: where each begins, and the end."""
        space = SPACE[data]
        start = ~space
        start[1:] &= space[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[edge] = ~space[edge]
        self.starts = np.flatnonzero(start)
        n = len(self.starts)
        self.begin = np.searchsorted(self.starts, offsets)
        if n:
            size = np.diff(np.r_[self.starts, len(data)])
            place = np.arange(self.starts[0], len(data)) - np.repeat(self.starts, size)
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max()), POWER)])
            value = (LOWER_VALUE if lower else VALUE)[data[self.starts[0] :]] * powers[place]
            self.hashes = mixed(np.add.reduceat(value, self.starts - self.starts[0]))
        else:
            self.hashes = np.empty(0, np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words, and where each text's begin. A text with fewer words, but with one,
        has its whole sequence as one window; a text without words has none."""
        n = np.diff(self.begin)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        begin = np.r_[0, np.cumsum(count)]
        full = n >= k
        h = self.hashes
        total = int(begin[-1])
        out = np.empty(total, np.uint64)
        owner = np.repeat(np.arange(len(n)), count)
        first = self.begin[:-1][owner] + (np.arange(total) - begin[:-1][owner])
        whole = full[owner]
        at = first[whole]
        if len(at):
            out[whole] = mixed(sum((h[at + j] * ODD[j] for j in range(k)), np.uint64(0) * h[at]))
        for t in np.flatnonzero(~full & (n > 0)):
            own = h[self.begin[t] : self.begin[t + 1]]
            out[begin[t]] = mixed(np.array([(own * ODD[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
        return out, begin


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls empty, without a Python string."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def parts(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most so many bytes of text, or one row, each with its texts' bytes and offsets."""
    if not batch.num_rows:
        return
    raw, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1, begin + 1)
        end = min(end, batch.num_rows)
        yield batch.slice(begin, end - begin), raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def distinct(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct hashes."""
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        own = np.sort(hashes[a:b])
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
    return out
