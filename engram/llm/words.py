"""Vectorised word splitting over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything here works on
the contiguous byte buffer of a whole Arrow slice, so the per-word cost is a handful of numpy
operations instead of a Python object.  The helpers are meant to run inside ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; keeps the work arrays of one slice in a few tens of MB.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"][:n], _tables["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of the texts of a slice: hash per word, byte bounds, and each text's word range."""

    __slots__ = ("data", "ends", "first", "hash", "starts", "text_offsets")

    def __init__(self, data, text_offsets, starts, ends, first, hashes):
        self.data, self.text_offsets, self.starts, self.ends, self.first, self.hash = data, text_offsets, starts, ends, first, hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text's ordinal in the slice, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        up, down = _powers(high - low + 1)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (total[e] - total[s]) * down[s]
        at = upto
    return mix(out)


def split_words(column: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Splits every text of an Arrow string column; a word's hash depends on its bytes only."""
    data, offsets = text_buffer(column)
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    begin[at] = word[at]
    at = offsets[1:][filled] - 1
    end[at] = word[at]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, first, _hash_words(data, starts, ends) if hashes else None)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries; entry i covers i .. i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = SLICE_BYTES - size
    for at in range(0, n, step):
        m = min(step, n - at)
        up, down = _powers(m + size)
        total = np.zeros(m + size, dtype=np.uint64)
        np.cumsum(hashes[at : at + m + size - 1] * up[: m + size - 1], out=total[1:])
        out[at : at + m] = (total[size : size + m] - total[:m]) * down[:m]
    return mix(out)


def range_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range first[i] .. first[i + 1]."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def chunks(batch: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of a few rows, so that the receiver holds little at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that the texts of a slice take about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto
