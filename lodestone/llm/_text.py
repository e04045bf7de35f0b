"""Vectorised text scanning shared by the operators of this subpackage.

Texts are handled as one byte (or code point) array a chunk, so that a cost is
paid per chunk and not per document.  A chunk is closed at ``CHUNK_BYTES``; a
longer document makes a chunk of its own, nothing is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

with np.errstate(over="ignore"):
    _BYTE_VALUE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(n, CHUNK_BYTES).bit_length()
        for base, name in ((_P, "_powers"), (_PINV, "_inverses")):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            globals()[name] = np.multiply.accumulate(full)
    return _powers[:n], _inverses[:n]


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``values[starts:ends]``, equal for equal slices.

    ``values`` are unsigned 64-bit symbols.  Prefix sums of symbol times power give
    the hash of any slice in two look-ups; the length is mixed in.
    """
    powers, inverses = _power_tables(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverses[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) of a string column, in chunks of ``size`` bytes; null counts as empty."""
    size = size or CHUNK_BYTES
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1, row + 1)
        end = min(end, len(column))
        part = offsets[row : end + 1]
        yield row, end, data[part[0] : part[-1]], part - part[0]
        row = end


def word_table(keep: bytes | None = None, drop: bytes | None = None) -> np.ndarray:
    """Look-up from byte to (lower-cased byte, or 0 for a separator); 0 is never a word byte here."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if (keep is not None and b in keep) or (drop is not None and b not in drop):
            out[b] = table[b]
    return out


#: Word bytes of benchmark matching: digits, letters and all bytes of other scripts.
ALNUM = word_table(keep=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


class Words:
    """Words of a chunk: ``starts``, ``ends``, ``doc`` (row in the chunk), ``bounds`` (first word of each row), ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool) -> None:
        if alnum:
            low = ALNUM[data]
            inside = low != 0
        else:
            upper = (data >= 65) & (data <= 90)
            low = data + (upper.view(np.uint8) << 5)
            inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        start = inside.copy()
        if n:
            start[1:] &= ~inside[:-1] | first[1:n]
        end = np.zeros(n + 1, bool)
        if n:
            end[1:] = inside
            end[1:n] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.low = low
        self.hashes = slice_hashes(_BYTE_VALUE[low], self.starts, self.ends)

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The lower-cased bytes of some words."""
        raw = self.low.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)] if len(which) else []

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    at = np.cumsum(counts)[:-1]
    full = counts > 0
    begin = np.concatenate(([0], at))[full]
    first = starts[full].astype(np.int64)
    steps[begin[0]] = first[0]
    if len(begin) > 1:
        steps[begin[1:]] = first[1:] - (first[:-1] + counts[full][:-1] - 1)
    return np.cumsum(steps)
