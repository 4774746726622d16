"""Vectorised text kernels that run inside Spark tasks.

All of them work on the UTF-8 bytes of an Arrow string column, a bounded slice
of rows at a time, so that memory depends on the slice (or on the longest
single text) and not on the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

#: The separators of ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Two bases, for hashes that are independent of each other.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse, up to n."""
    size = 1 << max(20, int(n).bit_length())
    if (size, base) not in _powers:
        one = np.full(size, np.uint64(_BASES[base]), dtype=np.uint64)
        inv = np.full(size, np.uint64(pow(_BASES[base], -1, 1 << 64)), dtype=np.uint64)
        one[0] = inv[0] = 1
        if size > 1 << 22:
            return np.cumprod(one), np.cumprod(inv)
        _powers[size, base] = np.cumprod(one), np.cumprod(inv)
    return _powers[size, base]


def prefix(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Running polynomial hash sums; see ``span_hash``."""
    up, _ = powers(len(values), base)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of values[start:end], equal for equal runs wherever they stand; ``base`` as for ``prefix``."""
    _, down = powers(len(sums), base)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def window_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive values."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(len(sums))
    return mix((sums[length:] - sums[:-length]) * down[:n] + np.uint64(length))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of a slice of texts.

    ``start``/``end``: byte offsets in ``data``; ``first``: for each text the
    index of its first word, with one more entry for the end; ``doc``: the text
    of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        offs = offsets - base
        n = len(self.data)
        space = IS_SPACE[self.data]
        begins = np.zeros(n + 1, dtype=bool)
        begins[offs] = True
        opening = ~space
        opening[1:] &= space[:-1] | begins[1:n]
        closing = ~space
        if n:
            closing[:-1] &= space[1:] | begins[1:n]
        self.start = np.flatnonzero(opening)
        self.end = np.flatnonzero(closing) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        sums = prefix((_BYTE_LOWER if lower else _BYTE)[self.data])
        return span_hash(sums, self.start, self.end)


def byte_values(data: np.ndarray) -> np.ndarray:
    """One 64-bit value for each byte, for hashing runs of bytes."""
    return _BYTE[data]


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys (two block-wise scans)."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    if width == 1:
        return keys.copy()
    pad = -len(keys) % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(keys.dtype).max, dtype=keys.dtype)]) if pad else keys
    blocks = full.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams the index of its least one, the last of equals.

    The choice depends on the grams inside the window alone, so equal windows
    choose the same gram.  The width of the place field is fixed, or the choice
    would also depend on the slice.
    """
    bits = np.uint64(26)
    if len(grams) >> 26:
        raise ValueError("cut the text into segments before winnowing")
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = low - np.arange(len(grams), dtype=np.uint64)
    least = window_minimum((grams & ~low) | place, width)
    return (low - (least & low)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x
