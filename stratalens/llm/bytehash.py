"""Rolling fingerprints of all substrings of a batch of texts, in whole-array numpy steps."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Fixed: an odd base for the rolling sums and the multipliers of the finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = pow(int(BASE), -1, 2**64)
#: Random values of the 256 bytes, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x):
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int):
    with np.errstate(over="ignore"):
        up = np.full(size, BASE, np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(_INVERSE), np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(size: int):
    """BASE**i and BASE**-i modulo 2**64, for i below the next power of two (at least 2**20)."""
    return _powers(max(1 << 20, 1 << (size - 1).bit_length()))


class Prefix:
    """Prefix sums over a byte array, or over the ``values`` of larger letters; ``of(start, end)`` is the fingerprint of
    bytes[start:end]."""

    def __init__(self, data, values: bool = False):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data if values else BYTE_VALUES[data]) * up[: len(data)], out=self.sums[1:])

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all_of(self, width: int):
        """Fingerprints of every substring of ``width`` bytes, by start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, at: int, most_bytes: int = 256 << 10):
    """A record batch cut into slices whose column ``at`` holds about ``most_bytes`` (one row at least)."""
    _, offsets = bytes_of(batch.column(at))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
