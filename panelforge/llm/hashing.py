"""Polynomial hashes of byte spans, all spans of a buffer at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte, so that no byte's hash is a small number.
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class SpanHash:
    """Hashes modulo 2**64 of spans [start, end) of a byte buffer; equal contents give equal hashes wherever they stand.

    Texts can be made whose hashes collide under every base, so these hashes deal out work and features; where equal
    hashes must mean equal contents, ``content_hashes`` are taken."""

    def __init__(self, base: int = BASE):
        self.base, self.size = base % (1 << 64) | 1, 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16, self.size * 2)
            with np.errstate(over="ignore"):
                steps = np.full(self.size, self.base, np.uint64)
                steps[0] = 1
                self.power = np.cumprod(steps)
                steps[1:] = pow(self.base, -1, 1 << 64)
                self.inverse = np.cumprod(steps)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(BYTES[data] * self.power[: len(data)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def content_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """XXH3 hashes of 128 bits of the spans [start, end) of data."""
    import xxhash

    h, view = xxhash.xxh3_128_digest, memoryview(data)
    return [h(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all bits of the result."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def text_groups(column, size: int = 1 << 18):
    """Groups of the texts of an Arrow string array without nulls: (first row, bytes, offsets into them), of about ``size`` bytes or one text."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1)
        yield k, data[offsets[k] : offsets[to]], (offsets[k : to + 1] - offsets[k]).astype(np.int64)
        k = to
