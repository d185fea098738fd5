"""Word scanning over raw UTF-8 bytes with numpy.

All word classes used here are byte classes (the separators are ASCII), so a batch of texts is scanned as one byte
array: no Python object is made per word.  Every text is scanned whole; batches are cut between texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INV = pow(_MULT, -1, 1 << 64)


def byte_class(allowed) -> np.ndarray:
    """A 256-entry table: True where a byte belongs to a word."""
    return np.array([bool(allowed(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
LOWER_ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all others."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", _MULT), ("down", _INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class Words:
    """The words of some texts: starts and ends (bytes), doc (index of the text), first (index of each text's first word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.offsets, n = offsets, len(offsets) - 1
        inside = member[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal in every process."""
        up, down = _POWERS.to(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive items that start at each position (the last k - 1 positions have none)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


def blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string array (null: empty) between texts: first and last row, bytes and offsets of about `most` bytes each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if texts.null_count:  # what stands under a null is not defined
        texts = texts.fill_null("")
        yield from blocks(texts, most)
        return
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def scan(texts: pa.Array, member: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in blocks(texts):
        yield a, b, Words(data, offsets, member, lower)
