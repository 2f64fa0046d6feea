"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case: digits, Latin letters and everything beyond ASCII.  As all bytes of a code
point beyond ASCII are 0x80 or more, the bytes of the text give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
SLICE = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def _table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        if 0x30 <= low <= 0x39 or 0x61 <= low <= 0x7A or low >= 0x80:
            table[b] = low
    return table


TABLE = _table()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi``, their bytes and their offsets in these, about ``size`` bytes at a time."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, none negative, compressed in the smallest type that holds them."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([values.itemsize]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(values.tobytes(), asbytes=True)


def unpacked(blob: bytes | pa.Buffer) -> np.ndarray:
    head = bytes(blob[:9])
    size, n = head[0], int.from_bytes(head[1:], "little")
    return np.frombuffer(pa.decompress(blob[9:], decompressed_size=size * n, codec="zstd", asbytes=True), f"<u{size}")


class Words:
    """Words of a slice: ``start``, ``end`` (bytes), ``doc`` (row in the slice), ``hash``; ``first[d]`` is the first word of row d."""

    __slots__ = ("doc", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = TABLE[data]
        inside = low > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate((np.zeros(1, bool), inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], np.zeros(1, bool))) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.hash = span_hashes(low, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


class _Held(dict):
    """A cache that is empty again wherever it is sent."""

    def __reduce__(self):
        return _Held, ()


_POWERS: dict[int, np.ndarray] = _Held()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared and so on; the longest yet asked for is held."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE + 1), base, np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if n <= 4 * SLICE:
            _POWERS[int(base)] = held
    return held[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_P_INV, len(data) + 1)[start] + (end - start).astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``k`` words within a row."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = words.hash[:n].copy()
    for j in range(1, k):
        total *= _Q
        total += words.hash[j : j + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return at, mix(total[at] + np.uint64(k))


def words_of(text: str) -> Words:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]))
