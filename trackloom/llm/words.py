"""Words of many texts at once, as arrays: where they lie and a 64-bit hash of each.

Hashes are polynomials over the bytes of a word, modulo 2^64, finished by a mixer; the
sums of a whole batch of bytes give every word's hash by one subtraction, so that no
word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, dtype=np.uint64)]))
            self.up, self.down = one(self.base), one(pow(self.base, -1, 1 << 64))
        return self.up, self.down


_POWERS = tuple(map(_Powers, _BASES))


def mixed(x: np.ndarray, times: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all of them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(times)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(times)
    return x ^ (x >> np.uint64(32))


def sums(values: np.ndarray, family: int = 0) -> np.ndarray:
    """Weighted running sums from which ``span_hash`` takes the hash of any stretch."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(np.multiply(values, _POWERS[family].upto(len(values))[0][: len(values)], dtype=np.uint64), out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the stretches [start, end); equal stretches have equal ones."""
    down = _POWERS[family].upto(len(running))[1]
    return mixed((running[ends] - running[starts]) * down[starts])


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct values in order (sorts in place, which is faster than ``np.unique``)."""
    keys.sort()
    keep = np.ones(len(keys), dtype=bool)
    keep[1:] = keys[1:] != keys[:-1]
    return keys[keep]


class Words:
    """The words of consecutive texts of a batch.

    ``offsets``: bytes at which texts begin, and the end; ``starts`` and ``ends`` of words
    in ``bytes``; ``text``: of each word the text; ``first``: per text its first word, and
    the end; ``hashes``: of the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.bytes, self.offsets = data, offsets
        inside = (data != 0x20) & (data - np.uint8(0x09) > np.uint8(0x04))
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & ~(before & ~cut[:-1]))
        self.ends = np.flatnonzero(inside & ~(after & ~cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hash(sums(data + np.uint8(1)), self.starts, self.ends)  # 0xFF is no byte of UTF-8

    @cached_property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)


def batches_of(texts: pa.Array, most_bytes: int = 1 << 17) -> Iterator[tuple[int, Words]]:
    """(first row, words) of runs of texts of about ``most_bytes``; a longer text is a run
    by itself.  Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1)
        yield row, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end
