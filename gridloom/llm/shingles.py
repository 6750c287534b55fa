"""Distinct word shingles of whole texts, as 64-bit numbers, with numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gridloom.llm.common import mix64

#: Words of one shingle.
WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BASE = 0x2545F4914F6CDD1D  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Per byte: A-Z lower-cased, then a random number.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64((_LOWER.astype(np.uint64) + np.uint64(1)) * _ODD[0])
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, kept as long as the longest text so far."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()
#: Bytes that are hashed in one go; a longer text is cut behind a blank.
_PART = 1 << 20


def _words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of UTF-8 bytes, in order."""
    out, start = [], 0
    while start < len(data):
        end = min(start + _PART, len(data))
        while end < len(data) and not _BLANK[data[end - 1]]:
            more = np.flatnonzero(_BLANK[data[end: end + _PART]])
            end = end + int(more[0]) + 1 if len(more) else min(end + _PART, len(data))
        out.append(_words_of(data[start:end]))
        start = end
    return np.concatenate(out) if len(out) != 1 else out[0]


def _words_of(part: np.ndarray) -> np.ndarray:
    dark = np.concatenate(([False], ~_BLANK[part], [False]))
    edges = np.flatnonzero(dark[1:] != dark[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _POWERS(len(part) + 1)
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
    return mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _ODD[1])


def shingle_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text; with fewer words than a shingle has, one of all of them; none without words."""
    w = _words(data) if len(data) else np.zeros(0, dtype=np.uint64)
    if not len(w):
        return w
    n = min(len(w), WORDS)
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix64(h * _ODD[4] + w[k: len(w) - n + 1 + k] * _ODD[k])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow array of strings; null is empty."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, dtype=np.uint8)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        yield shingle_set(data[ends[i]: ends[i + 1]] if known[i] else data[:0])


def set_hash(h: np.ndarray) -> int:
    """64-bit number of a set of shingles, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix64(np.bitwise_xor.reduce(mix64(h + _ODD[2])) + np.add.reduce(mix64(h ^ _ODD[3])) * _ODD[1] + np.uint64(len(h)))
    return int(np.asarray(total).astype(np.int64))


