"""Words and their 64-bit hashes, straight from the buffers of an Arrow string column.

A word is a maximal run of bytes other than space and tab to carriage return;
A-Z count as a-z in its hash. Work goes in blocks of about `BLOCK_BYTES`, so
memory is bounded by that and by the longest single text, never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WHITE = b" \t\n\x0b\x0c\r"

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a multiply-xorshift hash; a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets from 0) for runs of whole texts."""
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, length, words per text); no word crosses a text's end."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] |= inside[tails]
    lengths = np.flatnonzero(last) - starts + 1
    return starts, lengths, np.diff(np.searchsorted(starts, offsets))


def hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(begin[-1] + lengths[-1]) - np.repeat(begin, lengths)
    chars = data[np.repeat(starts, lengths) + place]
    sums = np.add.reduceat(_BYTE[chars] * _powers(int(lengths.max()))[place], begin)
    return mix(sums ^ (lengths.astype(np.uint64) << np.uint64(48)))


def each_text(per_text: np.ndarray) -> np.ndarray:
    """Offsets of each text's words from the number of words per text."""
    return np.concatenate(([0], np.cumsum(per_text)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
