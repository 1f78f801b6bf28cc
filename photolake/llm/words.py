"""Vectorised word and n-gram hashes over Arrow string arrays.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, lower-cased; everything else
separates words. All texts of a batch are hashed together, so the cost per word is a few array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are handled in slices of about this many bytes, whatever the size of the batch.
SLICE_BYTES = 4 << 20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 places where texts begin (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first, array) of consecutive texts with about ``limit`` bytes together, or one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield first, texts.slice(first, i - first)
            first, total = i, 0
        total += size
    if len(texts) > first:
        yield first, texts.slice(first)


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True,
                is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, and the n + 1 places where each text's words begin in these arrays."""
    n = len(raw)
    marks = np.zeros(n + 2, dtype=bool)
    marks[1:-1] = is_word[raw]
    # a word ends at a text's end: its first byte starts a new word although a word byte precedes it
    edge = np.flatnonzero(marks[1:] != marks[:-1])
    starts, ends = edge[::2], edge[1::2]
    inner = bounds[1:-1]
    cut = inner[(inner > 0) & (inner < n)]
    cut = np.unique(cut[marks[cut] & marks[np.minimum(cut + 1, n + 1)]])
    if len(cut):
        starts = np.sort(np.concatenate([starts, cut]))
        ends = np.sort(np.concatenate([ends, cut]))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends, np.zeros(len(bounds), dtype=np.int64)
    values = raw
    if lower:
        values = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    weighed = (values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(weighed, out=total[1:])
    inverse = powers(BASE_INVERSE, n)
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] at each i; windows over the end of a text are left to the caller."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(BASE) + words[k:k + m]
    return mix(total)


def ngram_places(first: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the n-grams that stay inside one text, and the text of each. ``m``: number of words."""
    sizes = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first[:-1], sizes) + inside, text
