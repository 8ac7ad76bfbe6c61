"""Words of many texts at once as numpy arrays, for use inside Arrow tasks.

Texts are taken as UTF-8 bytes.  Words are runs of bytes outside a set of ASCII separators,
so multi-byte characters need no decoding.  A word is known by a 64-bit hash of its bytes
with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
# Letters A-Z are words too: they are lower-cased before the separators are applied.
NOT_ALPHANUMERIC[0x41:0x5B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(LOWER.astype(np.uint64) + np.uint64(1))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of consecutive texts: byte range, text index and hash of each; `first[d]` is
    the index of the first word of text d, with one more entry at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def byte_list(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def release() -> None:
    """Gives free Arrow memory back at the end of a task, as its worker serves later stages too."""
    pa.default_memory_pool().release_unused()


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is alone."""
    low = size = 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > limit:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def words(texts: list[bytes], separators: np.ndarray = SPACES) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~separators[data]
    edge = np.flatnonzero(np.diff(inside))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    start, end = edge[::2], edge[1::2]
    length = end - start
    doc = np.searchsorted(ends, start)
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    if len(start):
        at = np.flatnonzero(inside[1:])
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(len(at)) - np.repeat(begin, length)
        value = _CODE[data[at]] * _power(int(length.max()))[place]
        hashes = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, start, end, doc, hashes, first)


def word_hash(word: str) -> np.uint64:
    return words([word.encode()]).hash[0]


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start word of every run of k words inside one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for j in range(1, k):
        h = h * _STEP + w.hash[j : n + j]
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return mix(h[at]), at


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words has its
    whole word sequence as one shingle, a text without words none."""
    w = words(texts)
    h, at = shingles(w, k)
    cut = np.searchsorted(at, w.first)
    for d in range(len(texts)):
        low, high = cut[d], cut[d + 1]
        if high > low:
            yield np.unique(h[low:high])
        elif w.first[d + 1] > w.first[d]:
            whole = np.uint64(len(w.hash[w.first[d] : w.first[d + 1]]))
            for x in w.hash[w.first[d] : w.first[d + 1]]:
                whole = mix(np.array([whole]))[0] ^ x
            yield mix(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)
