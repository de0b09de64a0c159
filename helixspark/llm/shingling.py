"""Words and word shingles of whole batches of texts, as 64-bit hashes in numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case.  A text's set is its distinct
shingles of ``width`` consecutive words; a text with fewer words has the whole sequence as its one shingle; without
words the set is empty.  Words are hashed by a polynomial over random byte values, shingles by a mix of their words'
hashes; both are 64 bits wide, so that sets of hashes stand for the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 17  # bytes hashed at a time, unless one text is longer


@lru_cache(2)
def _tables(alphanumeric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240901))
    value = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    value[65:91] = value[97:123]
    gap = np.zeros(256, dtype=bool)
    if alphanumeric:
        gap[:128] = [not chr(i).isalnum() for i in range(128)]
    else:
        gap[[0x20, 9, 10, 11, 12, 13]] = True
    value[gap] = 0
    return value, gap


_POWERS: list[np.ndarray] = []
_STEP = U(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, CHUNK * 2)
        inverse = U(pow(int(_STEP), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(n - 1, x)])) for x in (_STEP, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of whole texts; null is empty."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_starts(data: np.ndarray, offsets: np.ndarray, alphanumeric: bool = False) -> np.ndarray:
    """First byte of each word."""
    if not len(data):
        return np.empty(0, dtype=np.int64)
    inside = ~_tables(alphanumeric)[1][data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    return np.flatnonzero(start)


def words(data: np.ndarray, offsets: np.ndarray, alphanumeric: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first byte of each word, first word of each text and the end).

    With ``alphanumeric`` a word is a run of bytes other than the ASCII ones that are neither letter nor digit.
    """
    value, _ = _tables(alphanumeric)
    at = word_starts(data, offsets, alphanumeric)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at, np.zeros(len(offsets), dtype=np.int64)
    up, down = _powers(len(data))
    hashed = mix(np.add.reduceat(value[data] * up[: len(data)], at) * down[at])
    return hashed, at, np.searchsorted(at, offsets)


_PLACE = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def shingles(hashed: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in order, first shingle of each text and the end)."""
    per_text = np.diff(first)
    count = np.where(per_text >= width, per_text - width + 1, (per_text > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    if len(hashed) >= width:
        rolled = hashed[: len(hashed) - width + 1] * _PLACE[0]
        for j in range(1, width):
            rolled = rolled + hashed[j : len(hashed) - width + 1 + j] * _PLACE[j % len(_PLACE)]
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, dtype=np.uint64)
    out = np.empty(int(ends[-1]), dtype=np.uint64)
    long = per_text >= width
    if long.any():
        # positions of the windows that stay inside one text
        take = np.ones(len(rolled), dtype=bool)
        for j in range(1, width):
            cut = first[1:-1] - j
            take[cut[(cut >= 0) & (cut < len(rolled))]] = False
        # windows of short texts cross into the next one and are cut as well
        owner_long = np.repeat(long, count)
        out[owner_long] = rolled[take]
    for i in np.flatnonzero((per_text > 0) & ~long):
        acc = U(0x2545F4914F6CDD1D) * U(per_text[i])
        with np.errstate(over="ignore"):
            for j, h in enumerate(hashed[first[i] : first[i + 1]]):
                acc = acc + h * _PLACE[(j + 3) % len(_PLACE)]
        out[ends[i]] = mix(np.array([acc]))[0]
    return out, ends


def text_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles, offsets) for runs of texts."""
    for a, b, data, offsets in text_chunks(texts):
        hashed, _, first = words(data, offsets)
        values, ends = shingles(hashed, first, width)
        sets = [np.unique(values[ends[i] : ends[i + 1]]) for i in range(b - a)]
        yield a, b, (np.concatenate(sets) if sets else values), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
