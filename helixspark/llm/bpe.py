"""Byte-level BPE: encoding and decoding by a rank file.

A text is cut by the tokenizer's pattern.  Each pre-token is resolved in two tiers.  A minimal perfect hash over the
vocabulary gives the one token that a pre-token could be, and a comparison of bytes says whether it is; such a
pre-token is one id.  All others are merged from bytes: neighbours form a doubly linked list, a heap yields the pair
of lowest rank (the leftmost on ties), and a merge relinks its neighbours.  The work on a pre-token of n bytes is
O(n log n), also where one pre-token is the whole text.

Resolved pre-tokens are remembered in each Python worker up to a fixed number, after which the memory starts afresh.

Defined cases: a null text is empty and has no ids; lone surrogates cannot occur in Spark strings; ids outside the
vocabulary fail the decoding; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slim

REMEMBERED = 800_000  # pre-tokens a worker remembers
_LOW = (1 << 64) - 1


_SPREAD, _MULTIPLY = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass
class PerfectHash:
    """Hash and displace: a bucket's number ``d`` sends its keys to distinct slots, one slot for each key in all."""

    shift: np.ndarray
    key_at: np.ndarray

    @staticmethod
    def parts(key: bytes, buckets: int) -> tuple[int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        return (x >> 64) % buckets, x & _LOW

    @classmethod
    def build(cls, keys: list[bytes], load: int = 4) -> PerfectHash:
        n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("keys are not distinct")
        buckets = max(1, n // load)
        parts = [cls.parts(k, buckets) for k in keys]
        bucket_of = np.array([b for b, _ in parts], dtype=np.int64)
        low = np.array([x for _, x in parts], dtype=np.uint64)
        order = np.argsort(bucket_of, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket_of[order])) + 1) if n else []
        shift, key_at, free = np.zeros(buckets, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.ones(n, dtype=bool)
        spare: list[int] | None = None
        for group in sorted(groups, key=len, reverse=True):
            bucket = bucket_of[group[0]]
            if len(group) == 1:  # any free slot serves; it is stored as such
                if spare is None:
                    spare = np.flatnonzero(free).tolist()
                slot = spare.pop()
                shift[bucket] = -1 - slot
                key_at[slot] = group[0]
                continue
            first = 0
            while True:
                d = np.arange(first, first + 512, dtype=np.uint64)[:, None] * np.uint64(_SPREAD)
                slots = (((low[group][None, :] ^ d) * np.uint64(_MULTIPLY)) >> np.uint64(29)).astype(np.int64) % n
                ranked = np.sort(slots, axis=1)
                good = free[slots].all(1) & (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if good.any():
                    hit = int(good.argmax())
                    shift[bucket] = first + hit
                    key_at[slots[hit]] = group
                    free[slots[hit]] = False
                    break
                first += 512
        return cls(shift, key_at)

    def slot(self, key: bytes) -> int:
        bucket, low = self.parts(key, len(self.shift))
        d = int(self.shift[bucket])
        if d < 0:
            return -1 - d
        return ((((low ^ (d * _SPREAD & _LOW)) * _MULTIPLY) & _LOW) >> 29) % len(self.key_at)

    def candidate(self, key: bytes) -> int:
        """The only key number that ``key`` can have, or -1 without keys."""
        return int(self.key_at[self.slot(key)]) if len(self.key_at) else -1


@dataclass
class Vocabulary:
    """Ranked tokens, their perfect hash and the pattern; ``tokens[rank]`` is a token's bytes."""

    tokens: list[bytes]
    pattern: str
    whole: PerfectHash
    _ranks: dict[bytes, int] | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks must run from 0 without gaps")
        tokens = [t for _, t in pairs]
        return cls(tokens, pattern, PerfectHash.build(tokens))

    def __getstate__(self):
        return self.tokens, self.pattern, self.whole

    def __setstate__(self, state):
        self.tokens, self.pattern, self.whole = state
        self._ranks = None

    @property
    def ranks(self) -> dict[bytes, int]:
        if self._ranks is None:
            self._ranks = {t: i for i, t in enumerate(self.tokens)}
        return self._ranks

    def resolve(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the perfect hash first, the heap for the rest."""
        i = self.whole.candidate(piece)
        return [i] if i >= 0 and self.tokens[i] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        n = len(piece)
        rank_of = self.ranks.get
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current: list[int | None] = [None] * n
        heap: list[tuple[int, int]] = []
        for i in range(n - 1):
            if (r := rank_of(piece[i : i + 2])) is not None:
                current[i] = r
                heap.append((r, i))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if current[i] != r or part[i] is None:
                continue  # this pair has changed since
            j = after[i]
            part[i] += part[j]
            part[j], current[j] = None, None
            after[i] = k = after[j]
            current[i] = None
            if k < n:
                before[k] = i
                if (s := rank_of(part[i] + part[k])) is not None:
                    current[i] = s
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0:
                current[h] = s = rank_of(part[h] + part[i])
                if s is not None:
                    heapq.heappush(heap, (s, h))
        return [self.ranks[p] for p in part if p is not None]


class _Resolved(dict):
    """Pre-token to its ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.resolve(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


_MEMORY: dict[tuple[int, str, bytes], tuple[_Resolved, regex.Pattern]] = {}


def _resolver(vocabulary: Vocabulary) -> tuple[_Resolved, regex.Pattern]:
    """The worker's memory for this vocabulary, across batches and tasks."""
    key = (len(vocabulary.tokens), vocabulary.pattern, hashlib.blake2b(b"\0".join(vocabulary.tokens[-2000:])).digest())
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = _Resolved(vocabulary), regex.compile(vocabulary.pattern)
    return _MEMORY[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolved, pattern = _resolver(vocabulary)
        find, look = pattern.findall, resolved.__getitem__
        for batch in batches:
            texts = batch.column("text")
            packed, ends, held, first = [], [0], 0, 0

            def flush(last: int, batch=batch) -> pa.RecordBatch:
                ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                return pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["id", "ids"])

            for i, text in enumerate(texts):
                out = b"".join(map(look, find(text.as_py() or "")))
                packed.append(out)
                held += len(out) // 4
                ends.append(held)
                if held > 4_000_000:
                    yield flush(i + 1)
                    packed, ends, held, first = [], [0], 0, i + 1
            if first < len(batch):
                yield flush(len(batch))

    rows = slim(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``id, ids, decoded binary`` of a table ``id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [b"".join(map(vocabulary.tokens.__getitem__, own.tolist())) for own in _id_arrays(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and digests of its ids and of the bytes they decode to.

    The ids stay in the worker that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolved, pattern = _resolver(vocabulary)
        find, look, token = pattern.findall, resolved.__getitem__, vocabulary.tokens.__getitem__
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                packed = b"".join(map(look, find(text.as_py() or "")))
                ids = struct.unpack(f"<{len(packed) // 4}I", packed)
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(b"".join(map(token, ids))).hexdigest()))
            n, of_ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = slim(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_arrays(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
