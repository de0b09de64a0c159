"""K-mer expressions and generators.

Two encodings: strings, and packed longs with two bits a base (A=0, C=1, G=2, T=3; k <= 31, so that the order of the
longs is that of the strings).  A canonical k-mer is the smaller of itself and its reverse complement.  Reads are cut
at N; a segment with any other letter than A, C, G, T gives no k-mers; case does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PACKED = 31


def check_k(k: int, packed: bool = False) -> None:
    if not 1 <= k <= 32:
        raise ValueError(f"k must be from 1 to 32, not {k}")
    if packed and k > MAX_PACKED:
        raise ValueError(f"packed k-mers hold at most {MAX_PACKED} bases, not {k}")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a string; letters other than A, C, G, T stand for themselves."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def reverse_complement_packed(kmer: Column, k: int) -> Column:
    """Reverse complement of a packed k-mer: each base b becomes 3 - b, in reverse order."""
    out = F.lit(0).cast("long")
    for i in range(k):
        out = out.bitwiseOR(F.shiftleft(F.lit(3) - F.shiftright(kmer, 2 * i).bitwiseAND(F.lit(3)), 2 * (k - 1 - i)))
    return out


def pack(kmer: Column, k: int) -> Column:
    """A string of k bases as a long; null for a wrong length or another letter."""
    check_k(k, packed=True)
    digits = F.translate(kmer, "ACGT", "0123")
    code = F.conv(digits, 4, 10).cast("long")
    return F.when((F.length(kmer) == k) & kmer.rlike("^[ACGT]+$"), code)


def unpack(code: Column, k: int) -> Column:
    """The string of a packed k-mer."""
    check_k(k, packed=True)
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def segments(seq: Column) -> Column:
    """The segments of a read that give k-mers."""
    return F.filter(F.split(F.upper(seq), "N+"), lambda s: s.rlike("^[ACGT]+$"))


def kmers_of(seq: Column, k: int) -> Column:
    """All canonical k-mers of a read, in order, as an array of strings."""
    check_k(k)
    window = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: canonical(F.substr(s, i, F.lit(k))))
    return F.flatten(F.transform(F.filter(segments(seq), lambda s: F.length(s) >= k), window))


def explode_kmers(reads: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """One row per k-mer occurrence, as a string in ``kmer``; the other columns are repeated."""
    keep = [c for c in reads.columns if c != seq_col]
    return reads.select(*keep, F.explode(kmers_of(F.col(seq_col), k)).alias("kmer"))


def _letters() -> np.ndarray:
    code = np.full(256, 5, dtype=np.uint8)
    for i, pair in enumerate(("Aa", "Cc", "Gg", "Tt", "Nn")):
        for c in pair:
            code[ord(c)] = i
    return code


_CODE = _letters()
BLOCK_LETTERS = 1 << 20


def _spoilt(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each letter is in a segment with a strange letter; segments start with each read and behind each N."""
    n = len(code)
    edge = code == 4
    edge[1:] |= edge[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    edge[0] = True
    starts = np.flatnonzero(edge)
    return np.repeat(np.maximum.reduceat(code == 5, starts), np.diff(np.append(starts, n)))


def window_blocks(data: np.ndarray, offsets: np.ndarray, k: int, letters: int = BLOCK_LETTERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What :func:`packed_windows` gives, in blocks of at most ``letters`` letters: numbers take some hundred bytes a letter.

    A block is of whole reads, or a part of one longer read.  Parts overlap by k - 1 letters, and spoilt segments are
    made N before they are cut, so each window is in one block.
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        start = offsets[first]
        last = max(first + 1, int(np.searchsorted(offsets, start + letters, "right")) - 1)
        part = data[start : offsets[last]]
        if len(part) <= letters:
            kmer, read = packed_windows(part, offsets[first : last + 1] - start, k)
            yield kmer, read + first
        else:
            part = np.where(_spoilt(_CODE[part], np.array([0, len(part)])), np.uint8(ord("N")), part)
            for at in range(0, len(part) - k + 1, letters):
                piece = part[at : at + letters + k - 1]
                kmer, read = packed_windows(piece, np.array([0, len(piece)]), k)
                yield kmer, read + first
        first = last


def packed_windows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(canonical packed k-mer of each valid window, the read it is from), for reads given as bytes and offsets."""
    n = len(data)
    if n < k:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    code = _CODE[data]
    read = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bad = np.concatenate([[0], np.cumsum(_spoilt(code, offsets) | (code >= 4))])
    at = np.arange(n - k + 1)
    at = at[(bad[k:] == bad[: n - k + 1]) & (at + k <= offsets[1:][read[: n - k + 1]])]
    if not len(at):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    base = np.where(code < 4, code, 0).astype(np.uint64)

    def rolled(digits: np.ndarray, high_first: bool) -> np.ndarray:
        """Each window's digits as one number, by doubling the window."""
        out, have, done = None, 0, digits
        width, bit = 1, k
        while bit:
            if bit & 1:
                part = done if have == 0 else done[have:]
                if out is None:
                    out, have = done, width
                else:
                    m = len(part)
                    out = (out[:m] << np.uint64(2 * width)) | part if high_first else out[:m] | (part << np.uint64(2 * have))
                    have += width
            bit >>= 1
            if bit:
                m = len(done) - width
                done = (done[:m] << np.uint64(2 * width)) | done[width:] if high_first else done[:m] | (done[width:] << np.uint64(2 * width))
                width *= 2
        return out

    forward = rolled(base, True)[at]
    backward = rolled(np.uint64(3) - base, False)[at]
    return np.minimum(forward, backward), read[at]


def _bytes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    seqs = seqs.cast(pa.large_binary())
    if not len(seqs) or seqs.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(seqs) + 1, dtype=np.int64)
    ends = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    return np.frombuffer(seqs.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def packed_sets(reads: DataFrame, k: int, keys: list[str], seq_col: str = "seq") -> DataFrame:
    """``keys, kmer (packed long)``: the distinct k-mers of each read."""
    check_k(k, packed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, seen = -1, np.empty(0, dtype=np.uint64)
            for kmer, read in window_blocks(*_bytes(batch.column(len(keys))), k):
                if not len(kmer):
                    continue
                order = np.lexsort((kmer, read))
                kmer, read = kmer[order], read[order]
                new = np.r_[True, (kmer[1:] != kmer[:-1]) | (read[1:] != read[:-1])]
                kmer, read = kmer[new], read[new]
                if read[0] == last:  # a further part of a long read
                    fresh = ~np.isin(kmer, seen)
                    kmer, read = kmer[fresh], read[fresh]
                    seen = np.concatenate([seen, kmer])
                else:
                    last, seen = read[-1], kmer
                rows = pa.array(read)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(len(keys))], pa.array(kmer.view(np.int64))], [*keys, "kmer"])

    kinds = dict(reads.dtypes)
    return reads.select(*keys, seq_col).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "kmer long"]))


def packed_counts(reads: DataFrame, k: int, by: str = "sample", seq_col: str = "seq") -> DataFrame:
    """``by, kmer (packed long), cnt``: counts of each block of reads; groups recur and are to be summed.

    Windows are taken and counted by blocks in numpy, so that what leaves the task is one row per distinct (group, k-mer)
    of a block, and a task's memory does not grow with the batch.
    """
    check_k(k, packed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            owner = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            for kmer, read in window_blocks(*_bytes(batch.column(1)), k):
                if not len(kmer):
                    continue
                group = owner[read]
                if 2 * k + int(len(groups.dictionary) + 1).bit_length() <= 63:
                    key, cnt = np.unique(((group + 1).astype(np.uint64) << np.uint64(2 * k)) | kmer, return_counts=True)
                    group, kmer = (key >> np.uint64(2 * k)).astype(np.int64) - 1, key & np.uint64((1 << 2 * k) - 1)
                else:
                    order = np.lexsort((kmer, group))
                    group, kmer = group[order], kmer[order]
                    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kmer[1:] != kmer[:-1])])
                    cnt = np.diff(np.append(new, len(kmer)))
                    group, kmer = group[new], kmer[new]
                names = groups.dictionary.take(pa.array(np.where(group < 0, 0, group), mask=group < 0))
                yield pa.RecordBatch.from_arrays([names, pa.array(kmer.view(np.int64)), pa.array(cnt.astype(np.int64))], [by, "kmer", "cnt"])

    kind = dict(reads.dtypes)[by]
    return reads.select(by, seq_col).mapInArrow(run, f"`{by}` {kind}, kmer long, cnt long")
