"""Adapters of paired reads: found where mates overlap, and as the sequence that follows.

Where a fragment is shorter than its reads, both mates run into the adapters behind it.  Then the first ``insert`` letters
of one mate are the reverse complement of those of the other.  That needs no list of adapters; the letters behind the
inserts of all pairs give the adapter sequences, by which single reads are trimmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_COMPLEMENT = np.zeros(256, dtype=np.uint8)
_COMPLEMENT[[ord(c) for c in "ACGTN"]] = [ord(c) for c in "TGCAN"]
_BLANK = 1  # beyond the end of a read; equals no letter and no complement


def mates(reads: DataFrame) -> DataFrame:
    """``sample, read_no, seq1, qual1, seq2, qual2`` of the reads of which both mates are there."""
    side = lambda m: reads.where(F.col("mate") == m).select("sample", "read_no", F.col("seq").alias(f"seq{m}"), F.col("qual").alias(f"qual{m}"))
    return side("1").join(side("2"), ["sample", "read_no"])


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of bytes, filled up with blanks; lengths); a null is empty."""
    texts = [(x.as_py() or "").encode() for x in column]
    n = np.array([len(x) for x in texts], dtype=np.int64)
    width = int(n.max(initial=0))
    return np.frombuffer(b"".join(x.ljust(width, bytes([_BLANK])) for x in texts), dtype=np.uint8).reshape(len(texts), width), n


def insert_lengths(one: np.ndarray, n1: np.ndarray, two: np.ndarray, n2: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Insert length of each pair of mates, 0 where they do not overlap in ``least`` letters with ``percent`` mismatches at most.

    Of several lengths the one with the smallest share of mismatches counts, of equal ones the longest.
    """
    other = _COMPLEMENT[two]
    best, found = np.full(len(one), np.inf), np.zeros(len(one), dtype=np.int64)
    shorter = np.minimum(n1, n2)
    for length in range(max(1, least), int(shorter.max(initial=0)) + 1):
        rows = np.flatnonzero(shorter >= length)
        wrong = (one[rows, :length] != other[rows, length - 1 :: -1][:, :length]).sum(1)
        share = wrong / length
        better = (wrong * 100 <= percent * length) & (share <= best[rows])
        best[rows[better]], found[rows[better]] = share[better], length
    return found


def overlaps(pairs: DataFrame, least: int = 20, percent: int = 10) -> DataFrame:
    """The table of :func:`mates` with ``insert_length``: where adapters begin in both; null where none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                (one, n1), (two, n2) = _letters(batch.column("seq1")), _letters(batch.column("seq2"))
                found = insert_lengths(one, n1, two, n2, least, percent)
                cut = (found > 0) & (found < np.maximum(n1, n2))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32), mask=~cut)], [*batch.schema.names, "insert_length"])

    return pairs.mapInArrow(run, ", ".join([*[f"`{c}` {k}" for c, k in pairs.dtypes], "insert_length int"]))


def trimmed(overlapped: DataFrame) -> DataFrame:
    """Both mates cut to the insert: the columns of :func:`mates` and ``trimmed``."""
    cut = lambda c: F.when(F.col("insert_length").isNotNull(), F.substr(F.col(c), F.lit(1), F.col("insert_length"))).otherwise(F.col(c)).alias(c)
    return overlapped.select("sample", "read_no", *[cut(c) for c in ("seq1", "qual1", "seq2", "qual2")], F.col("insert_length").isNotNull().alias("trimmed"))


def adapter_sequences(overlapped: DataFrame, seed: int = 12, longest: int = 40, support: float = 0.8) -> DataFrame:
    """``mate, adapter, n``: what most often follows the inserts, and how many tails begin with its first ``seed`` letters.

    The most frequent first letters are extended place by place while ``support`` of their tails agree.
    """
    tail = lambda m: F.substr(F.col(f"seq{m}"), F.col("insert_length") + 1, F.lit(longest))
    tails = overlapped.where("insert_length is not null").select(F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), tail(m).alias("tail")) for m in ("1", "2")])).alias("x")).select("x.*")
    seeded = tails.where(F.length("tail") >= seed).withColumn("seed", F.substring("tail", 1, seed))
    counts = seeded.groupBy("mate", "seed").agg(F.count("*").alias("n"))
    top = counts.groupBy("mate").agg(F.max_by(F.struct("seed", "n"), F.struct(F.col("n"), F.col("seed"))).alias("x")).select("mate", "x.seed", "x.n")
    letters = seeded.join(top, ["mate", "seed"]).select("mate", "n", F.posexplode(F.split("tail", "")).alias("at", "letter"))
    votes = letters.groupBy("mate", "n", "at", "letter").agg(F.count("*").alias("votes"))
    place = votes.groupBy("mate", "n", "at").agg(F.max_by("letter", F.struct("votes", "letter")).alias("letter"), F.max("votes").alias("votes"), F.sum("votes").alias("all"))
    sound = (F.col("votes") >= support * F.col("all")) & (F.col("all") * 2 >= F.col("n"))
    upto = F.min(sound.cast("int")).over(Window.partitionBy("mate").orderBy("at"))
    kept = place.withColumn("sound", upto).where("sound = 1")
    return kept.groupBy("mate", "n").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "letter"))).getField("letter"), "").alias("adapter")).select("mate", "adapter", "n")


def trim_adapter(reads: DataFrame, adapter: str, least: int = 8, percent: int = 10) -> DataFrame:
    """Reads ``seq, qual`` cut where the adapter begins: at the first place from which all letters, ``least`` at least, match its
    beginning with ``percent`` mismatches at most."""
    probe = np.frombuffer(adapter.encode(), dtype=np.uint8)
    names = reads.columns
    seq_at, qual_at = names.index("seq"), names.index("qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 2000):
                batch = whole.slice(begin, 2000)
                seq, n = _letters(batch.column(seq_at))
                cut = n.copy()
                for at in range(seq.shape[1] - least, -1, -1):
                    own = np.minimum(n - at, len(probe))
                    rows = np.flatnonzero(own >= least)
                    width = min(len(probe), seq.shape[1] - at)
                    inside = np.arange(width) < own[rows][:, None]
                    wrong = ((seq[rows, at : at + width] != probe[:width]) & inside).sum(1)
                    hit = rows[wrong * 100 <= percent * own[rows]]
                    cut[hit] = at
                cols = list(batch.columns)
                for i in (seq_at, qual_at):
                    cols[i] = pa.array([None if t is None else t[:c] for t, c in zip(cols[i].to_pylist(), cut.tolist(), strict=True)], cols[i].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return reads.mapInArrow(run, reads.schema)
