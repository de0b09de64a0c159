"""MinHash signatures and LSH over k-mer sets, packed or strings: an approximate similarity join.

The i-th hash of a k-mer x is ``(a_i * (x mod P) + b_i) mod P`` with P = 2**31 - 1 and coefficients from a linear
congruential sequence, so signatures are the same in any engine with 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep

P = 2**31 - 1


def coefficients(n: int) -> list[tuple[int, int]]:
    """(a_i, b_i) with 0 < a_i < P and 0 <= b_i < P."""
    x, out = 12345, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % P
            pair.append(x)
        out.append((max(1, pair[0]), pair[1]))
    return out


def signatures(prof: DataFrame, n_perm: int = 128) -> DataFrame:
    """``sample, signature array<long>``: minima of whole batches in numpy, of which a task sends one row a sample and hash."""
    number = F.col("kmer") if dict(prof.dtypes)["kmer"] == "bigint" else F.xxhash64("kmer")
    a, b = (np.array(c, dtype=np.uint64) for c in zip(*coefficients(n_perm), strict=True))
    p = np.uint64(P)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = batch.column("sample").dictionary_encode()
            owner = samples.indices.to_numpy()
            order = np.argsort(owner, kind="stable")
            x = batch.column("x").to_numpy().astype(np.uint64)[order]
            start = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(x) else np.empty(0, dtype=np.int64)
            lows = [np.minimum.reduceat((x * a[i] + b[i]) % p, start).astype(np.int64) if len(x) else np.empty(0, dtype=np.int64) for i in range(n_perm)]
            names = samples.dictionary.take(pa.array(np.tile(owner[order][start], n_perm)))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.repeat(np.arange(n_perm, dtype=np.int32), len(start))), pa.array(np.concatenate(lows))], ["sample", "i", "h"])

    rows = prof.where("sample is not null and kmer is not null").select("sample", F.pmod(number, F.lit(P)).alias("x"))
    lows = rows.mapInArrow(run, "sample string, i int, h long").groupBy("sample", "i").agg(F.min("h").alias("h"))
    grouped = lows.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
    return grouped.select("sample", F.col("x.h").alias("signature"))


def band_layout(threshold: float, n_perm: int) -> tuple[int, int]:
    """(bands, rows) with bands * rows <= n_perm that balance false positives and negatives around the threshold."""
    steps = [i / 200 for i in range(201)]
    best = (float("inf"), 1, 1)
    for rows in range(1, n_perm + 1):
        for bands in range(1, n_perm // rows + 1):
            hit = [1 - (1 - s**rows) ** bands for s in steps]
            wrong = sum(h for s, h in zip(steps, hit, strict=True) if s < threshold) + sum(1 - h for s, h in zip(steps, hit, strict=True) if s >= threshold)
            best = min(best, (wrong, bands, rows))
    return best[1], best[2]


def candidates(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """Distinct ``sample_a, sample_b`` (a < b) that agree in all rows of a band."""
    own = F.col("signature")
    cells = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat_ws(",", i.cast("string"), F.slice(own, i * rows + 1, F.lit(rows)).cast("array<string>")))
    each = signed.select("sample", F.explode(cells).alias("band"))
    pairs = each.select(F.col("sample").alias("sample_a"), "band").join(each.select(F.col("sample").alias("sample_b"), "band"), "band").where("sample_a < sample_b")
    return pairs.select("sample_a", "sample_b").distinct()


def lsh_similarities(prof: DataFrame, threshold: float = 0.1, n_perm: int = 128, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """``sample_a, sample_b, similarity``: candidate pairs whose estimated Jaccard similarity is above the threshold."""
    if bands is None or rows is None:
        bands, rows = band_layout(threshold, n_perm)
    signed = keep(signatures(prof, n_perm), "signatures")
    side = lambda s: signed.select(F.col("sample").alias(f"sample_{s}"), F.col("signature").alias(f"sig_{s}"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    joined = candidates(signed, bands, rows).join(side("a"), "sample_a").join(side("b"), "sample_b")
    return joined.select("sample_a", "sample_b", (agree / n_perm).alias("similarity")).where(F.col("similarity") > threshold)


def choose_method(n_samples: int, max_comparisons: int = 1_000_000, force_lsh: bool = False) -> str:
    """Advice, ``exact`` or ``lsh``, by the number of sample pairs; nothing switches by itself."""
    return "lsh" if force_lsh or n_samples * (n_samples - 1) // 2 > max_comparisons or n_samples > 500 else "exact"
