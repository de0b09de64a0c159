"""K-mer profiles: counts per sample, normalised and filtered.

A profile is long: ``sample, kmer, cnt, total`` with ``total`` the sample's sum of counts after the frequency filter, so
that a k-mer's relative frequency is ``cnt / total``.  K-mers are packed longs for k <= 31, else strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions.kmers import MAX_PACKED, explode_kmers, packed_counts, unpack


def cap_reads(reads: DataFrame, max_reads: int | None, scope: str = "sample") -> DataFrame:
    """The first ``max_reads`` reads of each sample (``scope="file"``: of each file), by file and read number.

    Spark prunes each task to ``max_reads`` rows a sample before the shuffle (window group limit).
    """
    if max_reads is None:
        return reads
    keys = {"sample": ["sample"], "file": ["sample", "file"]}[scope]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("file", "read_no"))
    return reads.withColumn("__rank", rank).where(F.col("__rank") <= max_reads).drop("__rank")


def kmer_counts(reads: DataFrame, k: int = 21, packed: bool = True) -> DataFrame:
    """``sample, kmer, cnt`` over the reads ``sample, seq``.  Packed counting falls back to strings for k = 32."""
    if packed and k <= MAX_PACKED:
        # each task has summed its batches already; the shuffle moves distinct (sample, k-mer) rows
        return packed_counts(reads, k).groupBy("sample", "kmer").agg(F.sum("cnt").alias("cnt"))
    return explode_kmers(reads.select("sample", "seq"), k).groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))


def with_strings(df: DataFrame, k: int) -> DataFrame:
    """Packed k-mers as strings; strings stay."""
    return df.withColumn("kmer", unpack(F.col("kmer"), k)) if dict(df.dtypes)["kmer"] == "bigint" else df


def profile(counts: DataFrame, min_freq: int = 1) -> DataFrame:
    """Counts of at least ``min_freq`` with their sample's total: the survivors sum to 1 again."""
    kept = counts.where(F.col("cnt") >= min_freq) if min_freq > 1 else counts
    totals = kept.groupBy("sample").agg(F.sum("cnt").alias("total"))
    return kept.join(totals, "sample").select("sample", "kmer", "cnt", "total")


def frequencies(prof: DataFrame) -> DataFrame:
    """``sample, kmer, freq``; a sample's frequencies sum to 1."""
    return prof.select("sample", "kmer", (F.col("cnt") / F.col("total")).alias("freq"))


def as_maps(prof: DataFrame) -> DataFrame:
    """``sample, profile map<kmer, freq>``, for exchange of small profiles only."""
    return frequencies(prof).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "freq"))).alias("profile"))


def sample_totals(prof: DataFrame) -> DataFrame:
    """``sample, total, n_kmers``."""
    return prof.groupBy("sample").agg(F.max("total").alias("total"), F.count("*").alias("n_kmers"))


def document_frequency(prof: DataFrame) -> DataFrame:
    """``kmer, n_samples``: in how many samples each k-mer occurs."""
    return prof.groupBy("kmer").agg(F.count("*").alias("n_samples"))


def vocabulary(prof: DataFrame) -> DataFrame:
    return prof.select("kmer").distinct()


def common_only(prof: DataFrame, n_samples: int | None = None, share: float = 0.1, only_above: int = 50) -> DataFrame:
    """Only k-mers that occur in at least max(2, int(share * n)) samples, where there are more than ``only_above``
    samples; the whole profile if none does.  Totals stay, so frequencies no longer sum to 1."""
    n = prof.select("sample").distinct().count() if n_samples is None else n_samples
    if n <= only_above:
        return prof
    common = document_frequency(prof).where(F.col("n_samples") >= max(2, int(share * n))).select("kmer")
    return prof if common.isEmpty() else prof.join(common, "kmer", "left_semi")
