"""Read preprocessing with DataFrame filters: trimming, quality and length filters, duplicates, host removal.

The reference tools' own algorithms (adapter detection, alignment) are not rebuilt; poly-G trimming and host removal by
k-mer containment are approximations and are labelled so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions.kmers import MAX_PACKED, kmers_of, pack, packed_sets
from helixspark.functions.scalars import evaluated


def trim_poly_g(reads: DataFrame, least: int = 10) -> DataFrame:
    """Cut a run of at least ``least`` G from the end of reads, and as much quality."""
    kept = F.length(F.regexp_replace("seq", f"G{{{least},}}$", ""))
    out = evaluated(reads, __n=kept).withColumn("seq", F.expr("substring(seq, 1, __n)"))
    return (out.withColumn("qual", F.expr("substring(qual, 1, __n)")) if "qual" in reads.columns else out).drop("__n")


def quality_filter(reads: DataFrame, min_length: int = 50, min_phred: int = 20, max_low_percent: float = 30.0, max_n: int = 5) -> DataFrame:
    """Reads of enough length, with few bases under ``min_phred`` and few N."""
    low = "".join(chr(33 + q) for q in range(min_phred))
    n_low = F.length("qual") - F.length(F.translate("qual", low, ""))
    n_n = F.length("seq") - F.length(F.translate("seq", "Nn", ""))
    return reads.where((F.length("seq") >= min_length) & (n_low * 100 <= F.length("qual") * max_low_percent) & (n_n <= max_n))


def drop_duplicate_reads(reads: DataFrame) -> DataFrame:
    """Of equal sequences of a sample the first, by file and read number.

    Rows are dealt and sorted by a hash before the letters, so whole reads are compared only where hashes agree.
    """
    hashed = reads.withColumn("__hash", F.xxhash64("sample", "seq"))
    rank = F.row_number().over(Window.partitionBy("__hash", "sample", "seq").orderBy("file", "read_no"))
    return hashed.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__hash")


def clean_reads(reads: DataFrame, min_length: int = 50, quick: bool = False, dedup: bool = True) -> DataFrame:
    """Trim, filter and deduplicate; ``quick`` trims only."""
    trimmed = trim_poly_g(reads)
    if quick:
        return trimmed
    kept = quality_filter(trimmed, min_length)
    return drop_duplicate_reads(kept) if dedup else kept


def host_fraction(reads: DataFrame, host_kmers: DataFrame, k: int = 21) -> DataFrame:
    """``sample, file, read_no, host_share``: the share of each read's distinct k-mers found among ``host_kmers (kmer)``.

    Host k-mers are strings or packed longs; up to k = 31 the comparison is of longs.  Both sides are counted, so only
    k-mers that are the host's are carried through the join.
    """
    keys = ["sample", "file", "read_no"]
    if k <= MAX_PACKED:
        each = packed_sets(reads, k, keys)
        host = host_kmers if dict(host_kmers.dtypes)["kmer"] == "bigint" else host_kmers.select(pack(F.col("kmer"), k).alias("kmer"))
    else:
        each, host = reads.select(*keys, F.explode(F.array_distinct(kmers_of(F.col("seq"), k))).alias("kmer")), host_kmers
    all_of = each.groupBy(*keys).agg(F.count("*").alias("n"))
    shared = each.join(host.select("kmer").distinct(), "kmer", "left_semi").groupBy(*keys).agg(F.count("*").alias("n_host"))
    on = [all_of[c].eqNullSafe(shared[c]) for c in keys]
    joined = all_of.join(shared, on[0] & on[1] & on[2], "left")
    return joined.select(*[all_of[c] for c in keys], (F.coalesce("n_host", F.lit(0)) / F.col("n")).alias("host_share"))


def remove_host(reads: DataFrame, host_kmers: DataFrame, k: int = 21, max_share: float = 0.5) -> DataFrame:
    """Reads of which at most ``max_share`` of the k-mers are the host's; an approximation of alignment."""
    host = host_fraction(reads, host_kmers, k).where(F.col("host_share") > max_share)
    return reads.join(host, ["sample", "file", "read_no"], "left_anti")


def preprocessing_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reads and bases of each sample before and after, and the share kept; samples with nothing left are ``failed``."""
    count = lambda df, s: df.groupBy("sample").agg(F.count("*").alias(f"reads_{s}"), F.sum(F.length("seq")).alias(f"bases_{s}"))
    both = count(before, "before").join(count(after, "after"), "sample", "left").na.fill(0)
    return both.withColumn("kept_share", F.col("reads_after") / F.col("reads_before")).withColumn("failed", F.col("reads_after") == 0)
