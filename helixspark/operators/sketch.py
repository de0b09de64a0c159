"""Fixed-size sketches of k-mer counts: by frequency, by reservoir, and a mixture.

Sketches take counts ``sample, kmer (string), cnt`` and return profiles ``sample, kmer, cnt, total``.  Random choices are
made by md5 order, so a sketch is the same however the data are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep, once

MARGIN = 12


def _with_total(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", F.sum("cnt").over(Window.partitionBy("sample")))


def _top(counts: DataFrame, size: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.col("cnt").desc(), "kmer"))
    return counts.select("sample", "kmer", "cnt", rank.alias("rank")).where(F.col("rank") <= size).select("sample", "kmer", "cnt")


def _reservoir(counts: DataFrame, size: int, seed: int) -> DataFrame:
    """Of each sample's occurrences the ``size`` first by md5.

    Only occurrences whose md5 begins below a bound are sorted.  The bound of a sample with n occurrences lets some more than
    ``size`` of them pass; where fewer pass, it grows, up to all, until enough do, so those drawn are the first of all.
    """
    counts = once(counts, "counts")
    totals = counts.groupBy("sample").agg(F.sum("cnt").alias("n"))
    expected = max(1.0, size + MARGIN * math.sqrt(size))
    bounds = keep(totals.select("sample", "n", (F.lit(expected) / F.col("n")).alias("share")), "bounds")
    passed = None
    while True:
        found = keep(_below(counts, bounds, seed), "drawn")
        held = found.groupBy(F.col("sample").alias("__sample")).agg(F.count("*").alias("got"))
        short = keep(bounds.join(held, F.equal_null("sample", "__sample"), "left").where((F.col("share") < 1) & (F.coalesce("got", F.lit(0)) < size)).select("sample", "n", "share"), "short")
        enough = found.join(short, F.equal_null(found["sample"], short["sample"]), "left_anti")
        passed = enough if passed is None else passed.unionByName(enough)
        if short.isEmpty():
            break
        bounds = keep(short.withColumn("share", F.col("share") * 8), "bounds")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("md5", "kmer", "i"))
    return passed.withColumn("rank", rank).where(F.col("rank") <= size).groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))


def _below(counts: DataFrame, bounds: DataFrame, seed: int) -> DataFrame:
    """``sample, kmer, i, md5`` of the occurrences whose md5 begins with a number under the sample's ``share`` of all."""
    given = bounds.select(F.col("sample").alias("__sample"), "share")
    bound = F.when(F.col("share") < 1, F.lpad(F.lower(F.hex(F.floor(F.col("share") * float(1 << 48)))), 12, "0")).otherwise("g")
    near = counts.join(given, F.equal_null("sample", "__sample")).select("sample", "kmer", "cnt", bound.alias("bound"))
    each = near.select("sample", "kmer", "bound", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt"))).alias("i"))
    text = F.md5(F.concat_ws("#", "kmer", F.col("i").cast("string"), F.lit(str(seed))).cast("binary"))
    found = each.select("sample", "kmer", "i", "bound", text.alias("md5"))
    return found.where("md5 < bound").select("sample", "kmer", "i", "md5")


def frequency_sketch(counts: DataFrame, size: int = 10000) -> DataFrame:
    """The ``size`` most frequent k-mers of each sample; ties to the smaller k-mer."""
    return _with_total(_top(counts, size))


def reservoir_sketch(counts: DataFrame, size: int = 10000, seed: int = 0) -> DataFrame:
    """Counts of ``size`` occurrences drawn from each sample without replacement."""
    return _with_total(_reservoir(counts, size, seed))


def adaptive_sketch(counts: DataFrame, size: int = 10000, seed: int = 0, top_share: float = 0.7) -> DataFrame:
    """``int(top_share * size)`` most frequent k-mers, the rest occurrences drawn from the others."""
    n_top = int(top_share * size)
    counts = once(counts, "counts")
    top = _top(counts, n_top)
    others = counts.select("sample", "kmer", "cnt").join(top.select("sample", "kmer"), ["sample", "kmer"], "left_anti")
    return _with_total(top.unionByName(_reservoir(others, size - n_top, seed)))


def sketch(counts: DataFrame, size: int = 10000, method: str = "reservoir", seed: int = 0) -> DataFrame:
    if method == "frequency":
        return frequency_sketch(counts, size)
    kinds = {"reservoir": reservoir_sketch, "adaptive": adaptive_sketch}
    if method not in kinds:
        raise ValueError(f"unknown sampling method: {method}")
    return kinds[method](counts, size, seed)


def sketch_statistics(sketched: DataFrame, size: int) -> DataFrame:
    """Per sample: k-mers held, occurrences sampled, share of the size used, mean, least and largest frequency."""
    freq = F.col("cnt") / F.col("total")
    return sketched.groupBy("sample").agg(
        F.count("*").alias("unique_kmers"), F.sum("cnt").alias("total_kmers_sampled"), (F.count("*") / size).alias("sampling_efficiency"),
        F.avg(freq).alias("average_frequency"), F.min(freq).alias("min_frequency"), F.max(freq).alias("max_frequency"),
    )


def sketch_memory(sketched: DataFrame, bytes_per_kmer: int = 29, full_kmers_per_sample: int = 100_000) -> DataFrame:
    """One row: MB of the sketches and of full profiles at an assumed size, and their ratio."""
    per_sample = sketched.groupBy("sample").agg(F.count("*").alias("n"))
    mb = F.lit(bytes_per_kmer) / F.lit(1024.0 * 1024.0)
    held, full = F.sum("n") * mb, F.count("*") * F.lit(full_kmers_per_sample) * mb
    return per_sample.agg(F.count("*").alias("n_samples"), F.sum("n").alias("total_kmers"), held.alias("sketch_mb"), full.alias("full_mb"), (full / held).alias("reduction"))
