"""Profiles of a stream of reads: the same k-mers, counted as reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from helixspark.functions.kmers import packed_counts


def streaming_counts(reads: DataFrame, k: int = 21) -> DataFrame:
    """Running ``sample, kmer, cnt`` of a streaming ``sample, seq``; write it in update or complete mode."""
    counted = packed_counts(reads, k)
    return counted.groupBy("sample", "kmer").sum("cnt").withColumnRenamed("sum(cnt)", "cnt")


def start(reads: DataFrame, k: int, name: str, checkpoint: str, mode: str = "complete"):
    """A query that keeps the counts in a memory table, for tests and small streams."""
    return streaming_counts(reads, k).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
