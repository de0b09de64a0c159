"""Preprocessing of a folder of FASTQ files as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions.kmers import packed_sets
from helixspark.operators import preprocess
from helixspark.sources import fastq, results


def fasta_kmers(spark: SparkSession, path: str, k: int = 21) -> DataFrame:
    """Distinct packed k-mers of a FASTA file's sequences; k-mers across its line breaks count."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^>")).alias("record"))
    seq = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n", ""), r"\s", "")
    return packed_sets(records.where("record <> ''").select(F.lit(0).alias("one"), seq.alias("seq")), k, ["one"]).select("kmer").distinct()


def run(spark: SparkSession, folder: str, out: str, min_length: int = 50, quick: bool = False, host: str | None = None, k: int = 21) -> tuple[DataFrame, DataFrame]:
    """Clean all samples, remove host reads if a host FASTA is given, and write FASTQ, manifest and summary.

    Mates of a sample end in one output.  ``quick`` trims only.  Returns (summary per sample, manifest); samples with
    nothing left are marked ``failed`` and do not stop the others.
    """
    files = fastq.list_files(spark, folder)
    reads = fastq.read_samples(fastq.find_samples(files))
    clean = preprocess.clean_reads(reads, min_length, quick)
    if host and not quick:
        clean = preprocess.remove_host(clean, fasta_kmers(spark, host, k), k)
    results.write_fastq(clean, f"{out}/reads")
    kept = spark.read.text(f"{out}/reads").where("sample is not null")
    summary = preprocess.preprocessing_summary(reads, clean)
    names = kept.select("sample").distinct().select("sample", F.concat(F.lit(f"{out}/reads/sample="), "sample").alias("r1"), F.lit(None).cast("string").alias("r2"))
    made = fastq.manifest(names)
    results.write_manifest(made, f"{out}/sample_list")
    results.one_csv(summary, f"{out}/preprocessing_summary")
    return summary, made
