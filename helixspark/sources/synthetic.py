"""Synthetic reads and metadata for trials: reproducible by hash, generated by Spark without driver loops over data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(seed: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed), F.lit(n))


def reads(spark: SparkSession, n_samples: int = 24, reads_per_sample: int = 1000, read_length: int = 150, n_groups: int = 3, genome_length: int = 3000) -> DataFrame:
    """``sample, file, read_no, header, seq, qual``: windows of one genome per group of samples, one base in fifty changed."""
    each = spark.range(n_samples * reads_per_sample).select(
        F.format_string("sample_%03d", (F.col("id") % n_samples + 1).cast("int")).alias("sample"), F.floor(F.col("id") / n_samples).alias("read_no"), (F.col("id") % n_samples % n_groups).alias("grp"), "id"
    )
    start = _pick(F.concat_ws("s", "id"), max(1, genome_length - read_length))
    changed = lambda i: _pick(F.concat_ws("c", "id", i), 50) == 0
    letter = lambda i: F.substr(F.lit("ACGT"), (F.when(changed(i), _pick(F.concat_ws("m", "id", i), 4)).otherwise(_pick(F.concat_ws("g", "grp", F.col("start") + i), 4)) + 1).cast("int"), F.lit(1))
    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(read_length - 1)), letter), "")
    made = each.withColumn("start", start).withColumn("seq", seq)
    return made.select("sample", F.concat("sample", F.lit(".fastq")).alias("file"), "read_no", F.concat(F.lit("@read_"), F.col("read_no")).alias("header"), "seq", F.repeat(F.lit("I"), read_length).alias("qual"))


def metadata(spark: SparkSession, n_samples: int = 24, n_groups: int = 3) -> DataFrame:
    """Ten attributes a sample: group-bound, random and all-distinct ones, strings and numbers."""
    i = F.col("id")
    choose = lambda name, *values: F.element_at(F.array(*map(F.lit, values)), (_pick(F.concat_ws(name, "id"), len(values)) + 1).cast("int"))
    return spark.range(n_samples).select(
        F.format_string("sample_%03d", (i + 1).cast("int")).alias("sample"), F.format_string("P%02d", (i % (n_samples // 3 or 1)).cast("int")).alias("patient_id"),
        F.element_at(F.array(*[F.lit(f"T{t}") for t in range(n_groups)]), (i % n_groups + 1).cast("int")).alias("timepoint"), choose("t", "drug", "placebo").alias("treatment"),
        choose("l", "north", "south", "east").alias("location"), (_pick(F.concat_ws("a", "id"), 50) + 20).cast("int").alias("age"), choose("g", "F", "M").alias("gender"),
        F.round(18 + _pick(F.concat_ws("b", "id"), 1700) / 100, 2).alias("bmi"), _pick(F.concat_ws("v", "id"), 1_000_000).cast("int").alias("viral_load"), F.date_add(F.lit("2023-01-01").cast("date"), (i % 90).cast("int")).cast("string").alias("collection_date"),
    )
