"""Sample metadata: reading and joining to the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff_separator(spark: SparkSession, path: str, by: str = "content") -> str:
    """Tab or comma: by a tab in the first line, or by the file's ending (``by="extension"``)."""
    if by == "extension":
        return "\t" if path.endswith((".tsv", ".txt")) else ","
    first = spark.read.text(path).limit(1).collect()
    return "\t" if first and "\t" in first[0]["value"] else ","


def read_metadata(spark: SparkSession, path: str, id_col: str = "sample_id", by: str = "content") -> DataFrame:
    """The table with inferred types and its id column as ``sample``; ``ValueError`` without that column."""
    table = spark.read.csv(path, header=True, inferSchema=True, sep=sniff_separator(spark, path, by))
    if id_col not in table.columns:
        raise ValueError(f"no column {id_col} among {table.columns}")
    return table.withColumn(id_col, F.col(id_col).cast("string")).withColumnRenamed(id_col, "sample")


def align(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """All samples with their metadata, null where there is none; other metadata rows are left out."""
    return samples.select("sample").join(meta, "sample", "left")


def coverage(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """``sample, status``: ``common``, ``missing`` (no metadata) or ``extra`` (no such sample)."""
    a, b = samples.select("sample", F.lit(1).alias("a")), meta.select("sample", F.lit(1).alias("b")).distinct()
    return a.join(b, "sample", "full").select("sample", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("common").alias("status"))


def empty_rows(meta: DataFrame) -> DataFrame:
    """Samples without a single value."""
    values = [F.col(f"`{c}`").isNull() for c in meta.columns if c != "sample"]
    every = values[0] if values else F.lit(True)
    for v in values[1:]:
        every = every & v
    return meta.where(every).select("sample")


def guess_id_column(meta: DataFrame, samples: DataFrame) -> str | None:
    """The column that names most samples; of equals the first."""
    counts = {c: meta.join(samples, meta[f"`{c}`"].cast("string") == samples["sample"], "left_semi").count() for c in meta.columns}
    best = max(counts, key=lambda c: counts[c], default=None)
    return best if best is not None and counts[best] > 0 else None
