"""Reading of the input tables, and guards against clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; other columns, however they are called, cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes for no column of ``df`` to have it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
