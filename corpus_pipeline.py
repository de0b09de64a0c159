"""The corpus pipeline: five stages over ``documents``, each a Parquet table that the next one rereads.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its input.  Every
stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixspark.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from helixspark.llm.tables import table
from helixspark.plans import scratch

MIN_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others (by their one empty passage); rows with a null id, repeated rows and extra
    columns stay as they are.  Without labels every document has the score 0.5 and stays.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, MIN_QUALITY)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays.

    A null text counts as empty; of equal texts with null ids only, one row stays; of rows that repeat an id and a text one
    stays.
    """
    return exact_dedup.drop_exact_copies(docs, keep="min")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null and blank texts are near nothing and stay, as do rows with a null id; rows that repeat an id stay or go together.
    """
    return near_dedup.drop_near_copies(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in several documents stay in the one with the smallest id.

    Null and blank texts and rows with a null id stay as they are; rows that repeat an id are one document; a text of which
    nothing is left goes; ``n_chars`` follows a text that is cut.
    """
    return substring_dedup.drop_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of pieces by length buckets: one row per piece.

    A null, blank or empty text is one piece of no tokens, in no bucket; rows with a null or a repeated id are packed like
    others; other columns are left out.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: Learned scores and MinHash have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread.

    Once a stage is written, its input and the side tables of its operators are deleted.
    """
    docs = table(spark, sf_dir, "documents")
    tables = scratch.Run()
    for name, stage in STAGES[:-1]:
        with tables:
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.release(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
