"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one row by stable id.

1. Rows are counted by hash alone.  A text whose hash no other row has is its own group; such rows, most of a corpus, are
   never moved.
2. The texts of all other rows are grouped by (hash, text): Spark deals rows out by the pair and compares whole keys byte
   for byte, so texts whose hashes collide end in different groups.  Partial aggregation removes copies before the
   shuffle, so a text that fills a third of the table crosses the network once per task.
3. The groups, by hash and digest, are joined to their members' slim rows; the members of large groups are dealt over many
   tasks.

Defined cases: a null text counts as empty; a null id is never chosen while another id exists, and a group with null
ids only has a null ``keep_id``; rows that repeat id and text are all marked alike by :func:`exact_groups`, while
:func:`drop_exact_copies` returns one of them; extra columns, however they are called, do not matter to the first and are
kept by the second; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep as kept_table
from helixspark.plans.skew import spread_join
from .sieve import bitmap, part, sift
from .tables import slim


def md5_128(text: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _named_groups(rows: DataFrame, pick: Callable) -> DataFrame:
    """``h, sha, keep_id, group_size`` of the groups of equal texts among ``id, h, text``."""
    groups = rows.groupBy("h", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    # from here on a group is known by hash and digest; that this names one text only is checked, not assumed
    named = (
        groups.select("h", sha256(F.col("text")).alias("sha"), "keep_id", "group_size")
        .groupBy("h", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("n_texts"))
    )
    sure = F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts share both digests"))).otherwise(F.col("group_size"))
    return kept_table(named.select("h", "sha", "keep_id", sure.cast("long").alias("group_size")), "exact-groups")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    ``keep`` is ``"min"`` or ``"max"``: which id of equal texts stays.  ``content_hash`` may be any function of the
    text; a weak one only costs time.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = slim(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", content_hash(F.col("text")))
    members = kept_table(rows.select("id", "h", sha256(F.col("text")).alias("sha")), "exact-members")
    several = kept_table(members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact-several")
    found = bitmap(several, "h")
    named = _named_groups(sift(rows, found, "h"), pick)
    maybe, alone = part(members, found, "h")
    joined = spread_join(maybe, named, ["h", "sha"], F.col("id"))
    whole = joined.select("id", "keep_id", "group_size", "sha").unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return whole.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The table without copies: of equal texts the row with the smallest (``"max"``: largest) id, all its columns.

    Only rows whose text occurs again are moved.  Where rows repeat the id as well, the one whose other columns compare
    largest stays.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    columns = docs.columns
    own = [f"c{i}" for i in range(len(columns))]
    src = docs.toDF(*own).withColumn("id", F.col(own[columns.index(id_col)])).withColumn("body", F.coalesce(own[columns.index(text_col)], F.lit("")))
    src = src.withColumn("h", md5_128(F.col("body")))
    several = kept_table(src.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact-several")
    maybe, alone = part(src, bitmap(several, "h"), "h")
    named = _named_groups(maybe.select("id", "h", F.col("body").alias("text")), pick)
    # a null id is a key like any other here
    key = lambda df, i: df.withColumn("no_id", F.col(i).isNull()).withColumn("some_id", F.coalesce(F.xxhash64(i), F.lit(0)))
    winners = key(named.select("h", "sha", F.col("keep_id").alias("winner")), "winner")
    chosen = sift(key(maybe.withColumn("sha", sha256(F.col("body"))), "id"), bitmap(winners, "h", "sha", "no_id", "some_id"), "h", "sha", "no_id", "some_id")
    one = chosen.groupBy("h", "sha", "no_id", "some_id").agg(F.max(F.struct("id", *own)).alias("best"))
    best = one.join(winners, ["h", "sha", "no_id", "some_id"]).where(F.col("best.id").eqNullSafe(F.col("winner")))
    return alone.select(*own).unionByName(best.select(*[F.col(f"best.{c}") for c in own])).toDF(*columns)
