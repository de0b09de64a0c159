"""Packing: optimal length buckets and token-budget batches.

A dynamic program over the global length histogram chooses the bucket boundaries that minimise padding.  Texts longer
than ``max_len`` are cut into pieces of ``max_len`` tokens and a remainder, so the histogram has at most ``max_len``
rows whatever the corpus holds; it is the only thing that reaches the driver.  Inside each bucket pieces are numbered
without one task seeing a whole bucket: by salted share first, then by the shares' offsets.

Defined cases: null and empty texts have no tokens and give one row with null bucket and batch; repeated rows each
take a place; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep
from .tables import slim

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class PackingPlan:
    boundaries: tuple[int, ...]
    padding: int
    pieces: int


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def best_boundaries(histogram: dict[int, int], n_buckets: int) -> PackingPlan:
    """Upper lengths of at most ``n_buckets`` buckets with the least total padding (the fewest buckets on ties).

    ``cost(i, j)`` pads lengths i..j to length j; ``best[b][j] = min over i of best[b-1][i-1] + cost(i, j)``.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return PackingPlan((), 0, 0)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    n_upto = np.concatenate([[0], np.cumsum(counts)])
    tokens_upto = np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    huge = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, huge)
    best[0] = 0
    came, totals = [], []
    for _ in range(min(n_buckets, n)):
        nxt, back = np.full(n + 1, huge), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (n_upto[j] - n_upto[:j]) - (tokens_upto[j] - tokens_upto[:j])
            back[j] = int(cost.argmin())
            nxt[j] = cost[back[j]]
        best = nxt
        came.append(back)
        totals.append(int(best[n]))
    used = int(np.argmin(totals)) + 1
    bounds, j = [], n
    for back in reversed(came[:used]):
        bounds.append(int(lengths[j - 1]))
        j = int(back[j])
    return PackingPlan(tuple(reversed(bounds)), totals[used - 1], int(n_upto[-1]))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, length: Column | None = None) -> DataFrame:
    """``id, piece, start_token, n_tokens``: each text in pieces of at most ``max_len`` tokens."""
    rows = slim(docs, id=id_col, text=text_col)
    n = word_count(F.coalesce("text", F.lit(""))) if length is None else length
    counted = keep(rows.select("id", n.cast("long").alias("n")), "lengths")  # texts are read once, by this
    cut = counted.select("id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return cut.select("id", "piece", start.alias("start_token"), F.least(F.lit(max_len).cast("long"), F.col("n") - start).alias("n_tokens"))


def plan_buckets(cut: DataFrame, n_buckets: int = 16) -> tuple[PackingPlan, dict[int, int]]:
    """The plan and the histogram it was made from; at most ``max_len`` rows are collected."""
    histogram = {r["n_tokens"]: r["n"] for r in cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    return best_boundaries(histogram, n_buckets), histogram


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 2048,
    n_buckets: int = 16,
    token_budget: int = 65536,
    length: Column | None = None,
    share_rows: int = 50_000,
) -> DataFrame:
    """One row per piece: ``id, piece, start_token, n_tokens, bucket, bucket_len, batch, slot``.

    A batch of a bucket holds ``token_budget // bucket_len`` pieces padded to ``bucket_len`` (one at least); only a
    bucket's last batch may hold fewer.  ``share_rows`` is about how many rows one task numbers.
    """
    cut = pieces(docs, id_col, text_col, max_len, length)
    plan, histogram = plan_buckets(cut, n_buckets)
    bucket, bucket_len = F.lit(None).cast("int"), F.lit(None).cast("long")
    for b, top in reversed(list(enumerate(plan.boundaries))):
        fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= top)
        bucket = F.when(fits, F.lit(b)).otherwise(bucket)
        bucket_len = F.when(fits, F.lit(top).cast("long")).otherwise(bucket_len)
    shares = max(1, -(-sum(histogram.values()) // share_rows))
    dealt = cut.select("*", bucket.alias("bucket"), bucket_len.alias("bucket_len"), F.pmod(F.xxhash64("id", "piece"), F.lit(shares)).alias("share"))
    sizes = dealt.groupBy("bucket", "share").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("bucket").alias("of_bucket"), F.col("share").alias("of_share"), before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket", "share").orderBy("id", "piece"))
    ranked = dealt.withColumn("inside", inside).join(
        offsets, F.col("bucket").eqNullSafe(F.col("of_bucket")) & (F.col("share") == F.col("of_share"))
    )
    place = F.col("offset") + F.col("inside") - 1
    held = F.greatest(F.floor(F.lit(token_budget) / F.col("bucket_len")), F.lit(1))
    batch = F.when(F.col("bucket").isNotNull(), F.floor(place / held))
    slot = F.when(F.col("bucket").isNotNull(), place % held)
    return ranked.select("id", "piece", "start_token", "n_tokens", "bucket", "bucket_len", batch.cast("long").alias("batch"), slot.cast("long").alias("slot"))
