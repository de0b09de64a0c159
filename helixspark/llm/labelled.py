"""Held-out split, bounded training samples and logistic helpers for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out.  A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``id, text, y``: at most ``limit`` labelled documents outside the held-out fifth, distinct texts only.

    The documents are those of smallest hashed id, so a larger limit only adds to them.  Several labels of one id
    are averaged.  The sample is bounded, so its ids may be broadcast.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").alias("lid")).agg(F.avg(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("lid"), "lid").limit(limit)
    )
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("lid"))
    return rows.groupBy("text").agg(F.min("id").alias("id"), F.avg("y").alias("y"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a constant as the last column; Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * len(x))
    keep[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + keep * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w
