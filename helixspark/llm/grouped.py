"""Groups streamed from sorted partitions, and spanning forests of the links inside a group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_blocks(df: DataFrame, key: str, member: str, size: Column) -> DataFrame:
    """Deal the rows of each ``key`` so that any two of them meet in a group of bounded size.

    The rows of a key are hashed into ``size`` blocks by ``member`` and each pair of blocks is one group, named by
    the new column ``gid``.  A row is repeated ``size`` times, so groups that fit one block are not repeated.
    """
    blocks = F.greatest(F.ceil(size), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(member)), blocks.cast("long")).cast("int")
    dealt = df.withColumn("own_block", own).withColumn("other_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    gid = F.xxhash64(F.col(key), F.least("own_block", "other_block"), F.greatest("own_block", "other_block"))
    return dealt.withColumn("gid", gid).drop("own_block", "other_block")


def sorted_groups(df: DataFrame) -> DataFrame:
    """Rows of a ``gid`` together and in one partition, for :func:`runs`."""
    return df.repartition(F.col("gid")).sortWithinPartitions("gid")


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tables of successive ``gid`` values, whatever the batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        gid = batch.column("gid").to_numpy()
        cuts = np.flatnonzero(np.diff(gid)) + 1
        if held and held[0].column("gid")[0].as_py() != gid[0]:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(batch):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix; as many as needed to keep every component."""
    n = len(linked)
    fresh = np.ones(n, dtype=bool)
    edges: list[tuple[int, int]] = []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        stack = [root]
        while stack and fresh.any():
            node = stack.pop()
            new = np.flatnonzero(linked[node] & fresh)
            fresh[new] = False
            edges += [(node, int(x)) for x in new]
            stack += new.tolist()
    return edges


def edge_batches(found: Iterator[tuple[int, int]], size: int = 20000) -> Iterator[pa.RecordBatch]:
    src, dst = [], []
    for a, b in found:
        src.append(a)
        dst.append(b)
        if len(src) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
            src, dst = [], []
    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
