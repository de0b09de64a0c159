"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from helixspark.plans.scratch import drop, keep



LOCAL_NODES = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of an undirected edge table; the component is its smallest node.

    Tasks first contract the edges that they hold to stars, which leaves fewer edges and shorter paths.  Each round is
    then one grouped aggregate and one equi-join per star, so the rows stay linear in the edges and no neighbourhood is
    gathered: a star needs only the minimum of each node's neighbours.  Both sides of these joins are plain shuffles, so
    that adaptive execution splits the rows of a hub over tasks.  Rounds are cut with tables in the shared folder.
    Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows.  ``RuntimeError`` if
    ``max_rounds`` do not suffice (they grow with the logarithm of the diameter).
    """
    ordered = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    cur = keep(_contracted(ordered).distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(cur):
            return cur.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                cur.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )
        nxt = keep(_small_star(_large_star(cur)), "cc")
        drop(cur)
        cur = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _contracted(e: DataFrame) -> DataFrame:
    """Stars ``u, v`` with the same components as the edges, by union-find over each task's edges, ``LOCAL_NODES`` nodes at a time."""
    kind = e.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars() -> pa.RecordBatch:
            both = [(top(x), x) for x in parent]
            u, v = zip(*[p for p in both if p[0] != p[1]], strict=True) if both else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(c, arrow) for c in (u, v)], ["u", "v"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(parent.setdefault(a, a)), top(parent.setdefault(b, b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > LOCAL_NODES:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return e.mapInArrow(run, StructType([StructField("u", kind), StructField("v", kind)]))


def _settled(e: DataFrame) -> bool:
    """Whether every edge joins a node to its component's smallest: no node has two larger or both kinds of end."""
    ends = e.select(F.col("v").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        e.select(F.col("u").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    return ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the node and its neighbours."""
    both = e.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("w")))
    low = both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("w > n").join(low, "n").where("m <> w").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(low, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(low.select(F.col("m").alias("u"), "v")).distinct()


def similar_edges(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """Edges ``src, dst`` between samples whose similarity is ``min_similarity`` or more."""
    return pairs.where(F.col("similarity") >= min_similarity).select(F.col("sample_a").alias("src"), F.col("sample_b").alias("dst"))


def sample_clusters(samples: DataFrame, pairs: DataFrame, min_similarity: float = 0.1, min_cluster_size: int = 2) -> DataFrame:
    """``component, samples, n``: groups of samples joined by chains of similar pairs, named by their first sample."""
    parts = connected_components(similar_edges(pairs, min_similarity))
    named = samples.select("sample").join(parts, F.col("sample") == F.col("node"), "left").select("sample", F.coalesce("component", "sample").alias("component"))
    grouped = named.groupBy("component").agg(F.array_sort(F.collect_list("sample")).alias("samples"), F.count("*").alias("n"))
    return grouped.where(F.col("n") >= min_cluster_size)
