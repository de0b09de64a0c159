"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are dealt into shards of bounded size and queries into blocks; a task holds one shard and one block.  A tree
is built by median splits with tight bounding boxes.  A box bounds the inner product of every vector in it by
``sum(max(q*lo, q*hi))``; leaves are visited best bound first and a query stops at the first bound below its current
k-th score.  That k-th score does not start empty: every query is first scored against a bounded set of seed vectors
(those of largest norm), and the k-th score reached there is handed to all shards.

Defined cases: null vectors and those with null or non-finite components, and rows with a null id, take no part;
vectors compare only with those of the same dimension; candidates of a query are all rows with another id; a repeated
row is a candidate as often as it occurs, but a repeated query is asked once, with the vector that compares smallest
where its rows differ; fewer candidates than k give fewer rows; an empty table an empty result.  Components whose
products could exceed 2**62 raise ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "query_id long, vec_id long, score long"
SEED_ROWS = 2048


def quantised(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long, or null where the vector takes no part."""
    x = F.transform(vec, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)) & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class KDTree:
    """Median splits on the widest dimension; ``lo`` and ``hi`` are the tight boxes, nodes in level order."""

    def __init__(self, points: np.ndarray, leaf_size: int = 256):
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        lo, hi = [], []
        todo = [(0, len(points))]
        for a, b in todo:  # grows while it runs
            own = points[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            self.span.append((a, b))
            lo.append(low)
            hi.append(high)
            wide = int((high - low).argmax())
            if b - a <= leaf_size or high[wide] == low[wide]:
                self.child.append(None)
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], mid)]
            self.child.append((len(todo), len(todo) + 1))
            todo += [(a, a + mid), (a + mid, b)]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.hi[nodes].T + np.minimum(queries, 0) @ self.lo[nodes].T


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, kth: np.ndarray, leaf_size: int = 256):
    """Arrays (query position, id, score) of each query's k best with score >= its ``kth``; ties to smaller ids."""
    tree = KDTree(points, leaf_size)
    kth = kth.copy()
    # descend level by level; a node lives on while its bound reaches the k-th score of some query
    front, leaves = np.array([0]), []
    while len(front):
        alive = (tree.bounds(queries, front) >= kth[:, None]).any(0)
        nxt = []
        for node in front[alive]:
            if (pair := tree.child[node]) is None:
                leaves.append(int(node))
            else:
                nxt += pair
        front = np.array(nxt, dtype=np.int64)
    empty = np.empty(0, dtype=np.int64)
    if not leaves:
        return empty, empty, empty.astype(points.dtype)
    leaf = np.array(leaves)
    bound = tree.bounds(queries, leaf)
    turn = np.argsort(-bound, axis=1, kind="stable")
    # scores of the k best so far, only from the shard itself
    top = np.full((len(queries), k), np.iinfo(np.int64).min if points.dtype.kind == "i" else -np.inf, dtype=points.dtype)
    at, got, size = np.arange(len(queries)), [], 0
    for step in range(len(leaf)):
        at = at[bound[at, turn[at, step]] >= kth[at]]
        if not len(at):
            break
        mine = turn[at, step]
        by = np.argsort(mine, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(mine[by])) + 1):
            q = at[part]
            a, b = tree.span[leaf[mine[part[0]]]]
            rows = tree.order[a:b]
            score = queries[q] @ points[rows].T
            good = (score >= kth[q][:, None]) & (ids[rows][None, :] != query_ids[q][:, None])
            hit_q, hit_c = np.nonzero(good)
            got.append((q[hit_q], ids[rows][hit_c], score[hit_q, hit_c]))
            size += len(hit_q)
            low = top[:, :1].min() if len(top) else 0
            merged = np.concatenate([top[q], np.where(good, score, low)], axis=1)
            top[q] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            kth[q] = np.maximum(kth[q], top[q].min(1))
        if size > 2_000_000:
            got = [best_of(*(np.concatenate(x) for x in zip(*got, strict=True)), k)]
            size = len(got[0][0])
    return best_of(*(np.concatenate(x) for x in zip(*got, strict=True)), k) if got else (empty, empty, empty.astype(points.dtype))


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, dtype=bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return q[rank < k], ids[rank < k], score[rank < k]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.empty((0, 0), dtype=np.int64)


def _exact_kind(*parts: np.ndarray) -> np.dtype:
    """float64 where every inner product stays an exact integer in it, else int64; ``OverflowError`` beyond that."""
    most = [max(-int(p.min()), int(p.max())) if p.size else 0 for p in parts]
    largest = most[0] * most[-1] * max(1, parts[0].shape[1])
    if largest >= 2**62:
        raise OverflowError(f"inner products of up to {largest} do not fit in 64 bits")
    return np.dtype(np.float64 if largest < 2**52 else np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 32768, block_rows: int = 4096, leaf_size: int = 256) -> DataFrame:
    """Each query's k best by integer inner product: ``query_id, rank, vec_id, score``.

    Both tables are ``vec_id, v`` with ``v`` an array of long or null, as from :func:`quantised`.
    """
    sound = lambda df: df.where("v is not null and vec_id is not null").select("vec_id", "v", F.size("v").alias("dim"))
    cand = sound(vectors)
    ask = sound(sound(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_cand, n_ask = cand.count(), ask.count()
    shards, blocks = max(1, -(-n_cand // shard_rows)), max(1, -(-n_ask // block_rows))
    shards = max(shards, min(8, -(-n_cand // 4096)))  # small tables still use several tasks
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seeds = [(r["vec_id"], list(r["v"])) for r in cand.orderBy(norm.desc(), "vec_id").limit(SEED_ROWS).collect()]

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(seeds):
            by_dim.setdefault(len(v), []).append(i)
        held = {d: (np.array([seeds[i][1] for i in own]), np.array([seeds[i][0] for i in own])) for d, own in by_dim.items()}
        for batch in batches:
            ids, dims = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy()
            kth = np.full(len(ids), np.iinfo(np.int64).min // 2)
            for d in np.unique(dims):
                if d not in held:
                    continue
                at = np.flatnonzero(dims == d)
                q, (points, own) = _matrix(batch.column("v").take(pa.array(at))), held[d]
                kind = _exact_kind(q, points)
                score = q.astype(kind) @ points.astype(kind).T
                score = np.where(own[None, :] == ids[at][:, None], np.iinfo(np.int64).min // 2, score.astype(np.int64))
                if len(own) > k:
                    kth[at] = np.partition(score, len(own) - k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dim"), pa.array(kth)], ["vec_id", "v", "dim", "kth"])

    bounded = ask.mapInArrow(first_bound, "vec_id long, v array<long>, dim int, kth long")
    left = cand.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = bounded.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def one(points: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(points) and len(asked):
            pd, qd = points["dim"].to_numpy(), asked["dim"].to_numpy()
            for d in np.intersect1d(pd, qd):
                p, q = points.take(pa.array(np.flatnonzero(pd == d))), asked.take(pa.array(np.flatnonzero(qd == d)))
                pm, qm = _matrix(p["v"]), _matrix(q["v"])
                kind = _exact_kind(pm, qm)
                qids = q["vec_id"].to_numpy()
                at, ids, score = search(pm.astype(kind), p["vec_id"].to_numpy(), qm.astype(kind), qids, k, q["kth"].to_numpy().astype(kind), leaf_size)
                out.append((qids[at], ids, score.astype(np.int64)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
        return pa.table({n: pa.array(c, type=pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    found = left.groupBy("shard", "block", "dim").cogroup(right.groupBy("shard", "block", "dim")).applyInArrow(one, PAIRS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
