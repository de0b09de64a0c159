"""Near-duplicate documents by b-bit MinHash.

1. One pass over whole texts gives each document its set's size and 128-bit key, ``bands`` band hashes of ``rows``
   minima each, and the low ``bits`` bits of all minima packed as bit planes.
2. Documents with equal sets fall into one class, which goes on as its smallest id.
3. Band candidates: classes that share a band hash meet in groups of bounded size.  Inside a group the similarity of
   every two is estimated from the packed bits: equal low bits are counted with XOR and a bit count, and corrected
   for the 2**-bits of them that agree by accident.  Each group returns a spanning forest of the pairs whose estimate
   is above ``threshold`` less ``slack`` standard errors, so its output is linear in its members.
4. The forests' edges are verified on full sets: work and rows are linear in the edges.  The components of those that
   hold are the result but for links that no forest showed.  Those can only join parts between which an edge failed, so
   the members of such parts, and no others, are compared exactly: each with all of the other parts, in groups of
   bounded size.

With 45 bands of 5 rows a pair of similarity exactly 0.75 misses every band with probability 5e-6, and falls below
the slack with 3e-5; both vanish quickly above 0.75.  Nothing is capped: large groups are split into blocks.

Defined cases: a null or blank text has an empty set and is linked with nothing; a row with a null id is linked with
nothing and kept; rows with the same id are one document, whose sets are linked; extra columns are ignored; an empty
table gives an empty result.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.operators.graph import connected_components
from .grouped import edge_batches, forest, in_blocks, runs, sorted_groups
from helixspark.plans.scratch import Run, keep
from .shingling import U, mix, text_sets
from .sieve import bitmap, part, sift
from .tables import slim, unused

BLOCK = 256  # members of a block; a group holds two
BLOCK_SHINGLES = 1_000_000  # and so many shingles, about


@dataclass(frozen=True)
class MinHash:
    rows: int = 5
    bands: int = 45
    bits: int = 4
    width: int = 5
    percent: int = 75
    slack: float = 4.0

    @property
    def size(self) -> int:
        return self.rows * self.bands

    @property
    def longs(self) -> int:
        """64-bit words of a bit plane."""
        return -(-self.size // 64)

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(77))
        return rng.integers(0, 2**31, self.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, self.size, dtype=np.uint32)

    def cut(self) -> float:
        """Estimates below this are left out: the threshold less ``slack`` standard errors of a pair that just meets it."""
        s, low = self.percent / 100, 2.0**-self.bits
        agree = s + (1 - s) * low
        return s - self.slack * np.sqrt(agree * (1 - agree) / self.size) / (1 - low)

    def minima(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(size, number of nonempty sets) minima under each permutation."""
        starts = ends[:-1][ends[:-1] < ends[1:]]
        x = (values >> U(32)).astype(np.uint32)
        out = np.empty((self.size, len(starts)), dtype=np.uint32)
        room = np.empty_like(x)
        for i, (a, b) in enumerate(zip(*self.multipliers(), strict=True)):
            np.multiply(x, a, out=room)
            room += b
            np.minimum.reduceat(room, starts, out=out[i])
        return out

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        """(sets, bands); the band's number is part of its hash."""
        m = minima.astype(np.uint64).reshape(self.bands, self.rows, -1)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)[:, None] * U(0x9E3779B97F4A7C15)
        place = np.arange(1, self.rows + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)
        for r in range(self.rows):
            acc = mix(acc + m[:, r] + place[r])
        return np.ascontiguousarray(acc.T)

    def planes(self, minima: np.ndarray) -> np.ndarray:
        """(sets, bits * longs): bit plane p holds bit p of each minimum's low bits, after a mix that evens them out."""
        low = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.uint8)
        out = np.zeros((minima.shape[1], self.bits, self.longs * 64), dtype=np.uint8)
        for p in range(self.bits):
            out[:, p, : self.size] = ((low >> np.uint8(p)) & np.uint8(1)).T
        return np.packbits(out, axis=2).reshape(len(out), -1).view(np.uint64)

    def estimate(self, planes: np.ndarray) -> np.ndarray:
        """Collision-corrected similarity of every two rows of packed planes."""
        n = len(planes)
        differ = np.zeros((n, n), dtype=np.uint16)
        for w in range(self.longs):
            any_bit = np.zeros((n, n), dtype=np.uint64)
            for p in range(self.bits):
                col = planes[:, p * self.longs + w]
                any_bit |= col[:, None] ^ col[None, :]
            differ += np.bitwise_count(any_bit)
        low = 2.0**-self.bits
        return (1 - differ / self.size - low) / (1 - low)


SIGNATURES = "n_shingles long, k1 long, k2 long, bands array<long>, planes array<long>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def whole_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return slim(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")


def signatures(rows: DataFrame, params: MinHash, units: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, names: str = "id long") -> DataFrame:
    """Size, key, bands and packed low bits of the set of each ``text`` in ``rows``; no bands where the set is empty.

    ``units`` may cut a batch of rows into smaller texts; ``names`` are the columns that go with a text.
    """
    own = [x.split()[0] for x in names.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in [batch] if units is None else units(batch):
                yield from signed(unit)

    def signed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, values, ends in text_sets(batch.column("text"), params.width):
            n = np.diff(ends)
            some = n > 0
            keys = np.zeros((2, b - a), dtype=np.uint64)
            bands = planes = np.empty((0, 0), dtype=np.uint64)
            if some.any():
                starts = ends[:-1][some]
                keys[0, some] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), starts)
                keys[1, some] = np.add.reduceat(mix(values + U(0x14057B7EF767814F)), starts)
                minima = params.minima(values, ends)
                bands, planes = params.band_hashes(minima), params.planes(minima)
            steps = np.concatenate([[0], np.cumsum(some)])
            cols = [pa.array(n.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64))]
            cols += [_lists(bands.reshape(-1), steps * params.bands), _lists(planes.reshape(-1), steps * params.bits * params.longs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in own], *cols], [*own, "n_shingles", "k1", "k2", "bands", "planes"])

    return rows.mapInArrow(run, f"{names}, {SIGNATURES}")


def candidate_forest(reps: DataFrame, params: MinHash) -> DataFrame:
    """Edges ``src, dst`` whose components hold every two classes that may be linked, from their band groups."""
    cells = reps.select("id", F.explode("bands").alias("band"))
    groups = keep(cells.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    # most bands have one member; only what may be in a group is moved again
    placed = keep(sift(cells, bitmap(groups, "band"), "band").join(groups, "band"), "band-members")
    members = placed.join(sift(reps.select("id", "planes"), bitmap(placed, "id"), "id"), "id")
    dealt = in_blocks(members, "band", "id", F.col("n") / BLOCK).select("gid", "id", "planes")
    cut = params.cut()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for group in runs(batches):
                if len(group) < 2:
                    continue
                ids = group["id"].to_numpy()
                planes = group["planes"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
                for i, j in forest(params.estimate(planes) >= cut):
                    if ids[i] != ids[j]:
                        yield min(ids[i], ids[j]), max(ids[i], ids[j])

        return edge_batches(links())

    return sorted_groups(dealt).mapInArrow(run, "src long, dst long").distinct()


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets (sorted, distinct) have 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 6:
        inter = np.diag(sizes)
        for i in range(n):
            for j in range(i):
                if min(sizes[i], sizes[j]) * 100 >= percent * max(sizes[i], sizes[j]):
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        inter = np.zeros((n, n))
        step = 4096
        bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + step + 1, step))
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                m = np.zeros((n, step), dtype=np.float32)
                m[owner[a:b], column[a:b] % step] = 1
                inter += m @ m.T
        inter = inter.astype(np.int64)
        np.fill_diagonal(inter, sizes)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = (100 * inter >= percent * union) & (union > 0)
    np.fill_diagonal(linked, False)
    return linked


def full_sets(rows: DataFrame, params: MinHash, units: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """``id, shingles``: the full set of each text of ``rows`` that has words, cut by ``units`` as in :func:`signatures`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in [batch] if units is None else units(batch):
                for a, b, values, ends in text_sets(unit.column("text"), params.width):
                    yield pa.RecordBatch.from_arrays([unit.column("id").slice(a, b - a), _lists(values, ends)], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles array<long>").where("size(shingles) > 0")


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all sets in order, first shingle of each set and the end)."""
    lists = column.combine_chunks()
    return lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()


def hub_links(hub: np.ndarray, flat: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets (sorted, distinct, not empty) have 100 * intersection >= percent * union with ``hub``."""
    at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
    inter = np.add.reduceat((hub[at] == flat).astype(np.int64), ends[:-1])
    return 100 * inter >= percent * (len(hub) + np.diff(ends) - inter)


def verified_edges(edges: DataFrame, sets: DataFrame, params: MinHash) -> DataFrame:
    """``src, dst, good`` of each edge: whether the full sets are linked.  The ends of a source meet it in blocks."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    blocks = F.ceil(F.col("degree") / BLOCK)
    dealt = edges.join(degrees, "src").select("src", "dst", F.xxhash64("src", F.pmod(F.xxhash64(F.lit(23), "dst"), blocks)).alias("gid"))
    members = dealt.select("gid", "src", F.col("dst").alias("id")).unionByName(dealt.select("gid", "src", F.col("src").alias("id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            src, ids = group["src"].to_numpy(), group["id"].to_numpy()
            flat, ends = _sets(group["shingles"])
            other = np.flatnonzero(src != ids)
            if not len(other):
                continue
            good = np.zeros(len(ids), dtype=bool)
            for h in np.flatnonzero(src == ids):
                own = src == src[h]  # groups of two sources share a gid once in a very long while
                good |= own & hub_links(flat[ends[h] : ends[h + 1]], flat[ends[0] : ends[-1]], ends - ends[0], params.percent)
            yield pa.RecordBatch.from_arrays([pa.array(src[other]), pa.array(ids[other]), pa.array(good[other])], ["src", "dst", "good"])

    found = sorted_groups(members.join(sets, "id").select("gid", "src", "id", "shingles")).mapInArrow(run, "src long, dst long, good boolean")
    return found.groupBy("src", "dst").agg(F.max("good").alias("good"))


def labelled(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges between the parts that their ends are in: distinct ``src, dst`` of different parts."""
    out = edges.select("src", "dst")
    for end, far in (("src", "dst"), ("dst", "src")):
        named = out.join(parts.select(F.col("node").alias(end), "component"), end, "left")
        out = named.select(F.coalesce("component", end).alias(end), far)
    return out.where("src <> dst").distinct()


def cross_links(sets: DataFrame, members: DataFrame, params: MinHash) -> DataFrame:
    """Exact links ``src, dst`` between parts of a cluster; ``members`` is ``id, cluster, part``.

    The cluster's largest part is compared with all others, and those among each other, block by block.  A group returns
    a spanning forest of its links.
    """
    sized = members.join(sets.select("id", F.size("shingles").cast("long").alias("size")), "id")
    per_part = sized.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = per_part.groupBy("cluster").agg(
        F.max_by("part", F.struct("n", "part")).alias("main"), F.max(F.struct("n", "part", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")
    )
    count = lambda n, size: F.greatest(F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)), F.lit(1)).cast("int")
    plan = keep(whole.select("cluster", "main", count(F.col("top.n"), F.col("top.size")).alias("a"), count(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("b")), "blocks")
    rows = members.join(plan, "cluster")
    h = F.xxhash64(F.lit(7), "id")
    is_main = F.col("part") == F.col("main")
    own = F.when(is_main, F.pmod(h, F.col("a").cast("long"))).otherwise(F.col("a") + F.pmod(h, F.col("b").cast("long"))).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)))
    meeting = dealt.select("id", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("gid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for group in runs(batches):
                if len(group) < 2:
                    continue
                ids = group["id"].to_numpy()
                flat, ends = _sets(group["shingles"])
                for i, j in forest(exact_links([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], params.percent)):
                    if ids[i] != ids[j]:
                        yield min(ids[i], ids[j]), max(ids[i], ids[j])

        return edge_batches(links())

    few = sift(sets, bitmap(members, "id"), "id")
    return sorted_groups(meeting.join(few, "id").select("gid", "id", "shingles")).mapInArrow(run, "src long, dst long").distinct()


def linked_parts(edges: DataFrame, sets_of: Callable[[DataFrame], DataFrame], params: MinHash) -> DataFrame:
    """``node, component``: the components of all exact links among the ends of the candidate ``edges``."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    sets = keep(sets_of(nodes), "sets")
    judged = keep(verified_edges(edges, sets, params), "verified")
    parts = keep(connected_components(judged.where("good")), "parts")
    # parts between which a candidate failed may be linked by others of their members
    doubtful = keep(labelled(judged.where("not good"), parts), "doubtful")
    if doubtful.isEmpty():
        return parts
    clusters = keep(connected_components(doubtful).select(F.col("node").alias("part"), F.col("component").alias("cluster")), "clusters")
    alone = nodes.join(parts, F.col("id") == F.col("node"), "left_anti").select("id", F.col("id").alias("part"))
    of_part = parts.select(F.col("node").alias("id"), F.col("component").alias("part")).unionByName(alone)
    members = keep(sift(of_part, bitmap(clusters, "part"), "part").join(clusters, "part").select("id", "cluster", "part"), "members")
    between = keep(labelled(cross_links(sets, members, params), of_part.select(F.col("id").alias("node"), F.col("part").alias("component"))), "between")
    if between.isEmpty():
        return parts
    merged = connected_components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    renamed = of_part.join(merged, "part", "left")
    return renamed.select(F.col("id").alias("node"), F.coalesce("whole", "part").alias("component"))


def near_groups(docs: DataFrame, params: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``; a component is named by its smallest id."""
    rows = whole_texts(docs, id_col, text_col)
    # few texts have a partner; the others are not moved
    return groups_of(keep(signatures(rows, params), "minhash"), lambda nodes: full_sets(sift(rows, bitmap(nodes, "id"), "id"), params), params)


def groups_of(sig: DataFrame, sets_of: Callable[[DataFrame], DataFrame], params: MinHash) -> DataFrame:
    """:func:`near_groups` from a table of signatures; ``sets_of`` gives the full sets of (at least) a table of ids."""
    with Run() as tables:
        usable = sig.where("n_shingles > 0 and id is not null")
        classes = keep(usable.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
        # classes of one need no join to find their first
        found = bitmap(classes.where("m > 1"), "k1", "k2")
        # a set with fewer shingles is far from any other: even one more makes the union too large
        able = usable.where(F.col("n_shingles") * (100 - params.percent) >= params.percent)
        maybe, single = part(able.select("id", "k1", "k2", "bands", "planes"), found, "k1", "k2")
        firsts = sift(classes, found, "k1", "k2").select(F.col("rep").alias("id"), "k1", "k2")
        of_several = sift(maybe, bitmap(firsts, "id", "k1", "k2"), "id", "k1", "k2").join(firsts, ["id", "k1", "k2"])
        reps = single.unionByName(of_several).select("id", "bands", "planes")
        edges = keep(candidate_forest(reps, params), "candidates")
        parts = keep(linked_parts(edges, sets_of, params), "linked")
        named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").where("m > 1 or component is not null")
        named = keep(named.select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component")), "named")
        tables.release(named)
    key = ["k1", "k2", "n_shingles"]
    maybe, alone = part(sig.select("id", *key), bitmap(named, *key), *key)
    joined = maybe.join(named, key, "left")
    own = F.coalesce(F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")), F.col("id"))
    rows = joined.select("id", "n_shingles", own.alias("component_id")).unionByName(alone.select("id", "n_shingles", F.col("id").alias("component_id")))
    return rows.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, params: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, but for documents linked to one with a smaller id; rows with a null id stay.

    Only rows that may have to go are moved, for a left anti join with the ids that go.
    """
    key, own = unused(docs, "key", "own")
    with Run() as tables:
        gone = keep(near_groups(docs, params, id_col, text_col).where("not kept").select(F.col("id").alias(key)).distinct(), "gone")
        tables.release(gone)
    maybe, stay = part(docs.withColumn(key, F.col(f"`{id_col}`").cast("long")), bitmap(gone, key), key)
    left = maybe.withColumnRenamed(key, own).join(gone, F.col(own) == F.col(key), "left_anti").withColumnRenamed(own, key)
    return stay.unionByName(left).select(*[f"`{c}`" for c in docs.columns])
