"""Agglomeration, k-means and silhouettes over pair tables.

The pairs of clusters are a table throughout; only one row a merge, as many as there are samples, reaches the driver.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.operators import ordination
from helixspark.operators.matrix import cut
from helixspark.operators.pairs import both_ways
from helixspark.plans.scratch import drop, keep

Merge = tuple[int, int, float, int]


def _linked(method: str) -> tuple[Column, Column]:
    """(distance of two clusters from ``s, na, nb, wa, wb``, how ``s`` of several pairs is put together)."""
    na, nb, s = F.col("na"), F.col("nb"), F.col("s")
    if method == "average":
        return s / (na * nb), F.sum("s")
    if method == "ward":  # the recurrence of Ward's method, solved: between less within, of squared distances
        square = 2 * na * nb / (na + nb) * (s / (na * nb) - F.col("wa") / (na * na) - F.col("wb") / (nb * nb))
        return F.sqrt(F.greatest(F.lit(0.0), square)), F.sum("s")
    if method in ("single", "complete"):
        return s, F.min("s") if method == "single" else F.max("s")
    raise ValueError(f"unknown linkage: {method}")


def agglomerate(pairs: DataFrame, method: str = "average") -> tuple[list[str], list[Merge]]:
    """(samples in order, merges ``(node, node, height, size)``) of ``sample_a, sample_b, distance``.

    Leaves are 0 .. n-1, the i-th merge makes node n + i.  A round merges all pairs of clusters that are each other's
    nearest, which for these linkages are merges of the sequential method as well; ties go to the smaller samples.
    Distances between clusters follow from sums over their pairs, so a round is two joins and one aggregate.
    """
    distance, together = _linked(method)
    start = F.col("distance") * F.col("distance") if method == "ward" else F.col("distance")
    first = F.col("sample_a") < F.col("sample_b")
    low, high = (F.when(first, F.col(a)).otherwise(F.col(b)) for a, b in (("sample_a", "sample_b"), ("sample_b", "sample_a")))
    links = keep(pairs.select(low.alias("a"), high.alias("b"), start.cast("double").alias("s")), "links")
    members = links.select(F.col("a").alias("c")).union(links.select("b")).distinct()
    sizes = keep(members.select("c", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("w")), "sizes")
    names = [r["c"] for r in sizes.select("c").orderBy("c").collect()]
    n = len(names)
    if links.count() != n * (n - 1) // 2:
        raise ValueError("some pairs of samples have no distance")
    found: list[tuple[float, int, str, str, float, int]] = []
    top: dict[str, float] = {}
    left, round_no = n, 0
    while left > 1:
        of = lambda s: sizes.select(F.col("c").alias(s), F.col("n").alias(f"n{s}"), F.col("w").alias(f"w{s}"))
        sized = links.join(of("a"), "a").join(of("b"), "b").withColumn("d", distance)
        edge = F.struct("d", "a", "b", "s", (F.col("na") + F.col("nb")).alias("n"), (F.col("wa") + F.col("wb")).alias("w"))
        ends = sized.select(F.explode(F.array("a", "b")).alias("c"), edge.alias("edge"))
        nearest = ends.groupBy("c").agg(F.min("edge").alias("edge"))
        mutual = keep(nearest.groupBy("edge.a", "edge.b").agg(F.count("*").alias("votes"), F.first("edge").alias("edge")).where("votes = 2").select("edge.*"), "merges")
        for r in mutual.collect():
            height = max(r["d"], top.get(r["a"], 0.0), top.get(r["b"], 0.0))
            top[r["a"]] = height
            found.append((height, round_no, r["a"], r["b"], r["d"], r["n"]))
            left -= 1
        renamed = mutual.select(F.col("b").alias("old"), F.col("a").alias("new"))
        grown = mutual.select(F.col("a").alias("c"), "n", (F.col("w") + F.col("s")).alias("w"))
        gone = mutual.select(F.explode(F.array("a", "b")).alias("c"))
        next_sizes = keep(sizes.join(gone, "c", "left_anti").unionByName(grown), "sizes")
        moved = links
        for end in ("a", "b"):
            moved = moved.join(renamed.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
        next_links = keep(moved.groupBy("a", "b").agg(together.alias("s")), "links")
        for table in (links, sizes, mutual):
            drop(table)
        links, sizes, round_no = next_links, next_sizes, round_no + 1
    node, merges = {s: i for i, s in enumerate(names)}, []
    for i, (_, _, a, b, d, size) in enumerate(sorted(found)):
        merges.append((min(node[a], node[b]), max(node[a], node[b]), float(d), int(size)))
        node[a] = n + i
    return names, merges


def best_cut(pairs: DataFrame, names: list[str], merges: list[Merge], most: int = 8) -> int:
    """Number of clusters with the best silhouette, the smallest on ties, up to min(``most``, n - 1)."""
    n = len(names)
    top = min(most, n - 1)
    if top <= 2:
        return min(2, n)
    rows = [("tree", k, s, int(x)) for k in range(2, top + 1) for s, x in zip(names, cut(merges, n, k), strict=True)]
    labels = pairs.sparkSession.createDataFrame(rows, "method string, k int, sample string, label int")
    scores = mean_silhouettes(pairs.select("sample_a", "sample_b", F.col("distance").alias("tree")), labels)
    return scores.orderBy(F.col("silhouette").desc(), "k").first()["k"]


def kmeans_labels(points: DataFrame, k: int, seed: int = 42, starts: int = 2) -> DataFrame:
    """``sample, label`` of the best of ``starts`` runs from oversampled seeds on ``sample, features``; labels are numbered by first sample."""
    runs = [KMeans(k=k, seed=seed + i, maxIter=100, tol=1e-8).fit(points) for i in range(starts)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    found = best.transform(points).select("sample", F.col("prediction").alias("own"))
    order = {r["own"]: i for i, r in enumerate(found.groupBy("own").agg(F.min("sample").alias("first")).orderBy("first").collect())}
    return found.select("sample", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("own")).alias("label"))


def mean_silhouettes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``method, k, silhouette``: the mean silhouette of each labelling ``method, k, sample, label``; -1 where it has one label, or one a sample.

    ``pairs`` has a column of distances for each method, named by it.  One job scores all labellings.
    """
    methods = [r[0] for r in labels.select("method").distinct().collect()]
    each = both_ways(pairs, *methods).select("sample", "other", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("d")) for m in methods])).alias("x")).select("sample", "other", "x.*")
    key = ["method", "k"]
    own = labels.select(*key, "sample", "label")
    other = labels.select(*key, F.col("sample").alias("other"), F.col("label").alias("other_label"))
    sizes = labels.groupBy(*key, "label").agg(F.count("*").alias("n"))
    sums = each.join(other, ["method", "other"]).groupBy(*key, "sample", "other_label").agg(F.sum("d").alias("d"))
    sized = sums.join(own, [*key, "sample"]).join(sizes.withColumnRenamed("label", "other_label").withColumnRenamed("n", "other_n"), [*key, "other_label"]).join(sizes, [*key, "label"])
    same = F.col("label") == F.col("other_label")
    parts = sized.groupBy(*key, "sample", "n").agg(F.max(F.when(same, F.col("d") / (F.col("other_n") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("other_n"))).alias("b"))
    high = F.greatest("a", "b")
    value = F.coalesce(F.when((F.col("n") > 1) & (high > 0), (F.col("b") - F.col("a")) / high), F.lit(0.0))
    kinds = labels.groupBy(*key).agg(F.count_distinct("label").alias("kinds"), F.count("*").alias("samples"))
    scored = parts.groupBy(*key).agg(F.sum(value).alias("sum"))
    sound = (F.col("kinds") >= 2) & (F.col("kinds") < F.col("samples"))
    return kinds.join(scored, key, "left").select(*key, F.when(sound, F.col("sum") / F.col("samples")).otherwise(-1.0).alias("silhouette"))


def identify_clusters(spark, pairs: DataFrame, least: int = 2, most: int = 8, variant: str = "standard", seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels ``method, k, sample, label``; scores ``method, k, silhouette``; the best k of each method).

    ``standard``: k-means on up to 10 principal coordinates with Euclidean silhouettes, and average linkage.
    ``simple``: k-means on the rows of the similarity matrix and Ward linkage; nothing if the range is empty.
    """
    pairs = keep(pairs.select("sample_a", "sample_b", "distance"), "pairs")
    names, merges = agglomerate(pairs, "average" if variant == "standard" else "ward")
    n = len(names)
    top = min(most, n - 1)
    wanted = list(range(least, top + 1)) if variant == "standard" or top > least else []
    shapes = ("method string, k int, sample string, label int", "method string, k int, silhouette double")
    if not wanted:
        return (spark.createDataFrame([], shapes[0]), *[spark.createDataFrame([], shapes[1])] * 2)
    if variant == "standard":
        _, axes, _ = ordination.pcoa(pairs, min(10, max(1, n - 1)))
        points = spark.createDataFrame([(s, [float(x) for x in row]) for s, row in zip(names, axes, strict=True)], "sample string, point array<double>")
    else:
        cells = both_ways(pairs, "distance").select("sample", F.struct("other", (1 - F.col("distance")).alias("similarity")).alias("cell"))
        own = spark.createDataFrame([(s,) for s in names], "sample string").select("sample", F.struct(F.col("sample").alias("other"), F.lit(1.0).alias("similarity")).alias("cell"))
        points = cells.unionByName(own).groupBy("sample").agg(F.array_sort(F.collect_list("cell")).alias("cells")).select("sample", F.col("cells.similarity").alias("point"))
    points = keep(points, "points")
    featured = keep(points.select("sample", array_to_vector("point").alias("features")), "features")
    side = lambda s: points.select(F.col("sample").alias(f"sample_{s}"), F.col("point").alias(f"point_{s}"))
    apart = F.sqrt(F.aggregate(F.zip_with("point_a", "point_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    both = pairs.join(side("a"), "sample_a").join(side("b"), "sample_b").select("sample_a", "sample_b", F.col("distance").alias("hierarchical"), apart.alias("kmeans"))
    trees = spark.createDataFrame([("hierarchical", k, s, int(x)) for k in wanted for s, x in zip(names, cut(merges, n, k), strict=True)], shapes[0])
    labels = trees
    for k in wanted:
        labels = labels.unionByName(kmeans_labels(featured, k, seed).select(F.lit("kmeans").alias("method"), F.lit(k).alias("k"), "sample", F.col("label").cast("int")))
    labels = keep(labels, "labels")
    scores = keep(mean_silhouettes(both, labels), "scores")
    best = scores.groupBy("method").agg(F.max_by(F.struct("k", "silhouette"), F.struct("silhouette", -F.col("k"))).alias("x")).select("method", "x.*")
    return labels, scores, best
