"""Ordination without the square matrix: a block Krylov method whose products with the matrix are Spark jobs.

A product with the doubly centred matrix of squared distances (principal coordinates), or with the Gram matrix of the
samples' frequency vectors (principal components), is a join of its cells with a block of vectors and a sum.  The driver
holds blocks of as many rows as there are samples and some dozens of columns; pairs and profiles stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.operators.pairs import both_ways
from helixspark.plans.scratch import keep

Multiply = Callable[[np.ndarray], np.ndarray]


def top_eigenpairs(multiply: Multiply, n: int, k: int, block: int = 8, most: int = 60, tolerance: float = 1e-10, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(the ``k`` largest eigenvalues, their vectors as columns) of a symmetric matrix of which only products are known.

    Blocks of the Krylov space are made orthogonal to all before them; the Rayleigh-Ritz values of the space converge to
    both ends of the spectrum.  The residuals end the iteration, at the latest ``most`` products or the whole space.
    """
    k = min(k, n)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(max(block, k), n))))[0]
    images, last = multiply(basis), basis.shape[1]
    for step in range(most + 1):
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = vectors[:, ::-1][:, :k]
        best = values[::-1][:k]
        residual = np.linalg.norm(images @ top - (basis @ top) * best, axis=0)
        if basis.shape[1] >= n or step == most or residual.max(initial=0.0) <= tolerance * max(np.abs(values).max(initial=0.0), 1e-300):
            break
        fresh = images[:, -last:]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        left, sizes, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = left[:, sizes > 1e-12 * max(sizes.max(initial=0.0), 1e-300)][:, : n - basis.shape[1]]
        fresh = fresh - basis @ (basis.T @ fresh)
        fresh = np.linalg.qr(fresh)[0]
        last = fresh.shape[1]
        if not last:
            break
        basis, images = np.hstack([basis, fresh]), np.hstack([images, multiply(fresh)])
    return best, basis @ top


def _scaled(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Coordinates: vectors times the root of their values, each with its largest entry positive."""
    flip = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else np.ones(vectors.shape[1])
    return vectors * np.where(flip == 0, 1, flip) * np.sqrt(np.maximum(values, 0))


def _block(spark, names: list[str], name: str, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({name: names} | {f"x{i}": x[:, i] for i in range(x.shape[1])}))


def _collected(rows: DataFrame, names: list[str], q: int) -> np.ndarray:
    """A block of ``sample, y0 ..`` in the samples' order; samples without a row have zeros."""
    got = rows.toPandas().set_index("sample").reindex(names).fillna(0.0)
    return got[[f"y{i}" for i in range(q)]].to_numpy(dtype=np.float64)


def _sum_of(q: int, factor: str, value: str) -> list:
    return [F.sum(F.col(factor) * F.col(f"{value}{i}")).alias(f"y{i}") for i in range(q)]


def pcoa(pairs: DataFrame, n_components: int = 2, missing: float | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(samples, coordinates, eigenvalues) of classical scaling of ``sample_a, sample_b, distance``.

    ``ValueError`` if a pair of samples has no row, unless ``missing`` says what its distance is.
    """
    spark = pairs.sparkSession
    cells = keep(both_ways(pairs, "distance"), "distances")
    names = [r["sample"] for r in cells.select("sample").distinct().orderBy("sample").collect()]
    n = len(names)
    absent = n * (n - 1) - cells.count()
    if absent and missing is None:
        raise ValueError(f"{absent // 2} pairs of samples have no distance; say what they count as by missing=")
    usual = (missing or 0.0) ** 2
    squares = cells.select("sample", "other", (F.col("distance") * F.col("distance") - usual).alias("d2"))

    def multiply(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(0)
        summed = squares.join(_block(spark, names, "other", x), "other").groupBy("sample").agg(*_sum_of(x.shape[1], "d2", "x"))
        y = _collected(summed, names, x.shape[1]) + usual * (x.sum(0) - x)
        return -0.5 * (y - y.mean(0))

    if not n:
        return [], np.empty((0, 0)), np.empty(0)
    values, vectors = top_eigenpairs(multiply, n, n_components)
    return names, _scaled(values, vectors), values


def pca(prof: DataFrame, n_components: int = 2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(samples, scores, explained variance ratios) of the samples' frequency vectors; products go by way of the k-mers."""
    spark = prof.sparkSession
    cells = keep(prof.select("sample", "kmer", (F.col("cnt").cast("double") / F.col("total")).alias("f")), "frequencies")
    own = cells.groupBy("sample").agg(F.sum(F.col("f") * F.col("f")).alias("q")).orderBy("sample").collect()
    names, n = [r["sample"] for r in own], len(own)

    def gram(x: np.ndarray) -> np.ndarray:
        q = x.shape[1]
        of_kmers = cells.join(_block(spark, names, "sample", x), "sample").groupBy("kmer").agg(*_sum_of(q, "f", "x"))
        return _collected(cells.join(of_kmers, "kmer").groupBy("sample").agg(*_sum_of(q, "f", "y")), names, q)

    def multiply(x: np.ndarray) -> np.ndarray:
        y = gram(x - x.mean(0))
        return y - y.mean(0)

    if not n:
        return [], np.empty((0, 0)), np.empty(0)
    total = sum(r["q"] for r in own) - float(gram(np.ones((n, 1))).sum()) / n
    values, vectors = top_eigenpairs(multiply, n, n_components)
    return names, _scaled(values, vectors), np.maximum(values, 0) / (total if total > 0 else 1)


def as_table(spark, names: list[str], coordinates: np.ndarray, prefix: str = "pc") -> DataFrame:
    cols = [f"{prefix}{i + 1}" for i in range(coordinates.shape[1])]
    return spark.createDataFrame([(s, *map(float, row)) for s, row in zip(names, coordinates, strict=True)], "sample string" + "".join(f", {c} double" for c in cols))
