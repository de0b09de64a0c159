"""Kernels over a small sample-by-sample matrix on the driver: metric scaling, t-SNE, and what tests compare with.

``MAX_SAMPLES`` guards the size.  Registered queries and the phases use :mod:`ordination` and :mod:`clusters`, which have
no such bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SAMPLES = 5000


def collect_matrix(
    pairs: DataFrame, samples: list[str] | None = None, value: str = "distance", diagonal: float = 0.0, missing: float | None = None
) -> tuple[list[str], np.ndarray]:
    """(samples in order, square matrix).  Pairs without a row get ``missing``; ``ValueError`` where that is not given."""
    if samples is None:
        samples = sorted({r[0] for r in pairs.select("sample_a").union(pairs.select("sample_b")).distinct().limit(MAX_SAMPLES + 1).collect()})
    if len(samples) > MAX_SAMPLES:
        raise ValueError(f"{len(samples)} samples are too many for a matrix on the driver; at most {MAX_SAMPLES}")
    at = {s: i for i, s in enumerate(samples)}
    out = np.full((len(samples), len(samples)), np.nan)
    np.fill_diagonal(out, diagonal)
    got = pairs.select("sample_a", "sample_b", value).toPandas()
    i, j = (got[c].map(at).to_numpy() for c in ("sample_a", "sample_b"))
    there = ~(np.isnan(i.astype(float)) | np.isnan(j.astype(float)))  # pairs of other samples than those asked for
    i, j = i[there].astype(np.int64), j[there].astype(np.int64)
    out[i, j] = out[j, i] = got[value].to_numpy()[there]
    absent = np.isnan(out)
    if absent.any():
        if missing is None:
            raise ValueError(f"{int(absent.sum()) // 2} pairs of samples have no {value}; say what they count as by missing=")
        out[absent] = missing
    return samples, out


def _centred(m: np.ndarray) -> np.ndarray:
    return m - m.mean(0) - m.mean(1)[:, None] + m.mean()


def _axes(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on the first axes and all eigenvalues, signs fixed by each axis' largest entry."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    n = min(n, len(values))
    flip = np.sign(vectors[np.abs(vectors[:, :n]).argmax(0), np.arange(n)]) if n else np.empty(0)
    return vectors[:, :n] * np.where(flip == 0, 1, flip) * np.sqrt(np.maximum(values[:n], 0)), values


def pcoa(distances: np.ndarray, n_components: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Classical scaling of a distance matrix: (coordinates, eigenvalues)."""
    return _axes(_centred(-0.5 * distances**2), n_components)


def mds(distances: np.ndarray, n_components: int = 2, rounds: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Metric scaling by majorisation from the classical solution: (coordinates, stress, the sum of squared differences)."""
    n = len(distances)
    points = pcoa(distances, n_components)[0]
    stress = np.inf
    for _ in range(rounds if n > 1 else 0):
        now = np.sqrt(squared_distances(points, points))
        np.fill_diagonal(now, 0.0)
        last, stress = stress, float(((now - distances) ** 2).sum() / 2)
        if last - stress <= tolerance * max(stress, 1e-300):
            break
        ratio = np.divide(distances, now, out=np.zeros_like(now), where=now > 0)
        b = -ratio
        np.fill_diagonal(b, ratio.sum(1))
        points = b @ points / n
    return points, 0.0 if stress == np.inf else stress


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of a and of b, from norms and one matrix product."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def neighbour_shares(distances: np.ndarray, perplexity: float) -> np.ndarray:
    """Joint probabilities of neighbours: per row a Gaussian whose entropy is ln(perplexity), made symmetric."""
    n = len(distances)
    d2 = distances**2
    out = np.zeros((n, n))
    for i in range(n):
        own = np.delete(d2[i], i)
        own = own - own.min()
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-own * beta)
            entropy = np.log(w.sum()) + beta * (own * w).sum() / w.sum()
            if entropy > np.log(perplexity):
                low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        out[i, np.arange(n) != i] = w / w.sum()
    return (out + out.T) / (2 * n)


def tsne(distances: np.ndarray, n_components: int = 2, perplexity: float = 30.0, rounds: int = 500, rate: float = 200.0, seed: int = 42) -> np.ndarray:
    """t-SNE of a distance matrix by gradient descent with momentum; the perplexity is at most a third of the others."""
    n = len(distances)
    if n < 3:
        return pcoa(distances, n_components)[0]
    p = np.maximum(neighbour_shares(distances, min(perplexity, max(1.0, (n - 1) / 3))), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, n_components))
    step, gain = np.zeros_like(y), np.ones_like(y)
    for r in range(rounds):
        near = 1 / (1 + squared_distances(y, y))
        np.fill_diagonal(near, 0.0)
        q = np.maximum(near / near.sum(), 1e-12)
        pull = ((12.0 if r < 100 else 1.0) * p - q) * near
        gradient = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(0.01, np.where(np.sign(gradient) == np.sign(step), gain * 0.8, gain + 0.2))
        step = (0.5 if r < 100 else 0.8) * step - min(rate, max(10.0, n / 4)) * gain * gradient
        y = y + step
        y -= y.mean(0)
    return y


def pca_from_gram(gram: np.ndarray, n_components: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """PCA by the samples' inner products: (scores, explained variance ratios)."""
    scores, values = _axes(_centred(gram), n_components)
    total = np.maximum(values, 0).sum()
    return scores, np.maximum(values[:n_components], 0) / (total if total > 0 else 1)


def profile_gram(prof: DataFrame) -> tuple[list[str], np.ndarray]:
    """Inner products of the samples' frequency vectors, from shared k-mers only."""
    from helixspark.operators.pairs import pair_table, sample_sums

    table = pair_table(prof).select("sample_a", "sample_b", (F.col("p").cast("double") / F.col("t_a") / F.col("t_b")).alias("gram"))
    own = {r["sample"]: r["q"] / r["t"] / r["t"] for r in sample_sums(prof).collect()}
    samples, gram = collect_matrix(table, sorted(own), "gram")
    gram[np.arange(len(samples)), np.arange(len(samples))] = [own[s] for s in samples]
    return samples, gram


def linkage(distances: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges ``(node, node, height, size)``, n - 1 of them; leaves are 0..n-1, the i-th merge makes node n + i.

    Lance-Williams updates of ``average``, ``single``, ``complete`` and ``ward`` on a working matrix; ties go to the
    smaller nodes.
    """
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    node, size, alive, merges = list(range(n)), np.ones(n), np.ones(n, dtype=bool), []
    for step in range(n - 1):
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = divmod(int(masked.argmin()), n)
        i, j = min(i, j), max(i, j)
        height, a, b = d[i, j], size[i], size[j]
        rest = alive.copy()
        rest[[i, j]] = False
        if method == "average":
            new = (a * d[i, rest] + b * d[j, rest]) / (a + b)
        elif method == "ward":
            c = size[rest]
            new = np.sqrt(np.maximum(0, ((a + c) * d[i, rest] ** 2 + (b + c) * d[j, rest] ** 2 - c * height**2) / (a + b + c)))
        elif method in ("single", "complete"):
            new = (np.minimum if method == "single" else np.maximum)(d[i, rest], d[j, rest])
        else:
            raise ValueError(f"unknown linkage: {method}")
        d[i, rest] = d[rest, i] = new
        merges.append((min(node[i], node[j]), max(node[i], node[j]), float(height), int(a + b)))
        node[i], size[i], alive[j] = n + step, a + b, False
    return merges


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels of the partition into k clusters, numbered by first sample."""
    parent = list(range(2 * n - 1)) if n else []
    for step, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        parent[a] = parent[b] = n + step

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    roots: dict[int, int] = {}
    return np.array([roots.setdefault(top(i), len(roots)) for i in range(n)], dtype=int)


def silhouette_score(distances: np.ndarray, labels: np.ndarray) -> float:
    n, kinds = len(labels), np.unique(labels)
    if not 2 <= len(kinds) < n:
        return -1.0
    sums = np.stack([distances[:, labels == c].sum(1) for c in kinds], 1)
    size = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    a = sums[np.arange(n), own] / np.maximum(1, size[own] - 1)
    means = sums / size
    means[np.arange(n), own] = np.inf
    b = means.min(1)
    top = np.maximum(a, b)
    return float(np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def best_cut(distances: np.ndarray, merges, most: int = 8) -> int:
    """Number of clusters with the best silhouette, the smallest on ties, up to min(``most``, n - 1)."""
    n = len(distances)
    top = min(most, n - 1)
    if top <= 2:
        return min(2, n)
    scores = [silhouette_score(distances, cut(merges, n, k)) for k in range(2, top + 1)]
    return 2 + int(np.argmax(scores))


def kmeans(points: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 300) -> np.ndarray:
    """Lloyd's algorithm from k-means++ starts; labels of the run with the least inertia, numbered by first sample."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(points), dtype=int))
    for _ in range(starts):
        centres = points[[rng.integers(len(points))]]
        while len(centres) < k:
            d = squared_distances(points, centres).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(points), 1 / len(points))
            centres = np.vstack([centres, points[rng.choice(len(points), p=p)]])
        labels = None
        for _ in range(rounds):
            new = squared_distances(points, centres).argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centres = np.stack([points[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        inertia = ((points - centres[labels]) ** 2).sum()
        if inertia < best[0] - 1e-12:
            best = (inertia, labels)
    first: dict[int, int] = {}
    return np.array([first.setdefault(int(x), len(first)) for x in best[1]], dtype=int)
