import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixspark import queries
from helixspark.operators import clusters, graph, lsh, matrix, ordination, pairs, plotdata, recommend, stats

FIXTURES = {
    "M1": (0.5, 0.8, 0.9, 0.7, 0.8, 0.3),
    "M2": (0.3, 0.7, 0.8, 0.6, 0.7, 0.2),
    "M3": (0.1, 0.8, 0.9, 0.9, 0.8, 0.1),
    "M4": (0.2, 0.8, 0.7, 0.7, 0.8, 0.3),
}
#: F and R2 standard, F and R2 simple, silhouette
EXPECTED = {
    "M1": (6.588235, 0.767123, 38.804533, 0.950986, 0.498039),
    "M2": (14.230769, 0.876777, 192.881443, 0.989737, 0.641026),
    "M3": (144.0, 0.986301, 21314.0, 0.999906, 0.882353),
    "M4": (16.384615, 0.891213, 243.396907, 0.991850, 0.666667),
}
PROFILE = "sample string, kmer string, cnt long, total long"


def pair_frame(spark, values, names="ABCD"):
    rows = [(a, b, float(d), 1.0 - d) for (a, b), d in zip(itertools.combinations(names, 2), values, strict=True)]
    return spark.createDataFrame(rows, "sample_a string, sample_b string, distance double, similarity double")


def random_profiles(spark, n=9, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = {f"k{rng.randrange(30):02}": rng.randrange(1, 9) for _ in range(rng.randrange(1, 20))}
        rows += [(f"s{i}", k, c, sum(own.values())) for k, c in own.items()]
    rows.append(("zz", "alone", 4, 4))
    return rows, spark.createDataFrame(rows, PROFILE)


def brute_metric(name, x, y, vocabulary):
    keys = set(x) | set(y)
    a, b = ([p.get(k, 0.0) for k in sorted(keys)] for p in (x, y))
    mins, maxs = sum(map(min, a, b)), sum(map(max, a, b))
    dot = sum(i * j for i, j in zip(a, b, strict=True))
    return {
        "jaccard": len(set(x) & set(y)) / len(keys), "weighted_jaccard": mins / maxs, "cosine": dot / math.sqrt(sum(i * i for i in a) * sum(i * i for i in b)),
        "braycurtis": sum(abs(i - j) for i, j in zip(a, b, strict=True)) / (sum(a) + sum(b)), "euclidean": math.dist(a, b), "manhattan": sum(abs(i - j) for i, j in zip(a, b, strict=True)),
        "hamming": sum(abs(i - j) > 1e-12 for i, j in zip(a, b, strict=True)) / len(vocabulary),
    }[name]


@pytest.mark.parametrize("name", pairs.METRICS)
@pytest.mark.parametrize("exact", [True, False])
def test_metrics_equal_naive_full_outer_join(spark, name, exact):
    rows, prof = random_profiles(spark)
    by = {}
    for s, k, c, t in rows:
        by.setdefault(s, {})[k] = c / t
    got = {(r["sample_a"], r["sample_b"]): r for r in pairs.pairwise(prof, name, exact).collect()}
    assert set(got) == set(itertools.combinations(sorted(by), 2))
    for (a, b), r in got.items():
        want = brute_metric(name, by[a], by[b], {k for p in by.values() for k in p})
        value = r["similarity"] if name in pairs.SIMILARITIES else r["distance"]
        assert abs(value - want) < 1e-9, (a, b)
        expected = max(0, 1 - r["distance"] / 2) if name == "euclidean" else 1 - r["distance"]
        assert abs(r["similarity"] - expected) < 1e-12


@pytest.mark.parametrize("name", pairs.METRICS)
@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.5, 0.9])
def test_thresholded_join_equals_all_pairs(spark, name, threshold):
    rng = random.Random(11)
    rows = []
    for i in range(24):
        own = {f"k{int(40 * rng.random() ** 3):02}": rng.randrange(1, 9) for _ in range(rng.randrange(1, 25))} | {f"own{i // 3}_{j}": rng.randrange(1, 30) for j in range(rng.randrange(4))}
        rows += [(f"s{i:02}", k, c, sum(own.values())) for k, c in own.items()]
    prof = spark.createDataFrame(rows, PROFILE)
    for p in (prof, prof.where("kmer <> 'k00'")):  # the second's totals are larger than its sums
        assert sorted(map(tuple, pairs.similar(p, name, threshold).collect())) == sorted(map(tuple, pairs.above(pairs.pairwise(p, name), threshold).collect()))
    assert pairs.similar(prof.limit(0), name, threshold).count() == 0


def test_thresholded_join_leaves_frequent_kmers_out(spark):
    """30 pairs of alike samples that all share 20 frequent k-mers: few rows meet."""
    rows = []
    for i in range(60):
        own = {f"all{j}": 2 for j in range(20)} | {f"pair{i // 2}_{j}": 3 for j in range(30)} | {f"own{i}_{j}": 1 for j in range(5)}
        rows += [(f"s{i:02}", k, c, sum(own.values())) for k, c in own.items()]
    prof = spark.createDataFrame(rows, PROFILE)
    everything = prof.groupBy("kmer").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    ranked = prof.join(prof.groupBy("kmer").agg(F.count("*").alias("df")), "kmer")
    cuts = pairs.cutoffs(ranked, pairs.sample_sums(prof), "braycurtis", 0.5, 1.0)
    assert pairs.prefix_join(ranked, cuts).count() == 30 * 30 < everything / 30
    assert pairs.similar(prof, "braycurtis", 0.5).count() == 30


def test_known_profiles(spark):
    p1 = {"A": {"ATG": 3, "TGC": 3, "GCA": 4}, "B": {"ATG": 2, "TGC": 4, "GCA": 4}, "C": {"ATG": 1, "TGC": 1, "XXX": 8}}
    prof = spark.createDataFrame([(s, k, c, 10) for s, p in p1.items() for k, c in p.items()], PROFILE)
    value = lambda name, col: [round(r[col], 6) for r in pairs.pairwise(prof, name).orderBy("sample_a", "sample_b").collect()]
    assert value("braycurtis", "distance") == [0.1, 0.8, 0.8]
    assert value("jaccard", "similarity") == [1.0, 0.5, 0.5]
    assert value("manhattan", "distance") == [0.2, 1.6, 1.6]
    assert value("weighted_jaccard", "similarity") == [0.818182, 0.111111, 0.111111]
    assert value("cosine", "similarity") == [0.971825, 0.12666, 0.123091]
    assert value("euclidean", "distance") == [0.141421, 0.938083, 0.948683]
    names, gram = matrix.profile_gram(prof)
    _, ratio = matrix.pca_from_gram(gram)
    assert names == ["A", "B", "C"] and np.allclose(ratio, [0.983429, 0.016571], atol=1e-6)
    assert pairs.compare_two(prof, "A", "C") == 0.5 and pairs.compare_two(prof, "A", "A") == 1.0
    for bad in (("A", "Q", "jaccard"), ("A", "B", "nothing")):
        with pytest.raises(ValueError):
            pairs.compare_two(prof, *bad)
    with pytest.raises(ValueError):
        pairs.pairwise(prof, "nothing")


def test_summaries(spark):
    p = pair_frame(spark, FIXTURES["M3"])
    s = pairs.similarity_structure(p).first()
    assert [round(s[c], 6) for c in ("mean_similarity", "median_similarity", "std_similarity", "q25_similarity", "q75_similarity")] == [0.4, 0.2, 0.355903, 0.125, 0.725]
    assert s["similarity_pattern"] == "mixed"
    t = pairs.similarity_summary(p, 4, 0.1).first()
    assert (t["n_significant_pairs"], t["total_possible_pairs"]) == (4, 6) and abs(t["sparsity"] - 1 / 3) < 1e-12
    hist = pairs.distance_histogram(p, 4).orderBy("bin").collect()
    assert [r["n"] for r in hist] == [2, 0, 0, 4]
    top = pairs.top_neighbours(p, 1).collect()
    assert {(r["sample"], r["other"]) for r in top} == {("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")}
    wide = {r["sample"]: r for r in pairs.square(p, spark.createDataFrame([(x,) for x in "ABCD"], "sample string")).collect()}
    assert wide["A"]["A"] == 0 and wide["B"]["C"] == wide["C"]["B"] == 0.9
    assert pairs.distance_histogram(p.where("distance = 0.1"), 3).agg(F.sum("n")).first()[0] == 2
    over = pairs.distance_overview(p, 4).first()
    full = np.zeros((4, 4))
    for (i, j), d in zip(itertools.combinations(range(4), 2), FIXTURES["M3"], strict=True):
        full[i, j] = full[j, i] = d
    assert abs(over["mean"] - full.mean()) < 1e-9 and abs(over["std"] - full.std()) < 1e-9


def test_clusters_of_samples(spark):
    p = pair_frame(spark, FIXTURES["M3"])
    samples = spark.createDataFrame([(x,) for x in "ABCDE"], "sample string")
    assert {tuple(r["samples"]) for r in graph.sample_clusters(samples, p, 0.5).collect()} == {("A", "B"), ("C", "D")}
    assert graph.sample_clusters(samples, p, 0.5, min_cluster_size=1).count() == 3


@pytest.mark.parametrize("name", FIXTURES)
def test_permanova_and_silhouette(spark, name):
    p = pair_frame(spark, FIXTURES[name])
    groups = spark.createDataFrame([("g", s, "X" if s in "AB" else "Y") for s in "ABCD"] + [("one", s, "same") for s in "ABCD"], "variable string, sample string, value string")
    f1, r1, f2, r2, sil = EXPECTED[name]
    std, simple = (stats.permanova(p, groups, 49, v).collect() for v in ("standard", "simple"))
    assert len(std) == len(simple) == 1  # a variable with one value is left out
    assert abs(std[0]["f_statistic"] - f1) < 1e-5 and abs(std[0]["r_squared"] - r1) < 1e-6 and (std[0]["n_samples"], std[0]["n_groups"]) == (4, 2)
    assert abs(simple[0]["f_statistic"] / f2 - 1) < 1e-6 and abs(simple[0]["r_squared"] - r2) < 1e-6
    assert 1 / 50 <= std[0]["p_value"] <= 1 and 0 <= simple[0]["p_value"] <= 1
    again = stats.permanova(p.repartition(3), groups.repartition(2), 49).first()
    assert again["p_value"] == std[0]["p_value"]
    labels = groups.where("variable = 'g'").select("sample", F.col("value").alias("label"))
    assert abs(stats.silhouette(p, labels).agg(F.avg("silhouette")).first()[0] - sil) < 1e-6


def test_permanova_without_degrees_of_freedom(spark):
    p = pair_frame(spark, FIXTURES["M1"])
    groups = spark.createDataFrame([("id", s, s) for s in "ABCD"], "variable string, sample string, value string")
    for variant in ("standard", "simple"):
        r = stats.permanova(p, groups, 9, variant).first()
        assert r["f_statistic"] is None and r["r_squared"] is None and r["p_value"] is None
    with pytest.raises(ValueError):
        stats.permanova(p, groups, 9, "other").count()


def test_variables_are_ranked(spark):
    p = pair_frame(spark, FIXTURES["M2"])
    meta = spark.createDataFrame([("A", "x", 1, None), ("B", "x", 2, None), ("C", "y", 3, "q"), ("D", "y", 4, None)], "sample string, site string, age int, note string")
    done = stats.analyze_variables(p, meta, n_permutations=9).orderBy("rank").collect()
    assert done[0]["variable"] == "site" and {r["variable"] for r in done} == {"site", "age"}
    assert {r["variable"]: r["missing_count"] for r in stats.missing_counts(meta).collect()} == {"site": 0, "age": 0, "note": 3}
    assert [r["variable"] for r in stats.analyze_variables(p, meta, ["site", "nothing"], 9).collect()] == ["site"]


def test_binning_and_codes(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,)], "value double")
    lo, hi = np.percentile(range(20), [33, 67])
    got = stats.bin_numeric(df).collect()
    assert all(r["bin"] == (None if r["value"] is None else 0 if r["value"] < lo else 1 if r["value"] < hi else 2) for r in got)
    few = spark.createDataFrame([(1.5,), (2.5,)], "value double")
    assert [r["bin"] for r in stats.bin_numeric(few).collect()] == [1.5, 2.5]
    assert [(r["value"], r["code"]) for r in stats.label_encode(spark.createDataFrame([("b",), ("a",), (None,)], "value string")).orderBy(F.col("value").asc_nulls_last()).collect()] == [("a", 0), ("b", 1), (None, None)]


def test_adjusted_rand(spark):
    make = lambda xs, c: spark.createDataFrame(list(enumerate(xs)), f"sample int, {c} string")
    ari = lambda x, y: stats.adjusted_rand(make(x, "label"), make(y, "value")).first()["ari"]
    assert ari("aabb", "xxyy") == 1.0 and ari("aabb", "yyxx") == 1.0 and abs(ari("aabb", "xyxy") + 0.5) < 1e-9 and ari("aaaa", "xxxx") == 1.0


def test_numeric_agreement(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "sample int, label string")
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 9.0), (3, 10.0)], "sample int, value double")
    want = np.corrcoef([1, 2, 9, 10], [1.5, 1.5, 9.5, 9.5])[0, 1] ** 2
    assert abs(stats.numeric_agreement(labels, values).first()["r_squared"] - want) < 1e-9


def test_lsh(spark):
    rng = random.Random(5)
    base = [rng.randrange(1 << 40) for _ in range(400)]
    rows = []
    for i in range(6):
        own = base[: 400 - 40 * i] if i < 4 else [rng.randrange(1 << 40) for _ in range(300)]
        rows += [(f"s{i}", k, 1, len(own)) for k in own]
    prof = spark.createDataFrame(rows, "sample string, kmer long, cnt long, total long")
    got = {(r["sample_a"], r["sample_b"]): r["similarity"] for r in lsh.lsh_similarities(prof, 0.5).collect()}
    assert set(got) == set(itertools.combinations(["s0", "s1", "s2", "s3"], 2))
    assert all(abs(v - (400 - 40 * int(b[1])) / (400 - 40 * int(a[1]))) < 0.15 for (a, b), v in got.items())
    assert lsh.choose_method(501) == "lsh" and lsh.choose_method(20) == "exact" and lsh.choose_method(20, 100) == "lsh"


def test_lsh_query_finds_all_pairs_above_its_threshold(spark, tmp_path):
    """Texts that share little: every pair whose 128 hashes agree in more than a tenth is found."""
    rng = random.Random(31)
    stock = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(40)]
    rows = [(i, "n".join(rng.sample(stock, 10)), f"l{i}", "web", 600) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    signed = {r["sample"]: r["signature"] for r in lsh.signatures(queries.counts(spark, str(tmp_path))).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(signed), 2):
        same = sum(x == y for x, y in zip(signed[a], signed[b], strict=True)) / 128
        if same > 0.1:
            want[a, b] = same
    assert len(want) > 50
    assert {(r["sample_a"], r["sample_b"]): r["similarity"] for r in queries.lsh_pairs(spark, str(tmp_path)).collect()} == want


def test_ordination():
    d = np.zeros((4, 4))
    for (i, j), x in zip(itertools.combinations(range(4), 2), FIXTURES["M1"], strict=True):
        d[i, j] = d[j, i] = x
    _, values = matrix.pcoa(d)
    assert np.allclose(values, [0.573331, 0.117826, 0.038844, 0], atol=1e-6)
    points = np.array([[0, 0], [3, 0], [0, 4.0]])
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    found, _ = matrix.pcoa(apart)
    assert np.allclose(np.sqrt(((found[:, None] - found[None]) ** 2).sum(2)), apart)


@pytest.mark.parametrize("method", ["average", "ward", "single", "complete"])
def test_linkage(method):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (5, 2)) for c in (0, 5, 10)])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    merges = matrix.linkage(d, method)
    assert len(merges) == 14 and merges[-1][3] == 15
    assert matrix.cut(merges, 15, 3).tolist() == [0] * 5 + [1] * 5 + [2] * 5
    assert matrix.best_cut(d, merges) == 3 and matrix.silhouette_score(d, matrix.cut(merges, 15, 3)) > 0.9
    assert matrix.kmeans(points, 3).tolist() == [0] * 5 + [1] * 5 + [2] * 5
    with pytest.raises(ValueError):
        matrix.linkage(d, "other")


def test_ward_heights():
    points = np.array([0.0, 1.0, 5.0])
    merges = matrix.linkage(np.abs(points[:, None] - points[None]), "ward")
    assert merges[0][:3] == (0, 1, 1.0) and abs(merges[1][2] - math.sqrt((2 * 25 + 2 * 16 - 1) / 3)) < 1e-12


def test_identify_clusters(spark):
    p = pair_frame(spark, (0.1, 0.8, 0.9, 0.85, 0.9, 0.9, 0.8, 0.9, 0.1, 0.5, 0.6, 0.55, 0.7, 0.1, 0.2), "ABCDEF")
    for variant in ("standard", "simple"):
        labels, scores, best = clusters.identify_clusters(spark, p, 2, 4, variant)
        assert {(r["method"], r["k"]) for r in scores.collect()} == {(m, k) for m in ("kmeans", "hierarchical") for k in (2, 3, 4)}
        assert labels.count() == 36 and best.count() == 2
    assert clusters.identify_clusters(spark, pair_frame(spark, (0.5,), "AB"), 2, 8, "simple")[1].count() == 0


def test_plot_tables(spark):
    p = pair_frame(spark, FIXTURES["M1"])
    samples = spark.createDataFrame([(x,) for x in "ABCD"], "sample string")
    assert plotdata.heatmap(p, samples).count() == 16 and plotdata.dendrogram(spark, p).count() == 3
    meta = spark.createDataFrame([("A", "x", 1.0), ("B", "x", 2.0), ("C", "y", 3.0), ("Q", None, 9.0)], "sample string, site string, age double")
    assert plotdata.colour_columns(meta) == ["site", "age"] and plotdata.only_samples(meta, samples).count() == 3
    points = ordination.as_table(spark, list("ABCD"), np.zeros((4, 2)))
    assert plotdata.coloured(points, meta, "site").where("value is null").count() == 1
    assert plotdata.hover_text(points, meta).where("sample = 'A'").first()["hover"] == "site: x<br>age: 1.0"
    results = spark.createDataFrame([("site", 0.01, 0.5), ("age", None, None)], "variable string, p_value double, r_squared double")
    assert [tuple(r) for r in plotdata.variable_importance(results).collect()] == [("site", 0.5, 2.0, "red")]


def test_missing_pairs_are_not_identical(spark):
    found = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.2)], "sample_a string, sample_b string, distance double")
    with pytest.raises(ValueError, match="1 pairs"):
        matrix.collect_matrix(found)
    assert matrix.collect_matrix(found, missing=1.0)[1].tolist() == [[0.0, 0.1, 0.2], [0.1, 0.0, 1.0], [0.2, 1.0, 0.0]]


def test_mds_and_tsne():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.1, (12, 2)), rng.normal(5, 0.1, (12, 2))])
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    placed, stress = matrix.mds(apart)
    again = np.sqrt(((placed[:, None] - placed[None]) ** 2).sum(2))
    assert stress < 1e-6 and np.abs(again - apart).max() < 1e-3
    # a non-Euclidean matrix: majorisation never ends worse than the classical solution
    odd = apart**0.3
    start = matrix.pcoa(odd)[0]
    first = (np.sqrt(((start[:, None] - start[None]) ** 2).sum(2)) - odd) ** 2
    assert matrix.mds(odd)[1] <= first.sum() / 2 + 1e-9
    shares = matrix.neighbour_shares(apart, 5.0)
    assert abs(shares.sum() - 1) < 1e-9 and np.allclose(shares, shares.T)
    flat = matrix.tsne(apart, perplexity=5.0)
    far = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(2))
    assert far[:12, :12].max() < far[:12, 12:].min()
    assert matrix.tsne(np.zeros((2, 2))).shape[0] == 2 and matrix.mds(np.zeros((1, 1)))[1] == 0.0


def test_squared_distances_equal_brute_force():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(4, 5))
    assert np.allclose(matrix.squared_distances(a, b), ((a[:, None] - b[None]) ** 2).sum(2))


def random_pairs(spark, n, seed, flat=False):
    """Distances of points (``flat``) or any numbers, as a table and a matrix."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 5)) + rng.integers(0, 3, (n, 1)) * 4
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)) if flat else rng.random((n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0.0)
    names = [f"s{i:03}" for i in range(n)]
    rows = [(names[i], names[j], float(d[i, j]), float(1 - d[i, j])) for i in range(n) for j in range(i + 1, n)]
    return d, names, spark.createDataFrame(rows, "sample_a string, sample_b string, distance double, similarity double")


@pytest.mark.parametrize("flat", [True, False])
def test_principal_coordinates_equal_the_square_matrix(spark, flat):
    d, names, p = random_pairs(spark, 70, 2, flat)
    found, coordinates, values = ordination.pcoa(p, 3)
    axes, all_values = matrix.pcoa(d, 3)
    assert found == names and np.allclose(values, all_values[:3], rtol=1e-9) and np.abs(coordinates - axes).max() < 1e-6
    with pytest.raises(ValueError, match="1 pairs"):
        ordination.pcoa(p.where("sample_a <> 's000' or sample_b <> 's001'"))
    d[0, 1] = d[1, 0] = 0.7
    _, coordinates, _ = ordination.pcoa(p.where("sample_a <> 's000' or sample_b <> 's001'"), 2, missing=0.7)
    assert np.abs(coordinates - matrix.pcoa(d, 2)[0]).max() < 1e-6
    assert ordination.pcoa(p.limit(0))[0] == []


def test_principal_components_equal_the_gram_matrix(spark):
    _, prof = random_profiles(spark, 40, 5)
    names, scores, ratio = ordination.pca(prof, 3)
    own, gram = matrix.profile_gram(prof)
    want, want_ratio = matrix.pca_from_gram(gram, 3)
    assert names == own and np.abs(scores - want).max() < 1e-6 and np.allclose(ratio, want_ratio)


def test_eigenpairs_of_a_large_matrix_take_few_products():
    rng = np.random.default_rng(6)
    vectors = np.linalg.qr(rng.normal(size=(800, 800)))[0]
    values = np.concatenate([[90, 70, 50], rng.uniform(-8, 10, 797)])
    seen = []
    found, axes = ordination.top_eigenpairs(lambda x: seen.append(x.shape[1]) or vectors @ (values[:, None] * (vectors.T @ x)), 800, 3)
    assert np.allclose(found, [90, 70, 50]) and np.abs(np.abs((axes * vectors[:, :3]).sum(0)) - 1).max() < 1e-8 and sum(seen) < 200


@pytest.mark.parametrize("method", ["average", "ward", "single", "complete"])
@pytest.mark.parametrize("flat", [True, False])
def test_agglomeration_equals_the_sequential_one(spark, method, flat):
    d, names, p = random_pairs(spark, 14, 3, flat)
    found, merges = clusters.agglomerate(p, method)
    want = matrix.linkage(d, method)
    assert found == names and [m[:2] + m[3:] for m in merges] == [m[:2] + m[3:] for m in want]
    assert np.allclose([m[2] for m in merges], [m[2] for m in want])


def test_agglomeration_of_ties_and_small_tables(spark):
    names, merges = clusters.agglomerate(pair_frame(spark, (1.0,) * 6), "average")
    assert len(merges) == 3 and {m[2] for m in merges} == {1.0} and merges[-1][3] == 4
    assert clusters.agglomerate(pair_frame(spark, (1.0,) * 6).limit(0), "ward") == ([], [])
    with pytest.raises(ValueError):
        clusters.agglomerate(pair_frame(spark, (1.0,) * 6).limit(5))
    with pytest.raises(ValueError):
        clusters.agglomerate(pair_frame(spark, (1.0,) * 6), "other")


def test_cluster_scores_equal_brute_force(spark):
    d, names, p = random_pairs(spark, 18, 4, True)
    labels, scores, best = clusters.identify_clusters(spark, p, 2, 3)
    points = matrix.pcoa(d, 10)[0]
    apart = np.sqrt(matrix.squared_distances(points, points))
    np.fill_diagonal(apart, 0.0)
    score = {(r["method"], r["k"]): r["silhouette"] for r in scores.collect()}
    for method, k in score:
        own = {r["sample"]: r["label"] for r in labels.where(f"method = '{method}' and k = {k}").collect()}
        found = np.array([own[s] for s in names])
        assert abs(score[method, k] - matrix.silhouette_score(apart if method == "kmeans" else d, found)) < 1e-9
        assert method == "kmeans" or found.tolist() == matrix.cut(matrix.linkage(d, "average"), 18, k).tolist()
        inertia = lambda x: sum(((points[x == c] - points[x == c].mean(0)) ** 2).sum() for c in set(x.tolist()))
        assert method != "kmeans" or inertia(found) <= 1.1 * inertia(matrix.kmeans(points, k))
    assert {r["method"]: r["silhouette"] for r in best.collect()} == {m: max(v for (n, _), v in score.items() if n == m) for m in ("kmeans", "hierarchical")}
    merges = matrix.linkage(d, "ward")
    assert clusters.best_cut(p, names, merges) == matrix.best_cut(d, merges)


def test_disjoint_groups_equal_one_pass_in_order(spark):
    rng = random.Random(9)
    for _ in range(4):
        rows = [(f"g{i:02}", rng.sample("abcdefghijklmnop", rng.randrange(1, 5)), rng.choice([0.1, 0.5, 0.9, None])) for i in range(25)]
        used, want = set(), []
        for g, s, _ in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
            if not used & set(s):
                used |= set(s)
                want.append(g)
        frame = spark.createDataFrame(rows, "group_id string, sample_names array<string>, confidence double")
        assert [r["group_id"] for r in recommend.pick_disjoint(frame).collect()] == want
    assert recommend.pick_disjoint(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [1, 1 << 16])
def test_pair_sums_equal_brute_force_without_joined_rows(spark, monkeypatch, dense):
    monkeypatch.setattr(pairs, "ROWS", 50)
    monkeypatch.setattr(pairs, "DENSE", dense)
    rng = random.Random(5)
    own = {f"s{i:02}": {k: rng.randrange(1, 50) for k in range(60) if rng.random() < 0.6} for i in range(20)}
    total = {s: sum(x.values()) for s, x in own.items()}
    kernel = pa.table({c: list(v) for c, v in zip(("sample", "kmer", "cnt", "total"), zip(*sorted(((s, k, c, total[s]) for s, x in own.items() for k, c in x.items()), key=lambda r: r[1]), strict=True), strict=True)})
    got: dict = {}
    for batch in pairs.summed(kernel, True, pairs.PARTS):
        for a, b, *sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            got[a, b] = [x + y for x, y in zip(got.get((a, b), [0] * 4), sums, strict=True)]
    want = {}
    for a, b in itertools.combinations(sorted(own), 2):
        both = [(own[a][k] * total[b], own[b][k] * total[a], own[a][k] * own[b][k]) for k in own[a].keys() & own[b].keys()]
        want[a, b] = [len(both), sum(min(x, y) for x, y, _ in both), sum(p for *_, p in both), sum(x == y for x, y, _ in both)]
    assert got == want
    sums = pairs.pair_sums(spark.createDataFrame(kernel.to_pandas()))
    assert {(r[0], r[1]): list(r[2:]) for r in sums.collect()} == want
    assert "Join" not in sums._jdf.queryExecution().executedPlan().toString()


def test_pair_sums_of_large_counts_stay_whole_numbers_or_fail(spark):
    rows = lambda c, t: pa.table({"sample": ["a", "b"] * 3, "kmer": [1, 1, 2, 2, 3, 3], "cnt": [c] * 6, "total": [t] * 6})
    batches = list(pairs.summed(rows(2**31 + 1, 2**30), True, ("m",)))
    assert sum(x for b in batches for x in b.column(2).to_pylist()) == 3 * (2**31 + 1) * 2**30
    for c, t in ((2**32, 2**32), (2**32, 2**30 + 2**29)):
        with pytest.raises(ArithmeticError):
            list(pairs.summed(rows(c, t), True, ("m",)))
