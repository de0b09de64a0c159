"""All-pairs sample metrics from one pass over the profile by k-mer.

For samples a and b only the k-mers that both have are paired; everything else follows from per-sample sums.  Sums are of
integers (counts scaled by the other sample's total), so results do not depend on the order of summation; ``exact=False``
uses doubles where ``cnt * total`` could pass 64 bits (with ANSI arithmetic Spark fails rather than overflow).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep, once

METRICS = ("jaccard", "weighted_jaccard", "cosine", "braycurtis", "euclidean", "manhattan", "hamming")
SIMILARITIES = ("jaccard", "weighted_jaccard", "cosine")


def sample_list(prof: DataFrame) -> DataFrame:
    """``sample, idx``: the samples in order, numbered from 1."""
    return prof.select("sample").distinct().withColumn("idx", F.row_number().over(Window.orderBy("sample")))


def every_pair(samples: DataFrame) -> DataFrame:
    """``sample_a, sample_b`` with a < b, as an equi-join on sample numbers."""
    n = samples.agg(F.max("idx").alias("n"))
    left = samples.join(F.broadcast(n)).where("idx < n").select(F.col("sample").alias("sample_a"), F.explode(F.sequence(F.col("idx") + 1, F.col("n"))).alias("other"))
    return left.join(samples.select(F.col("sample").alias("sample_b"), F.col("idx").alias("other")), "other").drop("other")


def completed(found: DataFrame, prof: DataFrame, similarity: float = 0.0) -> DataFrame:
    """All pairs of samples, ``sample_a, sample_b, distance, similarity``; those that are not in ``found`` have ``similarity``."""
    known = found.select("sample_a", "sample_b", F.col("similarity").alias("known"))
    s = F.coalesce("known", F.lit(similarity))
    return every_pair(sample_list(prof)).join(known, ["sample_a", "sample_b"], "left").select("sample_a", "sample_b", (1 - s).alias("distance"), s.alias("similarity"))


PARTS = ("inter", "m", "p", "e")
NEEDED = {"jaccard": ("inter",), "cosine": ("p",), "euclidean": ("p",), "hamming": ("inter", "e")}
ROWS, DENSE, SAFE = 100_000, 1 << 16, 2.0**63 * (1 - 1e-9)


def pair_sums(prof: DataFrame, exact: bool = True, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Sums over shared k-mers: ``inter``, ``m`` (sum of minima), ``p`` (of products), ``e`` (equal frequencies).

    ``m`` and ``e`` are over counts scaled to the common denominator ``total_a * total_b``.  A profile has one row for a
    sample and k-mer.  Rows are dealt and sorted by k-mer once; a task pairs and sums the rows of each k-mer in numpy, a
    batch at a time, so pairs of rows are never rows of a table.  Only ``parts`` are summed.
    """
    kind = "long" if exact else "double"
    rows = prof.where("sample is not null and kmer is not null").select("sample", "kmer", F.col("cnt").cast(kind).alias("cnt"), F.col("total").cast(kind).alias("total"))
    kinds = dict(rows.dtypes)
    number = {"inter": "long", "e": "long"} | dict.fromkeys(("m", "p"), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                rows = pa.Table.from_batches(held)
                keys = rows.column("kmer")
                # the last k-mer may go on in the next batch
                low, high = 0, rows.num_rows - 1
                while low < high:
                    middle = (low + high) // 2
                    low, high = (low, middle) if keys[middle] == keys[-1] else (middle + 1, high)
                if low:
                    yield from summed(rows.slice(0, low), exact, parts)
                held = rows.slice(low).combine_chunks().to_batches()
        if held:
            yield from summed(pa.Table.from_batches(held), exact, parts)

    found = rows.repartition("kmer").sortWithinPartitions("kmer").mapInArrow(run, f"sample_a {kinds['sample']}, sample_b {kinds['sample']}, " + ", ".join(f"{c} {number[c]}" for c in parts))
    return found.groupBy("sample_a", "sample_b").agg(*[F.sum(c).alias(c) for c in parts])


def summed(rows: pa.Table, exact: bool, parts: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The sums of :func:`pair_sums` over rows that are sorted by k-mer: each row is paired with the next of its k-mer, the next but one, and so on.

    Pairs of few samples are summed in one array; it is sent and cleared before a sum could pass 64 bits.
    """
    words = rows.column("sample").combine_chunks().dictionary_encode()
    order = np.array(sorted(range(len(words.dictionary)), key=lambda i: words.dictionary[i].as_py()), dtype=np.int64)
    n, rank = len(order), np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(n)
    sample, names = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order))
    kmer = rows.column("kmer").combine_chunks().dictionary_encode().indices.to_numpy()
    cnt, total = (rows.column(c).to_numpy() for c in ("cnt", "total"))
    dense = n * n <= DENSE
    kinds = {c: np.int64 if exact or c in ("inter", "e") else np.float64 for c in {*parts, "inter"}}
    sums, whole = {c: np.zeros(n * n, dtype=kind) for c, kind in kinds.items()} if dense else {}, dict.fromkeys(kinds, 0.0)

    def made(codes: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
        a, b = (names.take(pa.array(x)) for x in (codes // n, codes % n))
        return pa.RecordBatch.from_arrays([a, b, *[pa.array(values[c]) for c in parts]], ["sample_a", "sample_b", *parts])

    def sent() -> pa.RecordBatch:
        codes = np.flatnonzero(sums["inter"])
        out = made(codes, {c: sums[c][codes] for c in parts})
        for c in sums:
            sums[c][:], whole[c] = 0, 0.0
        return out

    at, lag = np.arange(len(kmer)), 1
    while True:
        at = at[: np.searchsorted(at, len(kmer) - lag)]
        at = at[kmer[at + lag] == kmer[at]]
        if not len(at):
            break
        i, j = at, at + lag
        lag += 1
        code = np.minimum(sample[i], sample[j]) * n + np.maximum(sample[i], sample[j])
        values = {"inter": np.ones(len(i), dtype=np.int64)}
        if "m" in parts or "e" in parts:
            x, y = _product(cnt[i], total[j]), _product(cnt[j], total[i])
            values |= {"m": np.minimum(x, y), "e": (x == y).astype(np.int64)}
        if "p" in parts:
            values["p"] = _product(cnt[i], cnt[j])
        added = {c: values[c].sum(dtype=np.float64) for c in kinds}
        if exact and max(added.values()) >= SAFE:
            codes, own = np.unique(code, return_inverse=True)
            if max(np.bincount(own, weights=values[c]).max() for c in kinds) >= SAFE:
                raise ArithmeticError("sums of counts times totals pass 64 bits; use exact=False")
        if not dense:
            by = np.argsort(code, kind="stable")
            new = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0])
            yield made(code[by][new], {c: np.add.reduceat(values[c][by], new) for c in parts})
            continue
        if exact and max(whole[c] + added[c] for c in kinds) >= SAFE:
            yield sent()
        for c in kinds:
            np.add.at(sums[c], code, values[c])
            whole[c] += added[c]
    if dense:
        yield sent()


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product; ``ArithmeticError`` where one of whole numbers passes 64 bits."""
    if x.dtype == np.int64 and float(x.max()) * float(y.max()) >= SAFE and (x.astype(np.float64) * y).max() >= SAFE:
        raise ArithmeticError("counts times totals pass 64 bits; use exact=False")
    return x * y


def sample_sums(prof: DataFrame, exact: bool = True) -> DataFrame:
    """Per sample: ``n`` k-mers, ``s`` and ``q``, the sums of counts and of their squares, and ``t``, the total."""
    c = F.col("cnt").cast("long" if exact else "double")
    return prof.groupBy("sample").agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("q"), F.max("total").cast("long" if exact else "double").alias("t"))


def pair_table(prof: DataFrame, exact: bool = True, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row for every two samples with all sums, zeros for samples without a shared k-mer.  The profile is evaluated once."""
    prof = once(prof, "profile")
    sums = sample_sums(prof, exact)
    side = lambda s: sums.select(F.col("sample").alias(f"sample_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "s", "q", "t")])
    pairs = every_pair(sample_list(prof)).join(pair_sums(prof, exact, parts), ["sample_a", "sample_b"], "left").na.fill(0, list(parts))
    return pairs.join(side("a"), "sample_a").join(side("b"), "sample_b")


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise))


def metric(name: str, n_vocabulary: Column | None = None) -> Column:
    """A metric over the columns of :func:`pair_table`: similarities for jaccard, weighted_jaccard and cosine, distances else."""
    c = F.col
    both = c("s_a") * c("t_b") + c("s_b") * c("t_a")
    if name == "jaccard":
        return _ratio(c("inter"), c("n_a") + c("n_b") - c("inter"))
    if name == "weighted_jaccard":
        return _ratio(c("m"), both - c("m"))
    if name == "cosine":
        return _ratio(c("p").cast("double"), F.sqrt(c("q_a").cast("double") * c("q_b").cast("double")))
    if name == "braycurtis":
        return _ratio(both - 2 * c("m"), both)
    if name == "manhattan":
        return _ratio(both - 2 * c("m"), c("t_a") * c("t_b"))
    if name == "euclidean":
        d = lambda x: x.cast("double")
        square = d(c("q_a")) / (d(c("t_a")) * d(c("t_a"))) + d(c("q_b")) / (d(c("t_b")) * d(c("t_b"))) - 2 * d(c("p")) / (d(c("t_a")) * d(c("t_b")))
        return F.sqrt(F.greatest(F.lit(0.0), square))
    if name == "hamming":
        return _ratio(c("n_a") + c("n_b") - c("inter") - c("e"), n_vocabulary)
    raise ValueError(f"unknown metric: {name}; one of {', '.join(METRICS)}")


def pairwise(prof: DataFrame, name: str = "braycurtis", exact: bool = True) -> DataFrame:
    """``sample_a, sample_b, distance, similarity`` of every two samples.

    Similarity is 1 - distance; for euclidean max(0, 1 - distance / 2).  Two samples without any shared k-mer have
    similarity 0 in all metrics that are similarities by definition.
    """
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}; one of {', '.join(METRICS)}")
    prof = once(prof, "profile")
    table = pair_table(prof, exact, NEEDED.get(name, ("m",)))
    if name == "hamming":
        table = table.join(F.broadcast(prof.agg(F.countDistinct("kmer").alias("n_vocabulary"))))
    return _as_pairs(table, name, F.col("n_vocabulary"))


PREFIX_METRICS = ("jaccard", "weighted_jaccard", "cosine", "braycurtis", "manhattan")


def cutoffs(ranked: DataFrame, sums: DataFrame, name: str, threshold: float, least: float) -> DataFrame:
    """``sample, cutoff, rest``: a sample's k-mers that occur in ``cutoff`` samples or more are too light to make, alone,
    any pair similar; ``rest`` is their share of what the metric sums up.

    ``ranked`` is a profile with ``df``, the number of samples of the k-mer.  Weights are summed by (sample, df), so no
    sample's k-mers are sorted.  ``least`` is the smallest ratio ``s / t`` of any sample.
    """
    c = F.col("cnt").cast("double")
    weight = {"jaccard": F.lit(1.0), "cosine": c * c}.get(name, c)
    whole = sums.withColumn("r", F.col("s") / F.col("t"))
    both = F.col("r") + F.lit(least)  # of a pair, in units of the product of their totals, at least
    of_total = {
        "jaccard": F.lit(threshold) * F.col("n"), "cosine": F.lit(threshold * threshold) * F.col("q"), "weighted_jaccard": F.lit(threshold / (1 + threshold)) * both * F.col("t"),
        "braycurtis": F.lit(threshold / 2) * both * F.col("t"), "manhattan": F.greatest(both - (1 - threshold), F.lit(0.0)) / 2 * F.col("t"),
    }[name]
    levels = ranked.groupBy("sample", "df").agg(F.sum(weight).alias("w"))
    upto = levels.withColumn("upto", F.sum("w").over(Window.partitionBy("sample").orderBy(F.col("df").desc())))
    bounded = upto.join(whole.select("sample", (of_total * (1 - 1e-9)).alias("most")), "sample")
    light = F.col("upto") <= F.col("most")
    return bounded.groupBy("sample").agg(F.min(F.when(light, F.col("df"))).alias("cutoff"), F.max(F.when(light, F.col("upto"))).alias("rest")).select(
        "sample", F.coalesce("cutoff", F.lit(1 << 62)).alias("cutoff"), F.coalesce("rest", F.lit(0.0)).alias("rest")
    )


def before_cutoffs(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """The k-mers of each sample before its cutoff."""
    return ranked.join(cuts.select("sample", "cutoff"), "sample").where("df < cutoff")


def prefix_join(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of the join on shared k-mers that can bring a similar pair together: both samples hold the k-mer before their cutoff."""
    rows = before_cutoffs(ranked, cuts)
    side = lambda s: rows.select(F.col("sample").alias(f"sample_{s}"), "kmer", F.col("cnt").alias(f"c{s}"), F.col("total").alias(f"t{s}"))
    return side("a").join(side("b"), "kmer").where("sample_a < sample_b")


def similar(prof: DataFrame, name: str = "braycurtis", threshold: float = 0.1, exact: bool = True) -> DataFrame:
    """The pairs of :func:`pairwise` with similarity above ``threshold``, without the join on frequent k-mers.

    K-mers are ordered by the number of samples they are in.  If two samples are similar, the rarest k-mer that both hold
    lies before the cutoffs of both, so the join on k-mers before the cutoffs finds every similar pair; sums over those
    k-mers bound its similarity from above, and only pairs that pass are completed, by the k-mers behind the smaller of
    their cutoffs.  ``euclidean``, ``hamming`` and, where profiles are filtered, ``manhattan`` distances may be small without
    any shared k-mer: they take all pairs.  So do profiles of which most pairs of rows lie before the cutoffs, or whose
    candidates' completion would cost more than all pairs; the result is the same.
    """
    prof = once(prof, "profile")
    sums = sample_sums(prof, exact)
    least = sums.agg(F.min(F.col("s") / F.col("t"))).first()[0] or 0.0
    if name not in PREFIX_METRICS or threshold < 0 or (name == "manhattan" and 2 * least < 1 - threshold):
        return above(pairwise(prof, name, exact), threshold)
    kind = "long" if exact else "double"
    whole_profile, prof = prof, prof.select("sample", "kmer", F.col("cnt").cast(kind), F.col("total").cast(kind))
    ranked = keep(prof.join(prof.groupBy("kmer").agg(F.count("*").alias("df")), "kmer").where("df > 1").select("sample", "kmer", "cnt", "total", "df"), "ranked")
    cuts = keep(cutoffs(ranked, sums, name, threshold, least), "cutoffs")
    before = before_cutoffs(ranked, cuts)
    everything = ranked.agg(F.sum(F.col("df") - 1)).first()[0] or 0  # twice the pairs of rows
    if 2 * (before.groupBy("kmer").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0) > everything:
        return above(pairwise(whole_profile, name, exact), threshold)
    x, y = F.col("ca") * F.col("tb"), F.col("cb") * F.col("ta")
    added = lambda rows: rows.groupBy("sample_a", "sample_b").agg(
        F.count("*").alias("inter"), F.sum(F.least(x, y)).alias("m"), F.sum(F.col("ca") * F.col("cb")).alias("p"), F.sum((x == y).cast("long")).alias("e")
    )
    side = lambda s: sums.join(cuts, "sample").select(F.col("sample").alias(f"sample_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "s", "q", "t", "cutoff", "rest")])
    found = pair_sums(before, exact).join(side("a"), "sample_a").join(side("b"), "sample_b")
    # what the k-mers behind the smaller cutoff can add at most
    first = F.col("cutoff_a") <= F.col("cutoff_b")
    more, other = F.when(first, F.col("rest_a")).otherwise(F.col("rest_b")), F.when(first, F.col("t_b")).otherwise(F.col("t_a"))
    most = {"jaccard": ("inter", more), "cosine": ("p", F.sqrt(more * F.when(first, F.col("q_b")).otherwise(F.col("q_a"))))}.get(name, ("m", more * other))
    bound = metric(name) if name in SIMILARITIES else 1 - metric(name)
    candidates = keep(found.withColumn("own", F.col(most[0])).withColumn(most[0], F.col(most[0]) + most[1]).where(bound > threshold * (1 - 1e-9)).withColumn(most[0], F.col("own")).drop("own"), "candidates")
    holder, partner = F.when(first, F.col("sample_a")).otherwise(F.col("sample_b")), F.when(first, F.col("sample_b")).otherwise(F.col("sample_a"))
    asked = candidates.select("sample_a", "sample_b", holder.alias("sample"), partner.alias("partner"), first.alias("first"))
    behind = ranked.join(cuts.select("sample", "cutoff"), "sample").where("df >= cutoff").select("sample", "kmer", "cnt", "total")
    if 8 * (asked.join(behind.groupBy("sample").agg(F.count("*").alias("n")), "sample").agg(F.sum("n")).first()[0] or 0) > everything:
        return above(pairwise(whole_profile, name, exact), threshold)
    theirs = ranked.select(F.col("sample").alias("partner"), "kmer", F.col("cnt").alias("cnt2"), F.col("total").alias("total2"))
    both = asked.join(behind, "sample").join(theirs, ["partner", "kmer"])
    of = lambda a, b: F.when(F.col("first"), F.col(a)).otherwise(F.col(b))
    rest = added(both.select("sample_a", "sample_b", of("cnt", "cnt2").alias("ca"), of("total", "total2").alias("ta"), of("cnt2", "cnt").alias("cb"), of("total2", "total").alias("tb")))
    parts = ("inter", "m", "p", "e")
    whole = candidates.join(rest.select("sample_a", "sample_b", *[F.col(c).alias(f"{c}_more") for c in parts]), ["sample_a", "sample_b"], "left")
    whole = whole.withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}_more"), F.lit(0)) for c in parts})
    return above(_as_pairs(whole, name), threshold)


def _as_pairs(table: DataFrame, name: str, n_vocabulary: Column | None = None) -> DataFrame:
    value = metric(name, n_vocabulary)
    if name in SIMILARITIES:
        distance, similarity = 1 - value, value
    else:
        distance, similarity = value, F.greatest(F.lit(0.0), 1 - value / 2) if name == "euclidean" else 1 - value
    return table.select("sample_a", "sample_b", distance.alias("distance"), similarity.alias("similarity"))


def above(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pairs with similarity strictly above the threshold."""
    return pairs.where(F.col("similarity") > threshold)


def compare_two(prof: DataFrame, a: str, b: str, name: str = "jaccard") -> float:
    """Similarity of two named samples; ``ValueError`` for an unknown sample or metric."""
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    own = prof.where(F.col("sample").isin(a, b))
    if {r[0] for r in own.select("sample").distinct().collect()} != {a, b}:
        raise ValueError(f"unknown sample among {a}, {b}")
    return 1.0 if a == b else float(pairwise(own, name).first()["similarity"])


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair, as ``sample, other, distance, similarity``."""
    keep = ["distance", "similarity"]
    return pairs.select(F.col("sample_a").alias("sample"), F.col("sample_b").alias("other"), *keep).unionByName(
        pairs.select(F.col("sample_b").alias("sample"), F.col("sample_a").alias("other"), *keep)
    )


def both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    """Both directions of each pair, as ``sample, other`` and the columns ``values``."""
    return pairs.select(F.col("sample_a").alias("sample"), F.col("sample_b").alias("other"), *values).unionByName(
        pairs.select(F.col("sample_b").alias("sample"), F.col("sample_a").alias("other"), *values)
    )


def top_neighbours(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most similar others of each sample with similarity above 0, ties by name: ``sample, rank, other, similarity``."""
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.col("similarity").desc(), "other"))
    return mirrored(pairs).where("similarity > 0").select("sample", rank.alias("rank"), "other", "similarity").where(F.col("rank") <= n)


def similarity_summary(pairs: DataFrame, n_samples: int, threshold: float = 0.1) -> DataFrame:
    """One row over the pairs above the threshold: counts, sparsity, mean, spread, range and median."""
    kept, possible = above(pairs, threshold), n_samples * (n_samples - 1) // 2
    s = F.col("similarity")
    return kept.agg(
        F.lit(n_samples).cast("long").alias("n_samples"), F.count("*").alias("n_significant_pairs"), F.lit(possible).cast("long").alias("total_possible_pairs"),
        (F.lit(1.0) - F.count("*") / F.lit(max(1, possible))).alias("sparsity"), F.avg(s).alias("mean_similarity"), F.stddev_pop(s).alias("std_similarity"),
        F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"), F.percentile(s, 0.5).alias("median_similarity"),
    )


def similarity_structure(pairs: DataFrame, medium: float = 0.30) -> DataFrame:
    """One row over all pairs: mean, median, spread, range, quartiles and the pattern they make."""
    s = F.col("similarity")
    stats = pairs.agg(
        F.avg(s).alias("mean_similarity"), F.percentile(s, 0.5).alias("median_similarity"), F.stddev_pop(s).alias("std_similarity"),
        F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"), F.percentile(s, 0.25).alias("q25_similarity"), F.percentile(s, 0.75).alias("q75_similarity"),
    )
    pattern = (
        F.when(F.col("median_similarity") > 0.85, "very_high").when(F.col("median_similarity") > medium, "moderate").when(F.col("q75_similarity") > medium, "mixed").otherwise("low")
    )
    return stats.withColumn("similarity_pattern", pattern)


def distance_overview(pairs: DataFrame, n_samples: int) -> DataFrame:
    """Mean, spread, least positive and largest entry of the full square matrix, diagonal included."""
    d, n = F.col("distance"), F.lit(float(max(1, n_samples * n_samples)))
    mean = 2 * F.sum(d) / n
    return pairs.agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), 2 * F.sum(d * d) / n - mean * mean)).alias("std"), F.min(F.when(d > 0, d)).alias("min_positive"), F.max(d).alias("max"))


def distance_histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """``bin, low, high, n`` over equal bins from the least to the largest distance; the last bin holds its upper edge."""
    ends = pairs.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("distance") - F.col("lo")) / width), F.lit(bins - 1)))
    binned = pairs.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edges = ends.select("lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return edges.join(binned, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def square(pairs: DataFrame, samples: DataFrame, value: str = "distance", fill_missing: float | None = None) -> DataFrame:
    """The labelled square matrix: ``sample`` and one column per sample.  Only for sample counts that fit a table's width."""
    diagonal = 0.0 if value == "distance" else 1.0
    names = [r["sample"] for r in samples.select("sample").distinct().orderBy("sample").collect()]
    cells = mirrored(pairs).select("sample", "other", value).unionByName(samples.select("sample", F.col("sample").alias("other"), F.lit(diagonal).alias(value)).distinct())
    wide = cells.groupBy("sample").pivot("other", names).agg(F.first(value))
    return wide if fill_missing is None else wide.na.fill(fill_missing)


def matrix_correlation(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Pearson correlation of two tables of distances over their common pairs: ``r, n_pairs``."""
    both = pairs.select("sample_a", "sample_b", "distance").join(others.select("sample_a", "sample_b", F.col("distance").alias("other_distance")), ["sample_a", "sample_b"])
    return both.agg(F.corr("distance", "other_distance").alias("r"), F.count("*").alias("n_pairs"))
