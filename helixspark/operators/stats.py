"""Metadata statistics over a pair table: PERMANOVA, binning, agreement of clusters with metadata, silhouettes.

Pairs are ``sample_a, sample_b, distance`` with a < b.  Metadata in long form is ``variable, sample, value`` (a string).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep


def long_metadata(meta: DataFrame, variables: list[str] | None = None, id_col: str = "sample") -> DataFrame:
    """``variable, sample, value`` without nulls; unknown variables are left out."""
    names = [c for c in meta.columns if c != id_col and (variables is None or c in variables)]
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]) if names else F.array().cast("array<struct<variable:string,value:string>>")
    each = meta.select(F.col(id_col).alias("sample"), F.explode(cells).alias("x"))
    return each.select("x.variable", "sample", "x.value").where("value is not null")


def missing_counts(meta: DataFrame, id_col: str = "sample") -> DataFrame:
    """``variable, missing_count`` in one pass."""
    names = [c for c in meta.columns if c != id_col]
    row = meta.agg(F.array(*[F.struct(F.lit(c).alias("variable"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("missing_count")) for c in names]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def bin_numeric(values: DataFrame, col: str = "value", max_distinct: int = 10) -> DataFrame:
    """Add ``bin``: with more than ``max_distinct`` values 0, 1, 2 cut at the 33rd and 67th percentile, else the value."""
    cuts = values.agg(F.countDistinct(col).alias("__n"), F.percentile(F.col(col).cast("double"), F.array(F.lit(0.33), F.lit(0.67))).alias("__p"))
    v = F.col(col).cast("double")
    code = F.when(v < F.col("__p")[0], 0.0).when(v < F.col("__p")[1], 1.0).otherwise(2.0)
    return values.join(F.broadcast(cuts)).withColumn("bin", F.when(v.isNotNull(), F.when(F.col("__n") > max_distinct, code).otherwise(v))).drop("__n", "__p")


def label_encode(values: DataFrame, col: str = "value") -> DataFrame:
    """Add ``code``: the value's place among the distinct values, from 0."""
    codes = values.select(col).where(F.col(col).isNotNull()).distinct().withColumn("code", (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))
    return values.join(codes, col, "left")


def significance_code(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")


def permanova(pairs: DataFrame, groups: DataFrame, n_permutations: int = 999, variant: str = "standard", seed: int = 0) -> DataFrame:
    """PERMANOVA of each variable: ``variable, f_statistic, p_value, r_squared, n_samples, n_groups``.

    ``standard``: within and total sums of squared distances over unordered pairs, each divided by its number of samples;
    ``p = (1 + #{F* >= F}) / (1 + permutations)``.  ``simple``: sums of squared deviations of the squared distances from
    their mean over whole square blocks, diagonal included, and ``p = mean(F* >= F)``.  Statistics are null where a
    degree of freedom or a divisor is 0; ``simple`` needs 3 samples.  Labels are permuted by md5 order, and one pass over
    the pairs gives all statistics.  Statistics that differ by rounding
    only (1e-9) count as equal, so p does not depend on the order of summation.
    """
    groups = groups.join(groups.groupBy("variable").agg(F.countDistinct("value").alias("__n")).where("__n >= 2").select("variable"), "variable", "left_semi")
    if n_permutations < 1:
        observed = permuted_statistics(pairs, groups.withColumn("perm", F.lit(0)), variant).drop("perm")
        return observed.withColumn("p_value", F.lit(None).cast("double"))
    order = F.md5(F.concat_ws("#", F.col("perm").cast("string"), "sample", F.lit(str(seed))).cast("binary"))
    each = groups.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
    place = each.withColumn("k", F.row_number().over(Window.partitionBy("variable", "perm").orderBy(order, "sample"))).select("variable", "perm", "sample", "k")
    given = groups.withColumn("k", F.row_number().over(Window.partitionBy("variable").orderBy("sample"))).select("variable", "k", "value")
    labels = place.join(given, ["variable", "k"]).select("variable", "perm", "sample", "value").unionByName(groups.select("variable", F.lit(0).alias("perm"), "sample", "value"))
    statistics = keep(permuted_statistics(pairs, labels, variant), "permanova")
    observed = statistics.where("perm = 0").drop("perm")
    shuffled = statistics.where("perm > 0").select("variable", F.col("f_statistic").alias("f_star"))
    counted = shuffled.join(observed.select("variable", "f_statistic"), "variable").groupBy("variable").agg(F.sum((F.col("f_star") >= F.col("f_statistic") * (1 - 1e-9)).cast("long")).alias("hits"))
    hits = F.coalesce("hits", F.lit(0))
    p = (hits + 1) / (F.lit(n_permutations) + 1) if variant == "standard" else hits / F.lit(n_permutations)
    done = observed.join(counted, "variable", "left")
    return done.select("variable", "f_statistic", F.when(F.col("f_statistic").isNotNull(), p).alias("p_value"), "r_squared", "n_samples", "n_groups")


BLOCK_SAMPLES = 256


def label_codes(labels: DataFrame) -> DataFrame:
    """``variable, sample, codes``: a sample's labels in all permutations ``variable, perm, sample, value``, in their order, as small integers."""
    named = labels.select("variable", "value").distinct()
    coded = named.withColumn("code", F.dense_rank().over(Window.partitionBy("variable").orderBy("value")) - 1)
    each = labels.join(coded, ["variable", "value"])
    return each.groupBy("variable", "sample").agg(F.array_sort(F.collect_list(F.struct("perm", "code"))).alias("x")).select("variable", "sample", F.col("x.perm").alias("perms"), F.col("x.code").alias("codes"))


def inner_sums(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """``variable, perm, code, g1, g2``: sums of squared distances and of their squares over the pairs inside each group, and over all pairs with a null ``code``.

    Samples are dealt into blocks.  Two blocks' pairs meet their samples' labels once, and all permutations are summed
    there: a pair is one row, however many permutations there are.
    """
    blocks = max(1, -(-codes.select("sample").distinct().count() // BLOCK_SAMPLES))
    block = lambda c: F.pmod(F.xxhash64(F.lit(13), c), F.lit(blocks)).cast("int")
    x, y = block("sample_a"), block("sample_b")
    meeting = pairs.select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high"), "sample_a", "sample_b", F.col("distance").cast("double").alias("distance"))
    other = codes.withColumn("own", block("sample")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = other.select(F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "variable", "sample", "perms", "codes")
    columns = ["variable", "perm", "code", "g1", "g2"]

    def run(of_pairs: pa.Table, of_codes: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        d2 = of_pairs.column("distance").to_numpy() ** 2
        a, b = (of_pairs.column(c).to_pylist() for c in ("sample_a", "sample_b"))
        for variable in of_codes.column("variable").unique().to_pylist():
            own = of_codes.filter(pc.equal(of_codes.column("variable"), variable))
            at = {s: i for i, s in enumerate(own.column("sample").to_pylist())}
            both = np.array([i for i, (s, t) in enumerate(zip(a, b, strict=True)) if s in at and t in at], dtype=np.int64)
            if not len(both):
                continue
            ia, ib = (np.array([at[side[i]] for i in both], dtype=np.int64) for side in (a, b))
            perms = own.column("perms")[0].as_py()
            table = np.array(own.column("codes").to_pylist(), dtype=np.int32)
            near, n = d2[both], int(table.max()) + 1
            for p, perm in enumerate(perms):
                same = table[ia, p] == table[ib, p]
                group, value = table[ia[same], p], near[same]
                g1, g2 = (np.bincount(group, weights=w, minlength=n) for w in (value, value * value))
                rows = [*range(n), None], [*g1.tolist(), float(near.sum())], [*g2.tolist(), float((near * near).sum())]
                for column, values in zip(out, ([variable] * (n + 1), [perm] * (n + 1), *rows), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], columns)

    found = meeting.groupBy("low", "high").cogroup(given.groupBy("low", "high")).applyInArrow(run, "variable string, perm int, code int, g1 double, g2 double")
    return found.groupBy("variable", "perm", "code").agg(F.sum("g1").alias("g1"), F.sum("g2").alias("g2"))


def permuted_statistics(pairs: DataFrame, labels: DataFrame, variant: str = "standard") -> DataFrame:
    """F and R squared for each ``variable, perm`` of ``variable, perm, sample, value``; permutations of a variable have the same samples and values."""
    keys = ["variable", "perm"]
    codes = keep(label_codes(labels), "labels")
    sums = keep(inner_sums(pairs, codes), "inner-sums")
    each = codes.select("variable", F.explode(F.arrays_zip("perms", "codes")).alias("x")).select("variable", F.col("x.perms").alias("perm"), F.col("x.codes").alias("code"))
    sizes = each.groupBy(*keys, "code").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_groups"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("inner_df"))
    total = sums.where("code is null").select(*keys, F.col("g1").alias("s1"), F.col("g2").alias("s2"))
    inner = sums.where("code is not null")
    cells = sizes.join(inner, [*keys, "code"], "left").na.fill(0.0, ["g1", "g2"])
    if variant == "standard":
        within = cells.groupBy(*keys).agg(F.sum(F.col("g1") / F.col("n")).alias("ss_within"))
        ss_total = F.col("s1") / F.col("n_samples")
        df_within = F.col("n_samples") - F.col("n_groups")
    elif variant == "simple":
        block = 2 * F.col("g2") - (2 * F.col("g1")) * (2 * F.col("g1")) / (F.col("n") * F.col("n"))
        within = cells.groupBy(*keys).agg(F.sum(F.when(F.col("n") > 1, block).otherwise(0.0)).alias("ss_within"))
        ss_total = 2 * F.col("s2") - (2 * F.col("s1")) * (2 * F.col("s1")) / (F.col("n_samples") * F.col("n_samples"))
        df_within = F.col("inner_df")
    else:
        raise ValueError(f"unknown variant: {variant}")
    sums = whole.join(within, keys).join(total, keys, "left").withColumn("ss_total", ss_total).withColumn("df_within", df_within).withColumn("df_between", F.col("n_groups") - 1)
    between = F.col("ss_total") - F.col("ss_within")
    sound = (F.col("df_within") > 0) & (F.col("df_between") > 0) & (F.col("ss_within") > 0) & (F.col("ss_total") > 0)
    if variant == "simple":
        sound = sound & (F.col("n_samples") >= 3)
    f = F.when(sound, (between / F.col("df_between")) / (F.col("ss_within") / F.col("df_within")))
    return sums.select(*keys, f.alias("f_statistic"), F.when(sound, between / F.col("ss_total")).alias("r_squared"), "n_samples", "n_groups")


def compat_r_squared(f: Column, n: Column, g: Column) -> Column:
    """R squared as F / (F + n - g), without the factor g - 1; kept for comparison with older results."""
    return f / (f + n - g)


def rank_variables(results: DataFrame) -> DataFrame:
    """Results by falling R squared, unknown ones last, with ``rank`` and significance code."""
    rank = F.row_number().over(Window.orderBy(F.col("r_squared").desc_nulls_last(), "variable"))
    return results.withColumn("rank", rank).withColumn("significance", significance_code(F.col("p_value")))


def analyze_variables(pairs: DataFrame, meta: DataFrame, variables: list[str] | None = None, n_permutations: int = 999, variant: str = "standard", id_col: str = "sample") -> DataFrame:
    """PERMANOVA of every metadata column, ranked.  ``standard`` bins numeric columns; ``simple`` takes values as they are."""
    if variant == "standard":
        numeric = [f.name for f in meta.schema if f.name != id_col and f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")]
        for c in numeric:
            if variables is None or c in variables:
                meta = bin_numeric(meta, c).drop(c).withColumnRenamed("bin", c)
    done = permanova(pairs, long_metadata(meta, variables, id_col), n_permutations, variant)
    return rank_variables(done.join(missing_counts(meta, id_col), "variable", "left"))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``sample, label, silhouette`` from distances; 0 for the only sample of a cluster."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    both = pairs.select(F.col("sample_a").alias("sample"), F.col("sample_b").alias("other"), "distance").unionByName(pairs.select(F.col("sample_b").alias("sample"), F.col("sample_a").alias("other"), "distance"))
    near = both.join(labels.select(F.col("sample").alias("other"), F.col("label").alias("other_label")), "other").groupBy("sample", "other_label").agg(F.sum("distance").alias("d"))
    own = labels.join(near, "sample").join(sizes.select(F.col("label").alias("other_label"), F.col("n").alias("other_n")), "other_label").join(sizes, "label")
    same = F.col("label") == F.col("other_label")
    per = own.groupBy("sample", "label", "n").agg(F.max(F.when(same, F.col("d") / (F.col("other_n") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("other_n"))).alias("b"))
    value = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return per.select("sample", "label", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def adjusted_rand(labels: DataFrame, values: DataFrame) -> DataFrame:
    """One row: ``ari, n_samples`` of ``sample, label`` against ``sample, value``; 1 for two trivial partitions."""
    pick2 = lambda c: c * (c - 1) / 2
    cells = labels.join(values, "sample").groupBy("label", "value").agg(F.count("*").alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pick2(F.col("n"))).alias(f"sum_{c}"), F.sum("n").alias(f"n_{c}")) for c in ("label", "value"))
    table = cells.agg(F.sum(pick2(F.col("n"))).alias("both")).join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.col("sum_label") * F.col("sum_value") / pick2(F.col("n_label"))
    most = (F.col("sum_label") + F.col("sum_value")) / 2
    return table.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"), F.col("n_label").alias("n_samples"))


def numeric_agreement(labels: DataFrame, values: DataFrame) -> DataFrame:
    """One row: ``r_squared`` of a numeric value against its cluster's mean, sample by sample."""
    known = labels.join(values, "sample").where("value is not null").select("label", "value")
    both = known.join(known.groupBy("label").agg(F.avg("value").alias("mean")), "label")
    return both.agg((F.corr("value", "mean") * F.corr("value", "mean")).alias("r_squared"), F.count("*").alias("n_samples"))
