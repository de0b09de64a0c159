"""Closed-form column expressions: estimates, ladders and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_size(n: Column) -> Column:
    """Bytes as text in B, KB, MB, GB or TB with one decimal."""
    n = n.cast("double")
    out = F.concat(F.format_string("%.1f", n / 1024**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", n / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def memory_estimate_mb(n_samples: Column, reads_per_sample: Column, k: Column, read_length: int = 150) -> Column:
    """MB for the profiles of samples with reads of ``read_length`` bases: a tenth of all k-mers, at most 4**min(k, 15), are distinct."""
    windows = reads_per_sample.cast("double") * F.greatest(F.lit(read_length) - k + 1, F.lit(0))
    distinct = F.least(windows * 0.1, F.pow(F.lit(4.0), F.least(k, F.lit(15))))
    return distinct * (k + 8) * n_samples / (1024.0 * 1024.0)


def runtime_seconds(n_samples: Column, k: Column, permutations: Column) -> Column:
    """10, 20 or 30 s a sample for k up to 17, up to 21 and above, and 0.01 s for each permutation and sample."""
    return n_samples * F.when(k <= 17, 10.0).when(k <= 21, 20.0).otherwise(30.0) + permutations * n_samples * 0.01


def profiling_seconds(n_samples: Column, reads_per_sample: Column, k: Column) -> Column:
    """30 s a sample, by the square of k / 21 and by reads / 10000."""
    return n_samples * 30.0 * F.pow(k / 21.0, F.lit(2.0)) * reads_per_sample / 10000.0


def recommended_preset(n_samples: Column, memory_gb: Column) -> Column:
    return F.when((n_samples > 100) | (memory_gb < 8), "large_dataset").when(n_samples > 20, "default").otherwise("high_quality")


def distance_to_similarity(d: Column, metric: str = "braycurtis") -> Column:
    return F.greatest(F.lit(0.0), 1 - d / 2) if metric == "euclidean" else 1 - d


def quality_ladder(avg_distance: Column) -> Column:
    return F.when(avg_distance < 0.1, "Very High").when(avg_distance < 0.2, "High").when(avg_distance < 0.3, "Medium").otherwise("Low-Medium")


def contamination_ladder(avg_distance: Column) -> Column:
    return F.when(avg_distance < 0.1, "Low").when(avg_distance < 0.2, "Low-Medium").when(avg_distance < 0.3, "Medium").otherwise("High")


def contiguity_gain(avg_distance: Column) -> Column:
    return F.greatest(F.lit(1.0), 2.0 - avg_distance * 3)


def coverage_boost(n: Column) -> Column:
    return F.least(n * 0.8, F.lit(5.0))


def cost_multiplier(n: Column) -> Column:
    return F.pow(n.cast("double"), F.lit(1.5))


def safe_name(name: Column) -> Column:
    """A variable's name for use in file names."""
    return F.translate(name, " /", "__")


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row.

    Filters and later columns read a generator's values, where a plain column's expression is repeated in each of them.
    """
    cell = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__cell")
    return df.select(*[c for c in df.columns if c not in columns], cell).select("*", "__cell.*").drop("__cell")
