"""The tables behind plots; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.operators.clusters import agglomerate
from helixspark.operators.pairs import mirrored


def heatmap(pairs: DataFrame, samples: DataFrame, value: str = "distance") -> DataFrame:
    """``sample, other, value`` with the diagonal."""
    own = samples.select("sample").distinct().select("sample", F.col("sample").alias("other"), F.lit(0.0 if value == "distance" else 1.0).alias("value"))
    return mirrored(pairs).select("sample", "other", F.col(value).alias("value")).unionByName(own)


def dendrogram(spark, pairs: DataFrame, method: str = "ward") -> DataFrame:
    """``step, node_a, node_b, height, size`` from the true distances."""
    _, merges = agglomerate(pairs, method)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step int, node_a int, node_b int, height double, size int")


def variable_importance(results: DataFrame) -> DataFrame:
    """Bars of R squared and -log10(p), p at least 1e-10, with a colour by p."""
    p = F.col("p_value")
    colour = F.when(p < 0.05, "red").when(p < 0.1, "orange").otherwise("grey")
    return results.where("r_squared is not null and not isnan(r_squared)").select("variable", "r_squared", (-F.log10(F.greatest(p, F.lit(1e-10)))).alias("neg_log10_p"), colour.alias("colour"))


def coloured(points: DataFrame, meta: DataFrame, variable: str) -> DataFrame:
    """Ordination points with a metadata value, null where there is none."""
    return points.join(meta.select("sample", F.col(f"`{variable}`").alias("value")), "sample", "left")


def colour_columns(meta: DataFrame, id_col: str = "sample") -> list[str]:
    """Columns fit for colouring: 2 to 20 values, or more if numeric."""
    names = [c for c in meta.columns if c != id_col]
    if not names:
        return []
    counts = meta.agg(*[F.countDistinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)]).first()
    numeric = {f.name for f in meta.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")}
    return [c for i, c in enumerate(names) if 2 <= counts[i] <= 20 or (counts[i] > 20 and c in numeric)]


def only_samples(meta: DataFrame, samples: DataFrame) -> DataFrame:
    return meta.join(samples.select("sample").distinct(), "sample", "left_semi")


def cluster_scatter(points: DataFrame, labels: DataFrame, method: str, k: int) -> DataFrame:
    return points.join(labels.where((F.col("method") == method) & (F.col("k") == k)).select("sample", "label"), "sample", "left")


def strategy_panels(groups: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Matrix cells ordered by group, group sizes, confidences, and counts of strategies."""
    place = groups.select("group_id", F.explode("sample_names").alias("sample"))
    a, b = place.select(F.col("sample"), F.col("group_id").alias("group")), place.select(F.col("sample").alias("other"), F.col("group_id").alias("other_group"))
    cells = mirrored(pairs).join(a, "sample").join(b, "other").orderBy("group", "sample", "other_group", "other")
    sizes = groups.select("group_id", F.size("sample_names").alias("n"), "confidence")
    panels = {"matrix": cells, "groups": sizes}
    return panels | ({"strategies": groups.groupBy("strategy").agg(F.count("*").alias("n"))} if "strategy" in groups.columns else {})


def hover_text(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Points with one text of all metadata of a sample."""
    names = [c for c in meta.columns if c != "sample"]
    text = F.concat_ws("<br>", *[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in names])
    return points.join(meta.select("sample", text.alias("hover")), "sample", "left")
