"""Sinks and the reading back of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators.pairs import mirrored, square


def write_text(spark: SparkSession, path: str, text: str, executable: bool = False) -> None:
    """One text file through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    if executable:
        fs.setPermission(p, jvm.org.apache.hadoop.fs.permission.FsPermission("755"))


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def one_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """A folder with one CSV part; for results of the size of reports."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=header, sep=sep)


def save_results(prof: DataFrame, pairs: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Profiles and pairs as Parquet, sample names as JSON, the square matrix as CSV."""
    mode = "overwrite" if overwrite else "errorifexists"
    prof.write.mode(mode).parquet(f"{folder}/kmer_profiles")
    pairs.write.mode(mode).parquet(f"{folder}/pairs")
    samples = prof.select("sample").distinct()
    names = [r["sample"] for r in samples.orderBy("sample").collect()]
    write_text(prof.sparkSession, f"{folder}/sample_names.json", json.dumps(names, indent=2))
    one_csv(square(pairs, samples).orderBy("sample"), f"{folder}/distance_matrix")


def load_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    return spark.read.parquet(f"{folder}/kmer_profiles"), spark.read.parquet(f"{folder}/pairs"), json.loads(read_text(spark, f"{folder}/sample_names.json"))


def coordinates(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """``i, j, value`` of the symmetric similarity matrix, 1-based, diagonal included."""
    from helixspark.operators.pairs import sample_list

    numbered = sample_list(samples)
    a, b = (numbered.select(F.col("sample").alias(c), F.col("idx").alias(k)) for c, k in (("sample", "i"), ("other", "j")))
    cells = mirrored(pairs).join(a, "sample").join(b, "other").select("i", "j", F.col("similarity").alias("value"))
    return cells.unionByName(numbered.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("value")))


def save_similarity(pairs: DataFrame, samples: DataFrame, path: str, kind: str = "csv") -> None:
    """``csv``: the dense square; ``coo``: coordinates as Parquet and names; ``mtx``: Matrix Market text."""
    if kind == "csv":
        one_csv(square(pairs, samples, "similarity", 0.0).orderBy("sample"), path)
    elif kind in ("coo", "npz"):
        coordinates(pairs, samples).write.mode("overwrite").parquet(path)
        write_text(pairs.sparkSession, f"{path}_samples.txt", "\n".join(r["sample"] for r in samples.select("sample").distinct().orderBy("sample").collect()) + "\n")
    elif kind == "mtx":
        cells = coordinates(pairs, samples)
        n, count = samples.select("sample").distinct().count(), cells.count()
        head = cells.sparkSession.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate real general"), (0, 1, f"{n} {n} {count}")], "i int, j int, line string")
        body = cells.select("i", "j", F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")).alias("line"))
        head.unionByName(body).orderBy("i", "j").coalesce(1).select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {kind}; one of csv, coo, mtx")


def save_recommendations(spark: SparkSession, overall: DataFrame, groups: DataFrame, commands: DataFrame, rationale: list[str], summary: str, folder: str) -> None:
    """JSON, Markdown and one executable script per tool."""
    head = overall.first().asDict()
    body = [json.loads(r[0]) for r in groups.orderBy("group_id").select(F.to_json(F.struct("*"))).collect()]
    write_text(spark, f"{folder}/assembly_recommendations.json", json.dumps(head | {"summary": summary, "rationale": rationale, "groups": body}, indent=2))
    lines = ["# Assembly strategy", "", f"* Strategy: **{head['strategy']}**", f"* Confidence: {head['overall_confidence']:.1%}", f"* {summary}", "", "## Why", "", *[f"* {x}" for x in rationale], "", "## Groups", ""]
    for g in body:
        lines += [f"### {g['group_id']}", "", f"* Samples: {', '.join(g['sample_names'])}", f"* Confidence: {g['confidence']:.3f}", *[f"* {k}: {v}" for k, v in g.items() if k not in ("group_id", "sample_names", "confidence")], ""]
    write_text(spark, f"{folder}/assembly_strategy.md", "\n".join(lines))
    for tool in sorted({r["tool"] for r in commands.select("tool").distinct().collect()}):
        own = [r["command"] for r in commands.where(F.col("tool") == tool).orderBy("group_id", "step").collect()]
        write_text(spark, f"{folder}/run_{tool}_assemblies.sh", "\n".join(["#!/bin/bash", "set -e", "", *own, ""]), executable=True)


def write_fastq(reads: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Reads ``sample, header, seq, qual`` as FASTQ text, one sub-folder per sample; records stay whole lines together."""
    record = F.concat_ws("\n", "header", "seq", F.lit("+"), "qual")
    reads.select("sample", record.alias("value")).write.mode("overwrite").partitionBy("sample").option("compression", compression).text(folder)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """``sample, r1, r2`` as tab-separated text without header."""
    one_csv(manifest.select("sample", "r1", "r2").orderBy("sample"), path, sep="\t", header=False)


def run_summary(spark: SparkSession, path: str, settings: dict, tables: dict[str, DataFrame], seconds: float) -> dict:
    """Settings, row counts of the result tables and the time taken, as JSON."""
    out = {"settings": settings, "rows": {name: df.count() for name, df in sorted(tables.items())}, "seconds": round(seconds, 3), "complete": True}
    write_text(spark, path, json.dumps(out, indent=2))
    return out


def variable_report(results: DataFrame, scores: DataFrame | None = None) -> str:
    """Markdown: the ten best variables with significance codes, the significant ones, cluster counts and scores."""
    rows = results.orderBy(F.col("r_squared").desc_nulls_last(), "variable").limit(10).collect()
    show = lambda x: "n/a" if x is None else f"{x:.4f}"
    out = ["# Metadata analysis", "", "| variable | F | p | R2 | samples | groups | |", "|-|-|-|-|-|-|-|"]
    out += [f"| {r['variable']} | {show(r['f_statistic'])} | {show(r['p_value'])} | {show(r['r_squared'])} | {r['n_samples']} | {r['n_groups']} | {r['significance']} |" for r in rows]
    good = [r["variable"] for r in rows if r["p_value"] is not None and r["p_value"] < 0.05]
    out += ["", f"Significant at 0.05: {', '.join(good) if good else 'none'}."]
    if scores is not None:
        out += ["", "## Clusters", "", "| method | k | silhouette |", "|-|-|-|", *[f"| {r['method']} | {r['k']} | {r['silhouette']:.4f} |" for r in scores.orderBy("method", "k").collect()]]
    return "\n".join(out) + "\n"
