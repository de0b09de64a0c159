"""The three phases as one facade: profiles and pairs, metadata statistics, recommendations."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import clusters, pairs, profiles, recommend, sketch, stats
from helixspark.operators.lsh import lsh_similarities
from helixspark.plans.config import Config
from helixspark.plans.scratch import keep
from helixspark.sources import fastq, metadata, results


@dataclass
class Phase1:
    samples: DataFrame
    profile: DataFrame
    pairs: DataFrame


def profile_reads(reads: DataFrame, config: Config) -> DataFrame:
    """Profile or sketch of reads ``sample, file, read_no, seq``."""
    p = config.profile
    counts = profiles.kmer_counts(profiles.cap_reads(reads, p.max_reads), p.k, p.packed)
    if p.sketch:
        return sketch.sketch(profiles.with_strings(counts, p.k), p.sketch_size, p.sampling)
    return profiles.profile(counts, p.min_kmer_freq)


def run_phase1(reads: DataFrame, config: Config) -> Phase1:
    """Profile and pairs, each evaluated once.  All pairs of samples are there, with the metric of the settings.

    What is computed never depends on the number of samples: LSH, and the removal of rare k-mers, are settings.  With LSH
    the pairs that it leaves out, whose estimate is not above the threshold, have similarity 0.
    """
    prof = keep(profile_reads(reads, config.checked()), "profile")
    samples = prof.select("sample").distinct()
    share = config.profile.common_share
    used = profiles.common_only(prof, share=share, only_above=0) if share > 0 else prof
    if config.similarity.method == "lsh":
        found = lsh_similarities(used, config.similarity.threshold)
        return Phase1(samples, prof, keep(pairs.completed(found, used), "pairs"))
    return Phase1(samples, prof, keep(pairs.pairwise(used, config.similarity.metric), "pairs"))


def run_phase2(spark: SparkSession, phase1: Phase1, meta: DataFrame, config: Config):
    """(ranked variables, cluster labels, cluster scores, best k)."""
    t = config.statistics
    aligned = metadata.align(phase1.samples, meta)
    ranked = stats.analyze_variables(phase1.pairs, aligned, list(t.variables) if t.variables else None, t.permutations, t.variant)
    return (keep(ranked, "variables"), *clusters.identify_clusters(spark, phase1.pairs, t.min_clusters, t.max_clusters, t.variant))


def run_phase3(spark: SparkSession, phase1: Phase1, config: Config, meta: DataFrame | None = None, ranked: DataFrame | None = None):
    """(overall, groups, commands)."""
    long_meta = None if meta is None else stats.long_metadata(metadata.align(phase1.samples, meta))
    if config.statistics.variant == "standard":
        groups = recommend.standard_groups(spark, phase1.pairs, long_meta, ranked)
        total, commands = recommend.standard_overall(groups, phase1.samples.count()), recommend.standard_commands(groups)
    else:
        groups = recommend.simple_groups(spark, phase1.pairs, max_group_size=config.grouping.max_group_size)
        if long_meta is not None and ranked is not None:
            significant = ranked.where("p_value < 0.05").select("variable")
            groups = recommend.adjust_confidence(groups, recommend.group_consistency(groups, long_meta.join(significant, "variable", "left_semi")))
        total, commands = recommend.overall(groups), recommend.simple_commands(groups)
    return total, groups, recommend.for_tools(commands, list(config.grouping.tools))


def rationale(overall: DataFrame, groups: DataFrame, ranked: DataFrame | None = None) -> tuple[list[str], str]:
    """Reasons and a one-line summary."""
    o = overall.first()
    why = {"individual": "samples differ too much to be put together", "global": "all samples are alike", "grouped": "samples form groups by similarity", "mixed": "samples form groups of different kinds"}
    n_many = groups.where(F.size("sample_names") > 1).count()
    n_single = groups.where(F.size("sample_names") == 1).count()
    reasons = [f"{o['strategy']}: {why[o['strategy']]}"] + [f"{n_many} groups of several samples"] * bool(n_many) + [f"{n_single} samples alone"] * bool(n_single)
    best = None if ranked is None else ranked.where("p_value < 0.05").orderBy(F.col("r_squared").desc_nulls_last()).first()
    if best is not None:
        reasons.append(f"metadata variable {best['variable']} agrees (R2 = {best['r_squared']:.3f})")
    return reasons, f"{o['strategy']} assembly, confidence {o['overall_confidence']:.1%}, {n_many} groups, {n_single} single samples"


def run(spark: SparkSession, folder: str, out: str, config: Config | None = None, metadata_path: str | None = None) -> dict[str, DataFrame]:
    """From a folder of FASTQ files to results in ``out``; returns the tables."""
    config, began = (config or Config()).checked(), time.monotonic()
    if not fastq.has_fastq(spark, folder):
        raise ValueError(f"no FASTQ files in {folder}")
    found = fastq.find_samples(fastq.list_files(spark, folder))
    scanned = fastq.scan_samples(found)
    one = run_phase1(scanned.records, config)
    results.save_results(one.profile, one.pairs, out)
    tables = {"samples": found, "failures": scanned.failures, "profile": one.profile, "pairs": one.pairs}
    meta = ranked = None
    if metadata_path:
        meta = metadata.read_metadata(spark, metadata_path, config.statistics.sample_id_column)
        ranked, labels, scores, best = run_phase2(spark, one, meta, config)
        results.one_csv(ranked, f"{out}/permanova_results")
        results.write_text(spark, f"{out}/analysis_report.md", results.variable_report(ranked, scores))
        tables |= {"variables": ranked, "cluster_labels": labels, "cluster_scores": scores, "best_k": best}
    overall, groups, commands = run_phase3(spark, one, config, meta, ranked)
    reasons, summary = rationale(overall, groups, ranked)
    results.save_recommendations(spark, overall, groups, commands, reasons, summary, f"{out}/assembly_recommendations")
    tables |= {"overall": overall, "groups": groups, "commands": commands}
    results.run_summary(spark, f"{out}/run_summary.json", config.to_dict(), tables, time.monotonic() - began)
    return tables
