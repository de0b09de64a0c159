"""Grouping recommendations from distances and metadata.

Two variants with different numbers: ``simple`` scores Ward clusters by similarity and adjusts them by metadata, and
``standard`` scores average-linkage clusters and metadata groups by distance and picks disjoint ones greedily.  Group
scores are DataFrame aggregates over the pair table; the greedy pass and the cuts are over a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions.scalars import contamination_ladder, contiguity_gain, cost_multiplier, coverage_boost, quality_ladder
from helixspark.operators.clusters import agglomerate, best_cut
from helixspark.operators.matrix import cut
from helixspark.operators.pairs import both_ways, similarity_structure
from helixspark.plans.scratch import keep

HIGH_SIMILARITY, MEDIUM_SIMILARITY, MAX_GROUP = 0.85, 0.30, 10
HIGH_DISTANCE, MEDIUM_DISTANCE = 0.15, 0.30
GROUPS = "group_id int, sample_names array<string>"

# Command templates and assembler parameters.
MEGAHIT = {
    "individual": "--min-contig-len 1000 --k-min 21 --k-max 141 --k-step 12",
    "grouped": "--min-contig-len 1000 --k-min 21 --k-max 141 --k-step 12 --merge-level 20,0.95",
    "global": "--min-contig-len 1000 --k-min 21 --k-max 141 --k-step 12 --merge-level 20,0.98",
}
SPADES = {"individual": "--meta -k 21,33,55,77", "grouped": "--meta -k 21,33,55,77,99", "global": "--meta -k 21,33,55,77,99,121"}
FLYE = {"individual": "--meta --genome-size 5m", "grouped": "--meta --genome-size 10m", "global": "--meta --genome-size 50m"}


def member_distances(groups: DataFrame, pairs: DataFrame, key: str = "group_id") -> DataFrame:
    """``key, distance`` of every two members of a group."""
    each = groups.select(key, F.explode("sample_names").alias("sample"))
    a, b = (each.select(key, F.col("sample").alias(f"sample_{s}")) for s in ("a", "b"))
    return pairs.join(a, "sample_a").join(b, [key, "sample_b"]).select(key, "distance", "similarity")


def group_distances(groups: DataFrame, pairs: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups with ``n, avg_distance, max_distance`` over their pairs; 0 for fewer than two members."""
    stats = member_distances(groups, pairs, key).groupBy(key).agg(F.avg("distance").alias("avg_distance"), F.max("distance").alias("max_distance"))
    return groups.join(stats, key, "left").na.fill(0.0, ["avg_distance", "max_distance"]).withColumn("n", F.size("sample_names"))


def group_similarities(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups with ``n, mean_similarity, min_similarity, std_similarity``; 1, 1, 0 for single samples."""
    s = F.col("similarity")
    stats = member_distances(groups, pairs).groupBy("group_id").agg(F.avg(s).alias("mean_similarity"), F.min(s).alias("min_similarity"), F.stddev_pop(s).alias("std_similarity"))
    done = groups.join(stats, "group_id", "left").na.fill({"mean_similarity": 1.0, "min_similarity": 1.0, "std_similarity": 0.0})
    return done.withColumn("n", F.size("sample_names"))


def group_quality(n: Column, avg_distance: Column, max_distance: Column) -> Column:
    """0.4 nearness + 0.2 size + 0.4 homogeneity, from 0 to 1; 0 for fewer than two members."""
    near = lambda d: F.greatest(F.lit(0.0), 1 - d / MEDIUM_DISTANCE)
    size = F.when(n < 3, 0.8).when(n > 8, 0.7).otherwise(1.0)
    score = near(avg_distance) * 0.4 + size * 0.2 + near(max_distance) * 0.4
    return F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def score_groups(groups: DataFrame, max_group_size: int = MAX_GROUP) -> DataFrame:
    """Strategy and confidence of clusters with their similarities (the ``simple`` ladder)."""
    mean, large = F.col("mean_similarity"), F.col("n") > max_group_size
    strategy = F.when(F.col("n") == 1, "individual").when(large & (mean > HIGH_SIMILARITY), "global").otherwise("grouped")
    confidence = F.when(F.col("n") == 1, 0.7).when(large & (mean <= HIGH_SIMILARITY), mean * 0.8).otherwise(mean * 0.9)
    return groups.withColumn("strategy", strategy).withColumn("confidence", confidence)


def group_consistency(groups: DataFrame, long_meta: DataFrame) -> DataFrame:
    """``group_id, variable, consistency, unique_values, total_samples`` of groups with two members and more."""
    members = groups.where(F.size("sample_names") > 1).select("group_id", F.explode("sample_names").alias("sample"))
    counted = members.join(long_meta, "sample").groupBy("group_id", "variable").agg(F.countDistinct("value").alias("unique_values"), F.count("*").alias("total_samples"))
    return counted.withColumn("consistency", 1 - (F.col("unique_values") - 1) / F.col("total_samples"))


def adjust_confidence(groups: DataFrame, consistency: DataFrame) -> DataFrame:
    """Confidence times 0.7 + 0.3 of the mean consistency, at most 0.95, where a group has any; with its support as a map."""
    info = F.struct("consistency", "unique_values", "total_samples")
    mean = consistency.groupBy("group_id").agg(F.avg("consistency").alias("mean_consistency"), F.map_from_entries(F.collect_list(F.struct("variable", info))).alias("metadata_support"))
    adjusted = F.when(F.col("mean_consistency").isNotNull(), F.least(F.lit(0.95), F.col("confidence") * (0.7 + 0.3 * F.col("mean_consistency")))).otherwise(F.col("confidence"))
    return groups.join(mean, "group_id", "left").withColumn("confidence", adjusted).drop("mean_consistency")


def overall(groups: DataFrame) -> DataFrame:
    """One row: ``strategy, overall_confidence, n_groups, n_individual`` of scored groups (the ``simple`` rules)."""
    size = F.size("sample_names")
    kinds = groups.agg(
        F.count("*").alias("n"), F.sum((F.col("strategy") == "individual").cast("long")).alias("individual"), F.sum((F.col("strategy") == "global").cast("long")).alias("global"),
        F.first("strategy").alias("first"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("weighted"), F.sum((size == 1).cast("long")).alias("single"),
    )
    strategy = F.when(F.col("n") == 1, F.col("first")).when(F.col("individual") > F.col("n") * 0.7, "individual").when(F.col("global") > 0, "mixed").otherwise("grouped")
    penalty = F.least(F.lit(0.2), F.col("single") / F.col("n") * 0.3)
    confidence = F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.1), F.col("weighted") - penalty))
    return kinds.select(strategy.alias("strategy"), confidence.alias("overall_confidence"), (F.col("n") - F.col("single")).alias("n_groups"), F.col("single").alias("n_individual"))


def simple_groups(spark, pairs: DataFrame, max_group_size: int = MAX_GROUP) -> DataFrame:
    """``group_id, sample_names, n, strategy, confidence, mean_similarity, min_similarity, std_similarity``."""
    stats = similarity_structure(pairs, MEDIUM_SIMILARITY).first()
    if stats["similarity_pattern"] in ("very_high", "low"):
        alone = stats["similarity_pattern"] == "low"
        names = [r["sample"] for r in both_ways(pairs).select("sample").distinct().orderBy("sample").collect()]
        members = [[s] for s in names] if alone else [names]
        out = spark.createDataFrame(list(enumerate(members)), GROUPS).withColumn("n", F.size("sample_names"))
        mean = 0.0 if alone else float(stats["mean_similarity"])
        return out.select(
            "group_id", "sample_names", "n", F.lit("individual" if alone else "global").alias("strategy"), F.lit(0.7 if alone else min(0.9, mean)).alias("confidence"),
            F.lit(mean).alias("mean_similarity"), F.lit(0.0 if alone else float(stats["min_similarity"])).alias("min_similarity"), F.lit(0.0 if alone else float(stats["std_similarity"])).alias("std_similarity"),
        )
    names, merges = agglomerate(pairs, "ward")
    labels = cut(merges, len(names), best_cut(pairs, names, merges))
    members = [[s for s, x in zip(names, labels, strict=True) if x == c] for c in range(int(labels.max()) + 1 if len(labels) else 0)]
    scored = score_groups(group_similarities(spark.createDataFrame(list(enumerate(members)), GROUPS), pairs), max_group_size)
    return scored.select("group_id", "sample_names", "n", "strategy", "confidence", "mean_similarity", "min_similarity", "std_similarity")


def simple_commands(groups: DataFrame, batch: int = 10, suffix: str = ".fastq.gz") -> DataFrame:
    """``tool, group_id, step, command`` for groups with ids, members and strategy; large groups go to MEGAHIT in batches."""
    pick = lambda table: F.element_at(F.create_map(*[x for kv in table.items() for x in map(F.lit, kv)]), F.col("strategy"))
    single = F.col("strategy") == "individual"
    each = groups.select("group_id", "strategy", F.posexplode("sample_names").alias("i", "sample"), F.size("sample_names").alias("n"))
    path = F.concat("sample", F.lit(suffix))
    name = F.concat(F.lit("group_"), F.col("group_id"))
    alone = each.where(single).select(F.lit("megahit").alias("tool"), "group_id", F.col("i").alias("step"), F.concat(F.lit("megahit -1 "), path, F.lit(" "), pick(MEGAHIT), F.lit(" -o "), F.col("sample"), F.lit("_megahit --out-prefix "), F.col("sample")).alias("command"))
    part = F.when(F.col("n") > batch, F.floor(F.col("i") / batch)).otherwise(F.lit(0))
    runs = each.where(~single).groupBy("group_id", "strategy", "n", part.cast("int").alias("step")).agg(F.array_sort(F.collect_list(F.struct("i", path.alias("path")))).alias("files"))
    label = F.when(F.col("n") > batch, F.concat(name, F.lit("_batch_"), F.col("step"))).otherwise(name)
    joint = runs.select(F.lit("megahit").alias("tool"), "group_id", "step", F.concat(F.lit("megahit -1 "), F.array_join("files.path", ","), F.lit(" "), pick(MEGAHIT), F.lit(" -o "), label, F.lit("_megahit --out-prefix "), label).alias("command"))
    where = F.when(single, F.concat("sample", F.lit("_spades"))).otherwise(F.concat("sample", F.lit("_spades_"), name))
    spades = each.select(F.lit("spades").alias("tool"), "group_id", F.col("i").alias("step"), F.concat(F.lit("spades.py "), pick(SPADES), F.lit(" -1 "), path, F.lit(" -o "), where).alias("command"))
    flye_alone = each.where(single).select(F.lit("flye").alias("tool"), "group_id", F.col("i").alias("step"), F.concat(F.lit("flye --nano-raw "), path, F.lit(" "), pick(FLYE), F.lit(" --out-dir "), F.col("sample"), F.lit("_flye")).alias("command"))
    files = F.array_join(F.transform("sample_names", lambda s: F.concat(s, F.lit(suffix))), " ")
    flye_joint = groups.where(~single).select(F.lit("flye").alias("tool"), "group_id", F.lit(0).alias("step"), F.concat(F.lit("cat "), files, F.lit(" > "), name, F.lit("_combined.fastq && flye --nano-raw "), name, F.lit("_combined.fastq "), pick(FLYE), F.lit(" --out-dir "), name, F.lit("_flye")).alias("command"))
    out = alone
    for more in (joint, spades, flye_alone, flye_joint):
        out = out.unionByName(more)
    return out


# ---- standard variant


def similarity_candidates(spark, pairs: DataFrame) -> DataFrame:
    """Average-linkage clusters of two members and more for k = 2 .. min(n, 8) - 1, with distances and confidence."""
    names, merges = agglomerate(pairs, "average")
    rows = []
    for k in range(2, min(len(names), 8)):
        labels = cut(merges, len(names), k)
        for c in range(k):
            members = [s for s, x in zip(names, labels, strict=True) if x == c]
            if len(members) >= 2:
                rows.append((f"similarity_cluster_{c + 1}_{k}", members))
    found = group_distances(spark.createDataFrame(rows, "group_id string, sample_names array<string>"), pairs).where(F.col("avg_distance") <= MEDIUM_DISTANCE)
    return found.select(
        "group_id", "sample_names", F.lit("k-mer_similarity").alias("criterion"), F.format_string("avg_distance_%.3f", "avg_distance").alias("value"), "avg_distance", "max_distance",
        group_quality(F.col("n"), F.col("avg_distance"), F.col("max_distance")).alias("confidence"),
    )


def metadata_confidence(r_squared: Column, p_value: Column, avg_distance: Column) -> Column:
    bonus = F.when(p_value < 0.01, 1.2).when(p_value < 0.05, 1.0).otherwise(0.8)
    score = F.least(F.lit(1.0), r_squared * 2) * bonus * F.greatest(F.lit(0.5), 1 - avg_distance / MEDIUM_DISTANCE)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def metadata_groups(pairs: DataFrame, long_meta: DataFrame, results: DataFrame) -> DataFrame:
    """One group per value, with two samples and more, of each variable with p < 0.05 or R squared > 0.20."""
    significant = results.where((F.col("p_value") < 0.05) | (F.col("r_squared") > 0.20)).select("variable", "p_value", "r_squared")
    known = pairs.select(F.col("sample_a").alias("sample")).union(pairs.select("sample_b")).distinct()
    grouped = long_meta.join(known, "sample").join(significant, "variable").groupBy("variable", "value", "p_value", "r_squared").agg(F.array_sort(F.collect_list("sample")).alias("sample_names"))
    named = grouped.where(F.size("sample_names") >= 2).withColumn("group_id", F.concat_ws("_", "variable", "value"))
    scored = group_distances(named, pairs)
    return scored.select(
        "group_id", "sample_names", F.col("variable").alias("criterion"), "value", "avg_distance", "max_distance",
        metadata_confidence(F.col("r_squared"), F.col("p_value"), F.col("avg_distance")).alias("confidence"),
    )


def hybrid_boost(groups: DataFrame, clamp: bool = False) -> DataFrame:
    """Confidence times 1.2 for close similarity groups and 1.1 for close metadata groups; it may pass 1 unless clamped."""
    similar = F.col("criterion") == "k-mer_similarity"
    boosted = F.when(similar & (F.col("avg_distance") < HIGH_DISTANCE), F.col("confidence") * 1.2).when(~similar & (F.col("avg_distance") < MEDIUM_DISTANCE), F.col("confidence") * 1.1).otherwise(F.col("confidence"))
    return groups.withColumn("confidence", F.least(F.lit(1.0), boosted) if clamp else boosted)


def pick_disjoint(groups: DataFrame) -> DataFrame:
    """Groups by falling confidence, each kept if it shares no sample with those kept before.

    In rounds: a group that is the first of all open ones for each of its samples is kept, and those that share a sample
    with it go.  That gives what one pass in order would, with as many rounds as groups block each other in a row.
    """
    key = F.struct(F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("c"), F.col("group_id").alias("g"))
    still = keep(groups.withColumn("__key", key), "open-groups")
    kept = None
    while True:
        each = still.select("__key", F.explode("sample_names").alias("sample"))
        ahead = each.groupBy("sample").agg(F.min("__key").alias("ahead"))
        judged = each.join(ahead, "sample").groupBy("__key").agg(F.bool_and(F.col("__key") == F.col("ahead")).alias("won"))
        won = keep(still.join(judged.where("won"), "__key", "left_semi"), "kept-groups")
        if won.isEmpty():
            break
        kept = won if kept is None else kept.unionByName(won)
        blocked = each.join(won.select(F.explode("sample_names").alias("sample")).distinct(), "sample", "left_semi").select("__key").distinct()
        still = keep(still.join(blocked, "__key", "left_anti"), "open-groups")
    return (groups.limit(0) if kept is None else kept.drop("__key")).orderBy(F.col("confidence").desc(), "group_id")


def standard_groups(spark, pairs: DataFrame, long_meta: DataFrame | None = None, results: DataFrame | None = None, clamp: bool = False) -> DataFrame:
    similar = pick_disjoint(similarity_candidates(spark, pairs))
    by_meta = metadata_groups(pairs, long_meta, results) if long_meta is not None and results is not None else None
    if by_meta is None or by_meta.isEmpty():
        return similar
    return pick_disjoint(hybrid_boost(similar.unionByName(by_meta), clamp))


def standard_overall(groups: DataFrame, n_samples: int) -> DataFrame:
    """One row: ``strategy, overall_confidence, primary_criterion, n_groups, n_grouped`` (the ``standard`` rules)."""
    sums = groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.size("sample_names")), F.lit(0)).alias("n_grouped"), F.avg("confidence").alias("mean"), F.mode("criterion", True).alias("primary_criterion"))
    none = (F.col("n_groups") == 0) | (F.col("n_grouped") < 2)
    whole = (F.col("n_grouped") == n_samples) & (F.col("n_groups") == 1)
    return sums.select(
        F.when(none, "individual").when(whole, "global").otherwise("grouped").alias("strategy"), F.when(none, 0.7).otherwise(F.col("mean")).alias("overall_confidence"), "primary_criterion", "n_groups", "n_grouped"
    )


def predictions(groups: DataFrame) -> DataFrame:
    """Expected quality, risk, gains and cost of each group."""
    n, d = F.size("sample_names"), F.col("avg_distance")
    times = lambda c: F.format_string("%.1fx", c)
    return groups.select(
        "group_id", n.alias("n_samples"), "avg_distance", quality_ladder(d).alias("predicted_quality"), contamination_ladder(d).alias("contamination_risk"),
        times(contiguity_gain(d)).alias("expected_contiguity_improvement"), times(coverage_boost(n)).alias("expected_coverage_boost"), times(cost_multiplier(n)).alias("computational_cost_multiplier"), "confidence",
    )


def strategy_summary(groups: DataFrame, n_samples: int) -> DataFrame:
    held = F.coalesce(F.sum(F.size("sample_names")), F.lit(0))
    return groups.agg((F.count("*") + n_samples - held).alias("total_assemblies"), F.count("*").alias("co_assemblies"), (n_samples - held).alias("individual_assemblies"), held.alias("samples_in_coassembly"), (held / n_samples * 100).alias("coassembly_percentage"))


def standard_commands(groups: DataFrame) -> DataFrame:
    """``tool, group_id, step, command`` of the ``standard`` variant."""
    names, first, gid = F.col("sample_names"), F.element_at("sample_names", 1), F.col("group_id")
    many = F.size(names) > 1
    quoted = F.array_join(F.transform(names, lambda s: F.concat(F.lit('"'), s, F.lit('.fastq"'))), " ")
    listed = F.array_join(F.transform(names, lambda s: F.concat(s, F.lit(".fastq"))), ",")
    join_reads = F.concat(F.lit("python -c \"import shutil; out=open('"), gid, F.lit("_combined.fastq', 'wb'); [shutil.copyfileobj(open(f, 'rb'), out) for f in ["), quoted, F.lit("]]; out.close()\""))
    rows = [
        ("megahit", F.array(F.when(many, F.concat(F.lit("megahit -r "), listed, F.lit(" -o "), gid, F.lit("_coassembly --min-contig-len 500 --k-list 21,29,39,59,79,99"))).otherwise(F.concat(F.lit("megahit -r "), first, F.lit(".fastq -o "), first, F.lit("_assembly --min-contig-len 500"))))),
        ("spades", F.when(many, F.array(join_reads, F.concat(F.lit("spades.py --meta -s "), gid, F.lit("_combined.fastq -o "), gid, F.lit("_spades_assembly")))).otherwise(F.array(F.concat(F.lit("spades.py --meta -s "), first, F.lit(".fastq -o "), first, F.lit("_spades_assembly"))))),
        ("flye", F.when(many, F.array(join_reads, F.concat(F.lit("flye --meta --nano-raw "), gid, F.lit("_combined.fastq -o "), gid, F.lit("_flye_assembly")))).otherwise(F.array(F.concat(F.lit("flye --meta --nano-raw "), first, F.lit(".fastq -o "), first, F.lit("_flye_assembly"))))),
    ]
    tools = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), c.alias("commands")) for t, c in rows]))
    return groups.select("group_id", tools.alias("x")).select("x.tool", "group_id", F.posexplode("x.commands").alias("step", "command"))


def for_tools(commands: DataFrame, tools: list[str]) -> DataFrame:
    return commands.where(F.col("tool").isin(*tools))


def numbered_batches(members: DataFrame, size: int = 10) -> DataFrame:
    """``group_id, sample`` with ``batch``: runs of ``size`` samples by name."""
    return members.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("group_id").orderBy("sample")) - 1) / size))
