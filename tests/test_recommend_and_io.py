import gzip
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from helixspark import cli, queries
from helixspark.functions import scalars
from helixspark.operators import adapters, pairs, preprocess, recommend, stats
from helixspark.plans import config, phases
from helixspark.sources import fastq, fastq_scan, metadata, results

M3 = (0.1, 0.8, 0.9, 0.9, 0.8, 0.1)
M4 = (0.2, 0.8, 0.7, 0.7, 0.8, 0.3)


def pair_frame(spark, values, names="ABCD"):
    rows = [(a, b, float(d), 1.0 - d) for (a, b), d in zip(itertools.combinations(names, 2), values, strict=True)]
    return spark.createDataFrame(rows, "sample_a string, sample_b string, distance double, similarity double")


# ---- recommendations


def test_standard_without_metadata(spark):
    g = recommend.standard_groups(spark, pair_frame(spark, M3))
    rows = g.collect()
    assert {tuple(r["sample_names"]) for r in rows} == {("A", "B"), ("C", "D")}
    assert all(abs(r["confidence"] - 0.693333) < 1e-6 and r["group_id"].startswith("similarity_cluster_") and r["group_id"].endswith("_2") for r in rows)
    assert recommend.standard_overall(g, 4).first()["strategy"] == "grouped"


def test_standard_with_metadata(spark):
    p = pair_frame(spark, M4)
    meta = stats.long_metadata(spark.createDataFrame([("A", "X", "1"), ("B", "X", "2"), ("C", "Y", "1"), ("D", "Y", "2")], "sample string, group string, site string"))
    found = spark.createDataFrame([("group", 0.6, 0.01), ("site", 0.4, 0.05)], "variable string, r_squared double, p_value double")
    scores = {r["group_id"]: r["confidence"] for r in recommend.hybrid_boost(recommend.metadata_groups(p, meta, found)).collect()}
    assert {k: round(v, 6) for k, v in scores.items()} == {"group_X": 0.55, "group_Y": 0.5, "site_1": 0.32, "site_2": 0.32}
    g = recommend.standard_groups(spark, p, meta, found)
    assert [r["group_id"] for r in g.orderBy(F.col("confidence").desc()).collect()] == ["group_X", "group_Y"]
    o = recommend.standard_overall(g, 4).first()
    assert (o["strategy"], round(o["overall_confidence"], 6), o["primary_criterion"]) == ("grouped", 0.525, "group")


def test_group_quality(spark):
    groups = spark.createDataFrame([("near", ["A", "B"]), ("far", ["A", "C"]), ("one", ["A"])], "group_id string, sample_names array<string>")
    g = recommend.group_distances(groups, pair_frame(spark, M3)).withColumn("q", recommend.group_quality(F.col("n"), F.col("avg_distance"), F.col("max_distance")))
    assert {r["group_id"]: round(r["q"], 3) for r in g.collect()} == {"near": 0.693, "far": 0.16, "one": 0.0}


def test_golden_confidences(spark):
    """A published run: the group of mean similarity 0.540432 with consistencies 0.5 and 0.75."""
    g = spark.createDataFrame([(0, ["a", "b", "c", "d"], 0.540432 * 0.9)], "group_id int, sample_names array<string>, confidence double")
    c = spark.createDataFrame([(0, "v", 0.5, 3, 4), (0, "w", 0.75, 2, 4)], "group_id int, variable string, consistency double, unique_values long, total_samples long")
    r = recommend.adjust_confidence(g, c).first()
    assert abs(r["confidence"] - 0.431670) < 1e-6 and set(r["metadata_support"]) == {"v", "w"}
    eight = spark.createDataFrame([(i, ["x"] * (1 if i == 0 else 3), "individual" if i == 0 else "grouped", 0.474134) for i in range(8)], "group_id int, sample_names array<string>, strategy string, confidence double")
    o = recommend.overall(eight).first()
    assert abs(o["overall_confidence"] - 0.436634) < 1e-6 and o["strategy"] == "grouped" and (o["n_groups"], o["n_individual"]) == (7, 1)


@pytest.mark.parametrize(("values", "strategy", "n"), [((0.05,) * 6, "global", 1), ((0.9,) * 6, "individual", 4), (M3, "grouped", 2)])
def test_simple(spark, values, strategy, n):
    g = recommend.simple_groups(spark, pair_frame(spark, values))
    assert g.count() == n and recommend.overall(g).first()["strategy"] == strategy
    if strategy == "global":
        assert abs(g.first()["confidence"] - 0.9) < 1e-9
    if strategy == "individual":
        assert all(r["confidence"] == 0.7 for r in g.collect())


def test_commands(spark):
    g = spark.createDataFrame([(0, [f"s{i:02}" for i in range(12)], "grouped"), (1, ["solo"], "individual")], "group_id int, sample_names array<string>, strategy string")
    c = recommend.simple_commands(g)
    by = {(r["tool"], r["group_id"], r["step"]): r["command"] for r in c.collect()}
    assert by["megahit", 0, 1] == "megahit -1 s10.fastq.gz,s11.fastq.gz --min-contig-len 1000 --k-min 21 --k-max 141 --k-step 12 --merge-level 20,0.95 -o group_0_batch_1_megahit --out-prefix group_0_batch_1"
    assert by["megahit", 1, 0] == "megahit -1 solo.fastq.gz --min-contig-len 1000 --k-min 21 --k-max 141 --k-step 12 -o solo_megahit --out-prefix solo"
    assert by["spades", 1, 0] == "spades.py --meta -k 21,33,55,77 -1 solo.fastq.gz -o solo_spades" and len([1 for t, *_ in by if t == "spades"]) == 13
    assert by["flye", 0, 0].startswith("cat s00.fastq.gz s01.fastq.gz") and by["flye", 0, 0].endswith("--genome-size 10m --out-dir group_0_flye")
    assert {r["tool"] for r in recommend.for_tools(c, ["flye"]).collect()} == {"flye"}
    s = spark.createDataFrame([("g", ["a", "b"]), ("h", ["a"])], "group_id string, sample_names array<string>")
    std = {(r["tool"], r["group_id"], r["step"]): r["command"] for r in recommend.standard_commands(s).collect()}
    assert std["megahit", "g", 0] == "megahit -r a.fastq,b.fastq -o g_coassembly --min-contig-len 500 --k-list 21,29,39,59,79,99"
    assert std["spades", "h", 0] == "spades.py --meta -s a.fastq -o a_spades_assembly" and ("spades", "g", 1) in std and len(std) == 8
    batches = recommend.numbered_batches(g.select("group_id", F.explode("sample_names").alias("sample")))
    assert batches.where("group_id = 0 and batch = 1").count() == 2


def test_predictions(spark):
    g = spark.createDataFrame([("g", ["a", "b"], 0.05, 0.1, 0.9)], "group_id string, sample_names array<string>, avg_distance double, max_distance double, confidence double")
    r = recommend.predictions(g).first()
    assert (r["predicted_quality"], r["contamination_risk"], r["expected_contiguity_improvement"], r["expected_coverage_boost"], r["computational_cost_multiplier"]) == ("Very High", "Low", "1.9x", "1.6x", "2.8x")
    s = recommend.strategy_summary(g, 5).first()
    assert (s["total_assemblies"], s["individual_assemblies"], s["coassembly_percentage"]) == (4, 3, 40.0)


# ---- FASTQ


def fastq_text(seqs, qual="I"):
    return "".join(f"@r{i}\n{s}\n+\n{qual * len(s)}\n" for i, s in enumerate(seqs))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "fq"
    (d / "sub").mkdir(parents=True)
    (d / "sample001_R1.fastq").write_text(fastq_text(["ATCGATCGATCGATCGATCG", "acgtacgtac"]))
    (d / "sample001_R2.fastq").write_text(fastq_text(["TTCCGGAATTCCGGAATTCC"]))
    (d / "sub" / "sample002_1.fq.gz").write_bytes(gzip.compress(fastq_text(["CGATCGATCGATCGATCGAT"]).encode()))
    (d / "sub" / "sample002_2.fq.gz").write_bytes(gzip.compress(fastq_text(["GGAATTCCGGAATTCCGGAA"]).encode()))
    (d / "sample003.fq").write_text("bad\nACGT\n+\nIIII\n@ok\nACGTT\n+\nIIIII\n@s\nACG\n-\nIII\n@q\nACG\n+\nII\n@iupac\nACGR\n+\nIIII\n@cut\nACG\n")
    (d / "sample004_R2.fastq").write_text(fastq_text(["ACGTACGTACGT"]) + "\n\n@late\nAC\n+\nII\n")
    (d / "notes.txt").write_text("no reads")
    return str(d)


def test_discovery(spark, folder):
    files = fastq.list_files(spark, folder)
    assert files.count() == 6
    found = {r["sample"]: r for r in fastq.find_samples(files).collect()}
    assert {s: (r["layout"], len(r["paths"])) for s, r in found.items()} == {"sample001": ("paired", 2), "sample002": ("paired", 2), "sample003": ("single", 1), "sample004": ("single", 1)}
    assert found["sample001"]["paths"][0].endswith("_R1.fastq")
    s = fastq.summarize(fastq.find_samples(files)).first()
    assert (s["total_samples"], s["paired_samples"], s["single_samples"], s["total_files"]) == (4, 2, 2, 6) and s["total_bytes"] > 0
    assert fastq.has_fastq(spark, folder) and not fastq.has_fastq(spark, folder + "/none")
    both = {r["sample"]: r for r in fastq.find_pairs_by_substring(files).collect()}
    assert both["sample001"]["r2"].endswith("_R2.fastq") and both["sample004"]["r1"].endswith("_R2.fastq") and both["sample004"]["r2"] is None
    assert fastq.find_pairs_by_substring(files, keep_orphans=False).where("sample = 'sample004'").count() == 0
    assert fastq.manifest(fastq.find_pairs_by_substring(files)).where("sample = 'sample003'").first()["r2"] == "NA"


def test_reading(spark, folder):
    samples = fastq.find_samples(fastq.list_files(spark, folder))
    rows = fastq.read_samples(samples).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["sample"], r["mate"], r["read_no"])):
        by.setdefault(r["sample"], []).append(r["seq"])
    assert by["sample001"] == ["ATCGATCGATCGATCGATCG", "ACGTACGTAC", "TTCCGGAATTCCGGAATTCC"]
    assert by["sample002"] == ["CGATCGATCGATCGATCGAT", "GGAATTCCGGAATTCCGGAA"]
    assert by["sample003"] == ["ACGTT", "ACGR"] and by["sample004"] == ["ACGTACGTACGT"]
    bad = fastq.bad_records(fastq.read_records(spark, [folder + "/sample003.fq"])).collect()
    assert [r["reason"] for r in sorted(bad, key=lambda r: r["read_no"])] == ["header", "separator", "length", "warning: letters"]
    assert fastq.read_records(spark, [folder + "/sample001_R1.fastq"], max_reads=1).count() == 1


def test_metadata(spark, tmp_path):
    tsv, csv = tmp_path / "m.tsv", tmp_path / "m.csv"
    tsv.write_text("sample_id\tgroup\tage\nA\tx\t3\nB\t\t4\nZ\ty\t5\n")
    csv.write_text("sample_id,group,age\nA,x,3\n")
    m = metadata.read_metadata(spark, str(tsv))
    assert dict(m.dtypes)["age"] == "int" and m.columns[0] == "sample" and metadata.read_metadata(spark, str(csv), by="extension").count() == 1
    with pytest.raises(ValueError):
        metadata.read_metadata(spark, str(csv), id_col="name")
    samples = spark.createDataFrame([("A",), ("B",), ("C",)], "sample string")
    assert {r["sample"]: r["age"] for r in metadata.align(samples, m).collect()} == {"A": 3, "B": 4, "C": None}
    assert {r["sample"]: r["status"] for r in metadata.coverage(samples, m).collect()} == {"A": "common", "B": "common", "C": "missing", "Z": "extra"}
    assert [r["sample"] for r in metadata.empty_rows(metadata.align(samples, m)).collect()] == ["C"]
    assert metadata.guess_id_column(m, samples) == "sample"


def test_preprocessing(spark):
    r = spark.createDataFrame(
        [
            ("s", "f", 0, "A" * 60 + "G" * 12, "I" * 72), ("s", "f", 1, "A" * 60, "I" * 60), ("s", "f", 2, "C" * 40, "I" * 40), ("s", "f", 3, "C" * 60, "#" * 30 + "I" * 30),
            ("s", "f", 4, "N" * 6 + "C" * 60, "I" * 66), ("t", "f", 5, "A" * 60, "I" * 60), ("u", "f", 6, "T" * 10, "I" * 10),
        ],
        "sample string, file string, read_no long, seq string, qual string",
    )
    assert sorted(x["read_no"] for x in preprocess.clean_reads(r).collect()) == [0, 5]
    assert preprocess.clean_reads(r, quick=True).count() == 7 and preprocess.clean_reads(r, dedup=False).count() == 3
    summary = {x["sample"]: x["failed"] for x in preprocess.preprocessing_summary(r, preprocess.clean_reads(r)).collect()}
    assert summary == {"s": False, "t": False, "u": True}
    host = spark.createDataFrame([("AAAAA",)], "kmer string")
    assert sorted(x["read_no"] for x in preprocess.remove_host(r, host, 5).collect()) == [0, 2, 3, 4]


def test_read_queries_take_whole_texts(spark, tmp_path):
    """What lies behind the 80th letter counts: a wrong letter, a poly-G tail, and what tells two reads apart."""
    start = "ACGT" * 25
    texts = {1: start + "A", 2: start + "C", 3: start + "R", 4: start + "T" + "G" * 12, 6: start + "A"}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bad = {(r["read_no"], r["reason"]) for r in queries.bad_records(spark, str(tmp_path)).collect()}
    assert bad == {(3, "warning: letters")}
    kept = {r["read_no"]: (r["seq"], len(r["qual"])) for r in queries.quality_filter_dedup(spark, str(tmp_path)).collect()}
    assert kept == {1: (texts[1], 101), 2: (texts[2], 101), 3: (texts[3], 101), 4: (start + "T", 101)}


# ---- sinks, settings, whole runs


def test_results_round_trip(spark, tmp_path):
    p = pair_frame(spark, M3)
    prof = spark.createDataFrame([(s, "AC", 1, 1) for s in "ABCD"], "sample string, kmer string, cnt long, total long")
    results.save_results(prof, p, str(tmp_path / "r"))
    a, b, names = results.load_results(spark, str(tmp_path / "r"))
    assert a.count() == 4 and b.count() == 6 and names == list("ABCD")
    wide = spark.read.csv(str(tmp_path / "r" / "distance_matrix"), header=True, inferSchema=True)
    assert wide.columns == ["sample", *"ABCD"] and wide.where("sample = 'A'").first()["D"] == 0.9
    with pytest.raises(Exception, match="exists"):
        results.save_results(prof, p, str(tmp_path / "r"), overwrite=False)
    for kind in ("csv", "coo", "mtx"):
        results.save_similarity(p, prof, str(tmp_path / kind), kind)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "mtx")).collect()]
    assert lines[0].startswith("%%MatrixMarket") and lines[1] == "4 4 16" and lines[2] == "1 1 1.0"
    assert spark.read.parquet(str(tmp_path / "coo")).count() == 16
    with pytest.raises(ValueError):
        results.save_similarity(p, prof, str(tmp_path / "x"), "xml")


def test_config(tmp_path):
    c = config.Config().updated(k=15, metric="jaccard").checked()
    path = str(tmp_path / "c.json")
    config.save(c, path)
    assert config.load(path) == c and config.from_dict({"profile": {"k": 9}}).profile.k == 9 and config.Config().profile.k == 21
    for bad in ({"k": 33}, {"metric": "x"}, {"max_reads": 0}, {"threshold": 2.0}, {"min_clusters": 1}, {"sampling": "x"}, {"max_group_size": 0}):
        with pytest.raises(ValueError):
            config.Config().updated(**bad).checked()
    with pytest.raises(ValueError):
        config.Config().updated(nothing=1)
    with pytest.raises(ValueError):
        config.preset("nothing")
    assert all(config.preset(p).problems() == [] for p in config.PRESETS)
    assert config.from_environment(env={"HELIXSPARK_K": "11", "HELIXSPARK_SKETCH": "true", "HELIXSPARK_MAX_READS": "5"}).profile == config.ProfileConfig(k=11, sketch=True, max_reads=5)
    assert config.recommended(200, 64) == config.preset("large_dataset") and "even" not in config.Config().summary() and len(config.Config().updated(k=10).advice()) == 2
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_scalars(spark):
    df = spark.createDataFrame([(512,), (2048,), (5 * 1024**3,), (3 * 1024**4,)], "n long")
    assert [r[0] for r in df.select(scalars.file_size(F.col("n"))).collect()] == ["512.0 B", "2.0 KB", "5.0 GB", "3.0 TB"]
    p = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.07,), (0.5,)], "p double")
    assert [r[0] for r in p.select(stats.significance_code(F.col("p"))).collect()] == ["***", "**", "*", ".", ""]
    one = spark.range(1)
    assert one.select(scalars.runtime_seconds(F.lit(10), F.lit(21), F.lit(999))).first()[0] == pytest.approx(200 + 99.9)
    assert one.select(scalars.profiling_seconds(F.lit(2), F.lit(10000), F.lit(21))).first()[0] == 60.0
    assert one.select(scalars.safe_name(F.lit("a b/c"))).first()[0] == "a_b_c"


@pytest.mark.parametrize("variant", ["simple", "standard"])
def test_whole_run(spark, tmp_path, variant):
    d = tmp_path / "in"
    d.mkdir()
    base = {"a": "ATCGGATTACAGATCCGATTAGC" * 3, "b": "TTGACCGTAAGCTTGGCATCGAA" * 3}
    for i in range(6):
        kind = "a" if i < 3 else "b"
        (d / f"s{i}.fastq").write_text(fastq_text([base[kind][j : j + 40] for j in range(0, 20 + i)]))
    meta = tmp_path / "meta.csv"
    meta.write_text("sample_id,kind,n\n" + "".join(f"s{i},{'a' if i < 3 else 'b'},{i}\n" for i in range(6)))
    out = str(tmp_path / "out")
    c = config.Config().updated(k=7, permutations=19, variant=variant)
    tables = phases.run(spark, str(d), out, c, str(meta))
    assert tables["pairs"].count() == 15 and tables["variables"].orderBy("rank").first()["variable"] == "kind"
    assert {tuple(r["sample_names"]) for r in tables["groups"].collect()} == {("s0", "s1", "s2"), ("s3", "s4", "s5")}
    saved = json.loads(results.read_text(spark, out + "/assembly_recommendations/assembly_recommendations.json"))
    assert saved["strategy"] == "grouped" and len(saved["groups"]) == 2
    assert "megahit" in results.read_text(spark, out + "/assembly_recommendations/run_megahit_assemblies.sh")
    assert "kind" in results.read_text(spark, out + "/analysis_report.md")
    with pytest.raises(ValueError):
        phases.run(spark, str(tmp_path / "none"), out)


def test_sketched_and_lsh_runs(spark):
    reads = spark.createDataFrame([(f"s{i}", "f", j, "ACGTTGCA" * 4 + "ACGT"[i % 4] * 9) for i in range(5) for j in range(3)], "sample string, file string, read_no long, seq string")
    for method in config.SAMPLING:
        one = phases.run_phase1(reads, config.Config().updated(k=5, sketch=True, sketch_size=20, sampling=method))
        assert one.pairs.count() == 10
    for packed in (True, False):
        forced = phases.run_phase1(reads, config.Config().updated(k=5, packed=packed, method="lsh", metric="jaccard"))
        assert forced.pairs.count() == 10 and forced.pairs.where("similarity > 0.1").count() > 0
        assert forced.pairs.where("distance <> 1 - similarity").count() == 0
    assert "lsh estimates the jaccard metric only" in config.Config().updated(method="lsh").problems()


def test_nothing_switches_with_the_number_of_samples(spark):
    """51 samples, whose profiles share few k-mers: the metric stays, all pairs are there, and frequencies sum to 1."""
    reads = spark.createDataFrame([(f"s{i:02d}", "f", 0, "ACGT" * 3 + format(i, "06b").replace("0", "CA").replace("1", "GT")) for i in range(51)], "sample string, file string, read_no long, seq string")
    one = phases.run_phase1(reads, config.Config().updated(k=5))
    want = {(r["sample_a"], r["sample_b"]): r["distance"] for r in pairs.pairwise(one.profile, "braycurtis").collect()}
    assert {(r["sample_a"], r["sample_b"]): r["distance"] for r in one.pairs.collect()} == want and len(want) == 51 * 50 // 2
    fewer = phases.run_phase1(reads, config.Config().updated(k=5, common_share=0.5))
    assert fewer.pairs.count() == len(want)
    assert {(r["sample_a"], r["sample_b"]): r["distance"] for r in fewer.pairs.collect()} != want


def test_command_line(tmp_path):
    p = cli.parser()
    args = p.parse_args(["in", "-k", "11", "--metric", "jaccard", "--tools", "megahit", "--preset", "quick"])
    c = cli.settings(args)
    assert (c.profile.k, c.similarity.metric, c.grouping.tools, c.statistics.permutations) == (11, "jaccard", ("megahit",), 99)
    assert cli.main([str(tmp_path), "-k", "40"]) == 1


def test_preprocessing_run(spark, folder, tmp_path):
    from helixspark.plans import preprocessing

    host = tmp_path / "host.fa"
    host.write_text(">h1\nGGAATTCCGG\nAATTCCGGAA\n>h2\nACGTA\n")
    assert preprocessing.fasta_kmers(spark, str(host), 11).count() > 0
    summary, made = preprocessing.run(spark, folder, str(tmp_path / "out"), min_length=11, host=str(host), k=11)
    assert {r["sample"]: r["failed"] for r in summary.collect()} == {"sample001": False, "sample002": False, "sample003": True, "sample004": False}
    assert {r["sample"]: r["r2"] for r in made.collect()} == {"sample001": "NA", "sample002": "NA", "sample004": "NA"}
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "reads" / "sample=sample004")).collect()]
    assert lines == ["@r0", "ACGTACGTACGT", "+", "I" * 12]


def test_synthetic(spark):
    from helixspark.sources import synthetic

    reads = synthetic.reads(spark, 6, 30, 60, 2, 300)
    assert reads.count() == 180 and reads.where("length(seq) = 60 and seq rlike '^[ACGT]+$' and length(qual) = 60").count() == 180
    assert sorted(map(tuple, reads.collect())) == sorted(map(tuple, synthetic.reads(spark, 6, 30, 60, 2, 300).repartition(3).collect()))
    one = phases.run_phase1(reads, config.Config().updated(k=15))
    near = {(r["sample_a"], r["sample_b"]) for r in one.pairs.orderBy("distance").limit(6).collect()}
    assert all((int(a[-3:]) - int(b[-3:])) % 2 == 0 for a, b in near)
    meta = synthetic.metadata(spark, 6, 2)
    assert meta.count() == 6 and len(meta.columns) == 10


def test_entry():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "similar_pairs" in sql and len(names) >= 60


# ---- FASTQ in ranges


def brute_records(text):
    """Four lines at a time from the start of the file; a blank first line ends it."""
    lines = text.split("\n")
    for no, at in enumerate(range(0, len(lines) - 3, 4)):
        head, seq, plus, qual = (x.strip() for x in lines[at : at + 4])
        if not head:
            return
        yield no, head, seq.upper(), plus, qual


ODD_FASTQ = [
    "", "\n", "@a", "@a\nAC\n+\n", "@a\nAC\n+\nII", "@a\nAC\n+\nII\n", "@a\r\nac\r\n+\r\n@@\r\n@b\nG\n+\n@\n", "@a\n@C\n+@\n@I\n" * 7, "\n@a\nAC\n+\nII\n", "@a\nAC\n+\nII\n \t\n@b\nAC\n+\nII\n",
    "@a\n\n\n\n@b\nAC\n+\nII\nrest", "x\ny\nz\nw\n" * 9, "@é\nAC\n+\nII\n \nA\n+\nI\n", "@long\n" + "A" * 5000 + "\n+\n" + "I" * 5000 + "\n@b\nC\n+\nI\n",
]


@pytest.mark.parametrize("split", [1, 3, 7, 64, 1 << 20])
def test_ranges_equal_the_whole_file(tmp_path, split):
    rng = random.Random(split)
    texts = ODD_FASTQ + ["".join(rng.choice(["@h", "+", "AC", "", "\n", "\n", "\n", " ", "I@"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    for i, text in enumerate(texts):
        path = tmp_path / f"{i}.fq"
        path.write_text(text, newline="")
        raw = text.encode()
        starts = list(range(0, max(1, len(raw)), split))
        ends = [*starts[1:], fastq_scan.END]
        probed = [fastq_scan.probe(str(path), a, b, fastq_scan.END) for a, b in zip(starts, ends, strict=True)]
        first, stop = 0, fastq_scan.END
        begins = []
        for n, blank, error in probed:
            assert error is None
            begins.append(first)
            if blank[-first % 4] < fastq_scan.END:
                stop = min(stop, first + blank[-first % 4])
            first += n
        got = [(no, h, s.upper(), p, q) for a, b, line in zip(starts, ends, begins, strict=True) for no, (h, s, p, q) in fastq_scan.records_of(str(path), a, b, line, stop)]
        assert got == list(brute_records(text)), (i, split)


def test_scan_in_spark(spark, tmp_path):
    texts = {f"s{i}.fq": t for i, t in enumerate(ODD_FASTQ)} | {"big.fastq": fastq_text([f"ACGT{'ACGT'[i % 4] * (i % 50)}" for i in range(3000)])}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, newline="")
        (tmp_path / (name + ".gz")).write_bytes(gzip.compress(t.encode()))
    files = spark.createDataFrame([(str(tmp_path / n), n, 7) for name in texts for n in (name, name + ".gz")], "path string, name string, error_rate int")
    done = fastq_scan.scan(files, split_bytes=1000)
    assert done.failures.count() == 0 and done.records.where("error_rate <> 7").count() == 0
    got = {}
    for r in done.records.collect():
        got.setdefault(r["name"], []).append((r["read_no"], r["header"], r["seq"], r["plus"], r["qual"]))
    for name, t in texts.items():
        assert sorted(got.get(name, [])) == sorted(got.get(name + ".gz", [])) == list(brute_records(t))
    few = fastq_scan.scan(files.where("name like 'big%'"), max_reads=5).records
    assert sorted((r["name"], r["read_no"]) for r in few.collect()) == [(n, i) for n in ("big.fastq", "big.fastq.gz") for i in range(5)]
    assert fastq_scan.scan(files.limit(0)).records.count() == 0


def test_max_reads_stops_early(tmp_path):
    path = tmp_path / "x.fq"
    path.write_text(fastq_text(["ACGT"] * 1000))
    seen = []
    real = fastq_scan.lines_from
    fastq_scan.lines_from = lambda *a: (seen.append(x) or x for x in real(*a))
    try:
        assert len(list(fastq_scan.records_of(str(path), 0, fastq_scan.END, 0, 8))) == 2 and len(seen) <= 9
    finally:
        fastq_scan.lines_from = real


def test_broken_files_are_named_and_others_read(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"sample{i}.fq.gz").write_bytes(gzip.compress(fastq_text(["ACGTACGT"] * 2000).encode()))
    whole = (tmp_path / "sample4.fq.gz").read_bytes()
    (tmp_path / "sample4.fq.gz").write_bytes(whole[: len(whole) // 2])
    done = fastq.scan_samples(fastq.find_samples(fastq.list_files(spark, str(tmp_path))))
    assert {r["sample"]: r["count"] for r in done.records.groupBy("sample").count().collect()} == {f"sample{i}": 2000 for i in range(10) if i != 4}
    assert [(r["sample"], r["mate"], "EOFError" in r["error"]) for r in done.failures.collect()] == [("sample4", "1", True)]
    with pytest.raises(OSError):
        fastq.read_records(spark, [str(tmp_path / "sample4.fq.gz")])
    (tmp_path / "sample5.fq.gz").write_bytes(b"no gzip")
    gone = spark.createDataFrame([(str(tmp_path / "none.fq"),), (str(tmp_path / "sample5.fq.gz"),), (str(tmp_path / "sample6.fq.gz"),)], "path string")
    again = fastq_scan.scan(gone)
    assert again.records.count() == 2000 and {r["error"].split(":")[0] for r in again.failures.collect()} == {"FileNotFoundError", "BadGzipFile"}


# ---- adapters


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def brute_insert(a, b, least=20, percent=10):
    best = None
    for length in range(least, min(len(a), len(b)) + 1):
        wrong = sum(x != y for x, y in zip(a[:length], rc(b[:length]), strict=True))
        if wrong * 100 <= percent * length:
            best = min([(wrong / length, -length), *([best] if best else [])])
    return None if best is None or -best[1] >= max(len(a), len(b)) else -best[1]


def test_adapters_by_overlap(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, two = queries.ADAPTERS
    rows = []
    for i in range(300):
        insert = some(rng.randrange(15, 110))
        a, b = (insert + one + some(90))[:80], (rc(insert) + two + some(90))[: rng.choice([80, 80, 60])]
        a = "".join(rng.choice("ACGTN") if rng.random() < 0.02 else x for x in a)
        rows += [("s", i, "1", a, "I" * len(a)), ("s", i, "2", b, "I" * len(b))]
    rows += [("s", 900, "1", "ACGT", "IIII"), ("s", 901, "1", "", ""), ("s", 901, "2", "ACGT", "IIII"), ("s", 902, "1", "A" * 80, "I" * 80), ("s", 902, "2", "T" * 80, "I" * 80)]
    reads = spark.createDataFrame(rows, "sample string, read_no long, mate string, seq string, qual string")
    found = adapters.overlaps(adapters.mates(reads))
    got = {r["read_no"]: r for r in found.collect()}
    assert set(got) == {*range(300), 901, 902}
    assert {i: r["insert_length"] for i, r in got.items()} == {i: brute_insert(r["seq1"], r["seq2"]) for i, r in got.items()}
    assert sum(r["insert_length"] is not None for r in got.values()) > 150
    cut = {r["read_no"]: r for r in adapters.trimmed(found).collect()}
    assert all(len(cut[i]["seq1"]) == len(cut[i]["qual1"]) == (r["insert_length"] or len(r["seq1"])) and cut[i]["trimmed"] == (r["insert_length"] is not None) for i, r in got.items())
    named = {r["mate"]: r["adapter"] for r in adapters.adapter_sequences(found).collect()}
    assert named["1"].startswith(one[:25]) and named["2"].startswith(two[:25])
    single = adapters.trim_adapter(reads.where("mate = '1'"), one)
    for r in single.collect():
        seq = got[r["read_no"]]["seq1"] if r["read_no"] in got else "ACGT"
        places = [at for at in range(max(0, len(seq) - 8) + 1) if 8 <= len(seq) - at and sum(x != y for x, y in zip(seq[at:], one, strict=False)) * 100 <= 10 * min(len(one), len(seq) - at)]
        assert r["seq"] == seq[: min(places, default=len(seq))] and len(r["qual"]) == len(r["seq"])
    assert adapters.overlaps(adapters.mates(reads.limit(0))).count() == 0


def test_expressions_of_reads_are_evaluated_once(spark):
    """filters repeated the letters' regular expression; rows are sorted by a hash before whole reads."""
    from helixspark import queries

    cleaned = queries.QUERIES["quality_filter_dedup"](spark, "/root/testdata/sf0.001")
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    assert "xxhash64" in plan


def test_small_ranges_share_tasks(spark, tmp_path):
    """a task for each of 2,500 ranges took longer than their records."""
    (tmp_path / "a.fastq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(2500)))
    from helixspark.sources import fastq_scan

    records = fastq_scan.scan(spark.createDataFrame([(str(tmp_path / "a.fastq"),)], "path string"), split_bytes=16).records
    assert records.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["header"] for r in records.collect()) == sorted(f"@r{i}" for i in range(2500))
