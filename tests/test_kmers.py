import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.functions import kmers
from helixspark.operators import profiles, sketch

RC = str.maketrans("ACGT", "TGCA")


def brute(read, k):
    out = []
    for seg in re.split("N+", read.upper()):
        if re.fullmatch("[ACGT]+", seg or ""):
            out += [min(w, w[::-1].translate(RC)) for w in (seg[i : i + k] for i in range(len(seg) - k + 1))]
    return out


def reads(spark, rows):
    return spark.createDataFrame([(s, "f", i, q) for i, (s, q) in enumerate(rows)], "sample string, file string, read_no long, seq string")


def counted(df):
    return {(r["sample"], r["kmer"]): r["cnt"] for r in df.collect()}


def test_reverse_complement(spark):
    df = spark.createDataFrame([("ATCG",), ("AAAA",), ("ANRT",)], "s string")
    assert [r[0] for r in df.select(kmers.reverse_complement(F.col("s"))).collect()] == ["CGAT", "TTTT", "ARNT"]


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([("ATCG",), ("ATC",), ("ATCN",), ("AAAA",), ("TTTT",)], "s string")
    packed = df.select("s", kmers.pack(F.col("s"), 4).alias("p"))
    assert [r["p"] for r in packed.collect()] == [54, None, None, 0, 255]
    assert [r[0] for r in packed.where("p is not null").select(kmers.unpack(F.col("p"), 4)).collect()] == ["ATCG", "AAAA", "TTTT"]
    for k in (5, 21, 31):
        s = "".join(random.Random(k).choice("ACGT") for _ in range(k))
        one = spark.createDataFrame([(s,)], "s string").select(kmers.pack(F.col("s"), k).alias("p"))
        row = one.select(kmers.unpack(F.col("p"), k), kmers.unpack(kmers.reverse_complement_packed(F.col("p"), k), k)).first()
        assert tuple(row) == (s, s[::-1].translate(RC))


@pytest.mark.parametrize("pair", [("AAAAA", "TTTTT"), ("ATCGA", "TCGAT"), ("ACGTG", "CACGT")])
def test_canonical_pairs(spark, pair):
    df = spark.createDataFrame([(p,) for p in pair], "s string")
    assert len({r[0] for r in df.select(kmers.canonical(F.col("s"))).collect()}) == 1


def test_limits_of_k():
    for bad in (0, 33):
        with pytest.raises(ValueError):
            kmers.check_k(bad)
    with pytest.raises(ValueError):
        kmers.check_k(32, packed=True)


@pytest.mark.parametrize("k", [1, 4, 5, 11, 15, 21, 25, 31])
def test_packed_equals_strings_equals_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice("ab"), "".join(rng.choice("ACGT" * 6 + "acgtN") for _ in range(rng.randrange(0, 90)))) for _ in range(40)]
    rows += [("a", ""), ("b", None), ("a", "ACGR" * 20 + "N" + "ACGTT" * 8), (None, "ACGTACGTAC" * 5), ("b", "ATCGATCGANATCGATCGATC")]
    want = {}
    for s, q in rows:
        for w in brute(q or "", k):
            want[(s, w)] = want.get((s, w), 0) + 1
    df = reads(spark, rows)
    assert counted(profiles.with_strings(profiles.kmer_counts(df, k), k)) == want
    assert counted(profiles.kmer_counts(df, k, packed=False)) == want


def test_k_32_falls_back_to_strings(spark):
    df = reads(spark, [("a", "ACGT" * 10)])
    assert counted(profiles.kmer_counts(df, 32)) == {("a", w): c for w, c in {w: brute("ACGT" * 10, 32).count(w) for w in brute("ACGT" * 10, 32)}.items()}


def test_counts_of_one_read(spark):
    read = "".join(random.Random(1).choice("ACGT") for _ in range(52))
    for k in (5, 11, 15, 21, 25, 31):
        assert profiles.kmer_counts(reads(spark, [("s", read)]), k).agg(F.sum("cnt")).first()[0] == 52 - k + 1
    assert profiles.kmer_counts(reads(spark, [("s", "ATCGATCGATCG")]), 15).count() == 0


def test_windows_across_reads_and_spoilt_segments():
    data = np.frombuffer(b"ACGTACNNACGRACGNTTTT", dtype=np.uint8)
    kmer, read = kmers.packed_windows(data, np.array([0, 3, 3, 20]), 3)
    assert read.tolist() == [0] + [2] * 3 and len(kmer) == 4


def test_profile_sums_and_filters(spark):
    df = reads(spark, [("s", "ATCGATCGATCGATCGATCG")] * 10 + [("t", "ACGTTGCATT")])
    counts = profiles.kmer_counts(df, 5)
    freq = profiles.frequencies(profiles.profile(counts)).groupBy("sample").agg(F.sum("freq").alias("x")).collect()
    assert all(abs(r["x"] - 1) < 1e-9 for r in freq) and len(freq) == 2
    kept = profiles.profile(counts, 10).collect()
    assert {r["sample"] for r in kept} == {"s"} and all(r["cnt"] >= 10 for r in kept) and sum(r["cnt"] for r in kept) == kept[0]["total"]
    maps = {r["sample"]: r["profile"] for r in profiles.as_maps(profiles.profile(counts)).collect()}
    assert abs(sum(maps["t"].values()) - 1) < 1e-9


def test_capped_reads(spark):
    df = spark.createDataFrame([("s", f, i, "A") for f in ("r1", "r2") for i in range(5)], "sample string, file string, read_no long, seq string")
    assert profiles.cap_reads(df, None).count() == 10
    assert sorted((r["file"], r["read_no"]) for r in profiles.cap_reads(df, 3).collect()) == [("r1", 0), ("r1", 1), ("r1", 2)]
    assert profiles.cap_reads(df, 3, scope="file").count() == 6


def test_common_kmers(spark):
    rows = [(f"s{i:02}", k, 1, 2) for i in range(60) for k in ("shared", f"own{i}")]
    prof = spark.createDataFrame(rows, "sample string, kmer string, cnt long, total long")
    assert profiles.common_only(prof).select("kmer").distinct().collect()[0][0] == "shared" and profiles.common_only(prof).count() == 60
    assert profiles.common_only(prof.where("kmer <> 'shared'")).count() == 60
    assert profiles.common_only(prof.where("sample < 's10'")).count() == 20


@pytest.mark.parametrize("method", ["frequency", "reservoir", "adaptive"])
def test_sketches(spark, method):
    rng = random.Random(3)
    counts = spark.createDataFrame([(s, f"K{i:03}", rng.randrange(1, 9)) for s in "ab" for i in range(200)], "sample string, kmer string, cnt long")
    made = sketch.sketch(counts, 50, method, seed=1)
    rows = made.collect()
    again = sketch.sketch(counts.repartition(5), 50, method, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for s in "ab":
        own = [r for r in rows if r["sample"] == s]
        assert 0 < len(own) <= 50 and all(r["cnt"] > 0 for r in own) and sum(r["cnt"] for r in own) == own[0]["total"]
    if method == "reservoir":
        assert all(r["total"] == 50 for r in rows)
    stats = sketch.sketch_statistics(made, 50).collect()
    assert all(0 < r["min_frequency"] <= r["average_frequency"] <= r["max_frequency"] <= 1 for r in stats)
    with pytest.raises(ValueError):
        sketch.sketch(counts, 50, "other")


def test_streaming_counts(spark, tmp_path):
    from helixspark.streaming.incremental import start

    source = str(tmp_path / "in")
    rows = [("a", "ACGTACGTTT"), ("b", "ACGGGT"), ("a", "ACGTA")]
    spark.createDataFrame(rows[:2], "sample string, seq string").write.mode("append").json(source)
    stream = spark.readStream.schema("sample string, seq string").json(source)
    q = start(stream, 3, "counted", str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        spark.createDataFrame(rows[2:], "sample string, seq string").write.mode("append").json(source)
        q.processAllAvailable()
        got = counted(spark.table("counted"))
    finally:
        q.stop()
    batch = spark.createDataFrame(rows, "sample string, seq string")
    assert got == counted(profiles.kmer_counts(batch, 3))


def test_blocks_of_letters_give_the_windows_of_the_whole(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGTacgtACGTACGTN" + ("R" if i % 3 == 0 else "")) for _ in range(n)) for i, n in enumerate((0, 5, 40, 700, 0, 3, 90, 501, 0))] + ["ACGT" * 60]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    for k in (1, 5, 11):
        kmer, read = kmers.packed_windows(data, offsets, k)
        whole = sorted(zip(read.tolist(), kmer.tolist(), strict=True))
        for letters in (1, 16, 64, 10_000):
            blocks = list(kmers.window_blocks(data, offsets, k, letters))
            assert sorted(x for kmer, read in blocks for x in zip(read.tolist(), kmer.tolist(), strict=True)) == whole
            assert max(len(kmer) for kmer, _ in blocks) <= letters or letters >= len(data)


def test_sets_of_reads_longer_than_a_block(spark):
    rng = random.Random(9)
    read = "".join(rng.choice("ACGT") for _ in range(kmers.BLOCK_LETTERS + 5000))
    df = reads(spark, [("a", read + read[:9000]), ("b", "ACGTACGT")]).coalesce(1)
    got = kmers.packed_sets(df, 13, ["sample"])
    assert got.count() == got.distinct().count() > 1_000_000
    one = kmers.packed_counts(df, 13).groupBy("sample").agg(F.sum("cnt").alias("n"))
    assert {r["sample"]: r["n"] for r in one.collect()} == {"a": len(read) + 9000 - 12}


@pytest.mark.parametrize("margin", [12, -100])
def test_reservoir_sorts_few_occurrences_and_draws_the_first_of_all(spark, monkeypatch, margin):
    monkeypatch.setattr(sketch, "MARGIN", margin)  # -100: bounds so low that they must grow
    rows = [(s, f"k{i}", 1 + (i * 7) % 40) for s, n in (("a", 300), ("b", 3), (None, 60)) for i in range(n)]
    counts = spark.createDataFrame(rows, "sample string, kmer string, cnt long")
    ranked = []
    below = sketch._below
    monkeypatch.setattr(sketch, "_below", lambda *given: ranked.append(below(*given)) or ranked[-1])
    got = {(r["sample"], r["kmer"]): r["cnt"] for r in sketch.reservoir_sketch(counts, 50, seed=7).collect()}
    want = Counter()
    for s in ("a", "b", None):
        each = [(hashlib.md5(f"{k}#{i}#7".encode()).hexdigest(), k, i) for t, k, c in rows if t == s for i in range(1, c + 1)]
        want.update((s, k) for _, k, _ in sorted(each)[:50])
    assert got == want
    assert len(ranked) == 1 if margin > 0 else len(ranked) > 1
    assert margin < 0 or ranked[0].count() < 1000 < sum(c for *_, c in rows) / 5
