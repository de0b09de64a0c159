"""The pipeline on planted documents, stage by stage against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixspark.plans import scratch
from tests.llm.test_dedup import brute_components, edited, prose, shingle_set, words

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of each stage over documents with planted cases."""
    rng = random.Random(20)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    clean = [prose(rng, 150) + "." for _ in range(30)]
    passage = prose(rng, 60)
    rows = {1_000_000 + i: t for i, t in enumerate(clean)}
    rows |= {2_000_000 + i: clean[i] for i in range(5)}  # exact copies
    rows |= {3_000_000 + i: edited(rng, clean[10 + i], 1) for i in range(5)}  # near copies
    for i in range(4):  # one passage in four documents
        w = prose(rng, 200).split(" ")
        rows[4_000_000 + i] = " ".join(w[: 30 * i + 5]) + " " + passage + " " + " ".join(w[30 * i + 5 :])
    rows |= {5_000_000: "", 5_000_001: None}
    planted = spark.createDataFrame([(i, t, "en", "planted", None if t is None else len(t)) for i, t in rows.items()], docs.schema)
    table, out = docs.unionByName(planted), []
    for name, stage in corpus_pipeline.STAGES:
        made = scratch.keep(stage(spark, table, D), "test-stage")
        out.append((name, table, made))
        table = made
    return rows, passage, out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_return_the_columns_of_documents(stages):
    _, _, out = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, *_ in out] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    assert all(made.columns == columns for *_, made in out[:-1])
    assert all(made.join(table, ["doc_id"], "left_anti").count() == 0 for _, table, made in out)


def test_quality_stage_keeps_clean_documents(stages, spark):
    rows, _, out = stages
    _, table, made = out[0]
    assert {i for i in rows if i < 5_000_000} <= ids(made)
    labels = spark.read.parquet(f"{D}/labels.parquet")
    bad = ids(labels.where("quality = 0"))
    good = ids(labels.where("quality = 1"))
    assert len(good - ids(made)) <= 0.02 * len(good) and len(bad & ids(made)) <= 0.1 * len(bad)


def test_exact_stage_equals_brute_force(stages):
    _, table, made = stages[2][1]
    first = {}
    for r in table.collect():
        first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    assert ids(made) == set(first.values()) and made.count() == len(first)


def test_near_stage_equals_brute_force(stages):
    _, table, made = stages[2][2]
    rows = table.select("doc_id", "text").collect()
    sets = [shingle_set(r["text"]) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], sets)
    assert ids(made) == {i for i, c in want.items() if i == c}


def test_passage_stays_once(stages):
    rows, passage, out = stages
    _, table, made = out[3]
    texts = {r["doc_id"]: r["text"] for r in made.collect()}
    before = {r["doc_id"]: r["text"] for r in table.collect()}
    held = words(passage)
    runs = [" ".join(held[i : i + 30]) for i in range(len(held) - 29)]
    with_passage = [i for i, t in texts.items() if t and any(r in " ".join(words(t)) for r in runs)]
    assert with_passage == [4_000_000]
    for i in range(1, 4):
        rest = words(texts[4_000_000 + i])
        assert 200 <= len(rest) <= 260 - 35
    for i in range(1_000_005, 1_000_010):
        assert texts[i] == before[i]  # documents without repeats are left alone


def test_packing_takes_every_token(stages):
    from helixspark.llm.packing import word_count

    _, table, made = stages[2][4]
    tokens = table.select(F.sum(word_count(F.coalesce("text", F.lit(""))))).first()[0]
    assert made.agg(F.sum("n_tokens")).first()[0] == tokens


def test_run_on_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    labels = spark.read.parquet(f"{D}/labels.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, ties, and extra columns with names that stages use inside."""
    rng = random.Random(30)
    one, two, line = prose(rng, 80), prose(rng, 90), prose(rng, 45)
    texts = [
        (1, one), (1, one), (None, one), (2, edited(rng, one, 1)), (3, None), (4, ""), (4, "  "), (None, None), (5, two), (6, f"{two}x\n{line}"), (7, f"{prose(rng, 60)}\n{line}"), (8, "w " * 60_000), (9, "short"), (9, "other text"),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, th long, kept boolean, component_id long, span string"
    docs = spark.createDataFrame([(i, t, "en", "odd", None if t is None else len(t), n, "k", 7, None, n % 3, "x") for n, (i, t) in enumerate(texts)], columns)
    named = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("quality", "exact_dedup", "near_dedup", "substring_dedup"):
        made = named[name](spark, docs, D)
        assert made.columns == docs.columns and named[name](spark, docs.limit(0), D).count() == 0
        got[name] = {r["id"]: r for r in made.collect()}
        assert all(r["key"] == "k" and r["component_id"] == n % 3 and r["doc_id"] == texts[n][0] for n, r in got[name].items())
    assert {texts[n][1] or "" for n in got["exact_dedup"]} == {t or "" for _, t in texts} and len(got["exact_dedup"]) == len({t or "" for _, t in texts})
    near = {n: shingle_set(t) for n, (_, t) in enumerate(texts)}
    assert {2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13} <= set(got["near_dedup"]) and 3 not in got["near_dedup"] and {0, 1} <= set(got["near_dedup"])
    assert len(near[0] & near[3]) * 100 >= 75 * len(near[0] | near[3])
    cut = got["substring_dedup"]
    assert line in cut[9]["text"] and line not in cut[10]["text"] and cut[10]["n_chars"] == len(cut[10]["text"])
    assert all(cut[n]["text"] == texts[n][1] for n in (0, 1, 2, 4, 5, 6, 7, 8, 11, 12, 13))
    packed = named["packing"](spark, docs, D).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(words(t)) for _, t in texts) and len([r for r in packed if r["bucket"] is None]) == 4
    assert named["packing"](spark, docs.limit(0), D).count() == 0
