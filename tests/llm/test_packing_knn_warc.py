import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.llm import knn, packing, queries, warc

D = "/root/testdata/sf0.001"


def brute_padding(hist, k):
    lengths = sorted(hist)
    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for tops in itertools.combinations(lengths[:-1], n - 1):
            bounds = [*tops, lengths[-1]]
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist.items())
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(40):
        hist = {rng.randrange(1, 60): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        for k in (1, 2, 3, 20):
            plan = packing.best_boundaries(hist, k)
            assert plan.padding == brute_padding(hist, k) and len(plan.boundaries) <= k
            assert plan.padding == sum(c * (min(b for b in plan.boundaries if b >= x) - x) for x, c in hist.items())
    assert packing.best_boundaries({}, 4).boundaries == ()


def test_pack(spark):
    rng = random.Random(1)
    texts = [None, "", "one", *[" ".join("w" for _ in range(rng.randrange(1, 90))) for _ in range(300)], *["dup dup"] * 40]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, batch int, n int")
    rows = packing.pack(docs, max_len=32, n_buckets=4, token_budget=100, share_rows=50).collect()
    tokens = {}
    for r in rows:
        tokens[r["id"]] = tokens.get(r["id"], 0) + r["n_tokens"]
        assert r["n_tokens"] <= 32 and r["start_token"] == 32 * r["piece"]
    assert tokens == {i: len((t or "").split()) for i, t in enumerate(texts)}
    placed = [r for r in rows if r["bucket"] is not None]
    assert {r["id"] for r in rows if r["bucket"] is None} == {0, 1}
    tops = sorted({r["bucket_len"] for r in placed})
    assert all(r["bucket_len"] == min(t for t in tops if t >= r["n_tokens"]) for r in placed)
    batches = {}
    for r in placed:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (b, n), own in batches.items():
        held = max(1, 100 // own[0]["bucket_len"])
        last = max(x for y, x in batches if y == b)
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and (len(own) == held or (n == last and len(own) < held))
    assert packing.pack(docs.limit(0)).count() == 0


def test_pack_query_is_whole(spark):
    rows = queries.op2_packing(spark, D)
    words = spark.read.parquet(f"{D}/documents.parquet").select(F.sum(packing.word_count(F.coalesce("text", F.lit(""))))).first()[0]
    assert rows.agg(F.sum("n_tokens")).first()[0] == words


# ---- top-k


def brute_top(vectors, asked, k):
    out = []
    for q, v in asked:
        scores = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    points = [(i, [int(x) for x in rng.integers(-40, 40, 6)]) for i in range(700)] + [(900 + i, [7] * 6) for i in range(60)] + [(990, [1, 2]), (991, [3, 4]), (992, None), (None, [1] * 6)]
    df = spark.createDataFrame(points, "vec_id long, v array<long>")
    got = knn.top_k(df, df.where("vec_id % 20 = 0"), k=9, shard_rows=150, block_rows=16, leaf_size=20)
    good = [(i, v) for i, v in points if i is not None and v is not None]
    assert sorted(map(tuple, got.collect())) == brute_top(good, [x for x in good if x[0] % 20 == 0], 9)
    assert knn.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_large_numbers_stays_exact(spark):
    big = 2**30
    df = spark.createDataFrame([(0, [big, 1]), (1, [big, 2]), (2, [big, 3]), (3, [-big, 5])], "vec_id long, v array<long>")
    rows = knn.top_k(df, df.where("vec_id = 0"), k=2).collect()
    assert sorted(map(tuple, rows)) == [(0, 1, 2, big * big + 3), (0, 2, 1, big * big + 2)]


def test_top_k_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [10**10 + i, 1]) for i in range(30)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="do not fit in 64 bits"):
        knn.top_k(df, df.where("vec_id = 0"), k=2).collect()


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (0, [2, 0]), (1, [5, 0]), (1, [5, 0]), (2, [4, 1]), (3, [1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = knn.top_k(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert list(map(tuple, got)) == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 2, 4)]


def test_quantised(spark):
    rows = [(1, [0.5, -0.01]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, e array<float>").select("i", knn.quantised(F.col("e"))).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: None}


# ---- WARC


def test_canonical_url(spark):
    cases = {
        "HTTPS://WWW.Example.org:443/A/b/?utm_source=x&b=2&a=1#top": "example.org/A/b?a=1&b=2",
        "http://m.example.org": "example.org", "http://example.org/?ref=x": "example.org", " example.org/p ": "example.org/p", None: None, "": "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", warc.canonical_url(F.col("u"))).collect()} == cases


RECORDS = "record_id long, url string, ts long, kind string, headers map<string,string>, body string, status string"


def test_resolution(spark):
    r = [
        (1, "http://a.org/x", 10, "response", {"ETag": "v1", "Content-Type": "text/html", "Date": "d1"}, "one", None),
        (2, "http://www.a.org/x/", 20, "revisit", {"etag": "v1", "date": "d2", "Content-Type": "message/http"}, None, None),
        (3, "http://a.org/x", 30, "response", {"ETag": "v2"}, "two", None),
        (4, "http://a.org/x", 40, "revisit", {"ETag": "v1"}, None, None),
        (5, "http://a.org/x", 9000, "revisit", {"ETag": "v2", "Cache-Control": "no"}, None, None),
        (6, "http://a.org/y", 1, "revisit", {"ETag": "v1"}, None, None),
        (7, "http://a.org/x", 5, "revisit", {"ETag": "v1"}, None, None),
        (8, None, 50, "revisit", {"ETag": "v2"}, None, None),
        (9, "http://a.org/x", None, "revisit", None, None, None),
        (10, "http://a.org/x", 30, "revisit", {"Last-Modified": "m"}, None, None),
        (11, "http://b.org", 1, "response", {"Last-Modified": "m"}, "", None),
        (12, "http://b.org/", 1, "revisit", {"LAST-MODIFIED": "m"}, None, None),
        (13, "http://b.org/", 2, "revisit", {}, None, None),
    ]
    got = {x["record_id"]: x for x in warc.resolve_revisits(spark.createDataFrame(r, RECORDS)).collect()}
    assert len(got) == len(r)
    want = {1: "response", 2: "resolved", 3: "response", 4: "validator_mismatch", 5: "resolved", 6: "no_response", 7: "no_response", 8: "no_response", 9: "no_response", 10: "validator_mismatch", 11: "response", 12: "resolved", 13: "validator_mismatch"}
    assert {i: x["status"] for i, x in got.items()} == want
    assert (got[2]["refers_to"], got[2]["body"], got[2]["headers"]) == (1, "one", {"etag": "v1", "date": "d2", "content-type": "text/html"})
    assert (got[5]["refers_to"], got[5]["body"], got[5]["headers"]) == (3, "two", {"etag": "v2", "cache-control": "no"})
    assert got[12]["body"] == "" and got[4]["body"] is None and got[9]["headers"] == {}


def test_resolution_of_nothing(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_resolution_gives_one_row_a_record(spark):
    r = [
        (1, "http://a.org/x", 10, "response", {"ETag": "v1"}, "one", None),
        (2, "http://a.org/x", 20, "revisit", {"ETag": "v1"}, None, None),
        (2, "http://a.org/x", 20, "revisit", {"ETag": "v2"}, None, None),
        (3, "http://a.org/x", 30, None, {"A": "b"}, "kept", None),
        (4, "http://a.org/x", 40, "metadata", None, None, None),
        (None, "http://a.org/x", 50, "revisit", {"ETag": "v1"}, None, None),
        (None, None, None, None, None, None, None),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(r, RECORDS)).collect()
    assert sorted((str(x["record_id"]), x["status"], x["body"]) for x in got) == sorted([
        ("1", "response", "one"), ("2", "resolved", "one"), ("2", "validator_mismatch", None), ("3", "other", "kept"), ("4", "other", None), ("None", "no_response", None), ("None", "other", None),
    ])


def test_resolution_of_one_hot_url(spark):
    """All records have one URL and few distinct times; the last response before each is found across slots."""
    r = [(i, "http://a.org/x", i // 400, "response" if i % 50 == 0 else "revisit", {"ETag": f"v{i // 50}"}, f"b{i // 50}" if i % 50 == 0 else None, None) for i in range(2000)]
    got = {x["record_id"]: x for x in warc.resolve_revisits(spark.createDataFrame(r, RECORDS)).collect()}
    assert len(got) == len(r)
    assert all(got[i]["status"] == "resolved" and got[i]["refers_to"] == i - i % 50 and got[i]["body"] == f"b{i // 50}" for i in got if i % 50)


def test_registered_captures_resolve(spark):
    rows = queries.op10_warc(spark, D).groupBy("status").count().collect()
    found = {x["status"]: x["count"] for x in rows}
    assert found["resolved"] > 0.6 * (found["resolved"] + found.get("validator_mismatch", 0) + found.get("no_response", 0))
    assert found["validator_mismatch"] > 0
