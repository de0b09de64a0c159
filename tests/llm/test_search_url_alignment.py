import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.llm import lexical_search, queries, token_alignment, url_filter

D = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- ranked lexical search


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms_of(t))
    out = []
    for item, bag in asked.items():
        scored = []
        for doc, b in bags:
            norm = 25 + (75 * sum(b.values()) * n_docs) // max(1, length)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * norm)) for t, c in bag.items() if b[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice(["", "x", "É", "7", "日本"]) * (rng.random() < 0.4)
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " ,.;"), (503, "A-b_c\x00d A"), (504, "a " * 40_000), (None, "a b c"), (7, "a b c"), (7, "a b c"), (505, "d" * 100_000)] + [(600 + i, "same words here Q") for i in range(30)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(50, None), (51, "zzz"), (52, "same HERE"), (None, "a"), (53, "a a b"), (53, "c"), (54, "a " * 300 + "b")]
    frame = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, n int, terms int, id int")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    expected = brute_search(docs, items, 10)
    got = lambda: sorted(map(tuple, lexical_search.top_documents(frame, asked).collect()))
    assert got() == expected
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 30)
    assert got() == expected
    for d, i in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame.limit(0), asked.limit(0))):
        assert lexical_search.top_documents(d, i).count() == 0


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    n = 20_000
    document = np.repeat(np.arange(n), 3)
    term = np.tile(np.arange(3), n)
    rare = rng.random(n) < 0.002
    held = (term != 0) | rare[document]
    document, term = document[held], term[held]
    impact = rng.integers(1, 50, len(document))
    weights = np.array([100_000, 30, 20])
    index = lexical_search.ImpactIndex(document, term, impact, n, 3)
    found, scores = index.search(np.arange(3), weights, 10)
    whole = np.bincount(document, weights=weights[term] * impact, minlength=n).astype(np.int64)
    order = np.lexsort((np.arange(n), -whole))[:10]
    best = np.lexsort((found, -scores))[:10]
    assert found[best].tolist() == order.tolist() and scores[best].tolist() == whole[order].tolist()
    assert index.touched < len(document) / 2


def test_search_keeps_ties():
    document = np.arange(50)
    index = lexical_search.ImpactIndex(document, np.zeros(50, dtype=np.int64), np.full(50, 7), 50, 1)
    found, scores = index.search(np.array([0]), np.array([2]), 3)
    assert found.tolist() == list(range(50)) and set(scores.tolist()) == {14}


# ---- URL filter

URLS = [
    "http://A.Example.NET/en/1", "https://x.net/", "https://x.net", "http://net/a", "https://b.example.com/de/7?x=1", "https://example.com/de", "https://www.y.org/fr/9#z", "ftp://y.org/FR/9",
    "https://notexample.net.org/en/", None, "", "no scheme", "https://q.example.net?a=/en/", "HTTP://U@h.NET:80/p?q#r", "x://y://z/w", "https://münchen.de/ü", "http://e.com/" + "a1" * 50_000,
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def brute_features(url, path):
    url = url or ""
    n = len(url)
    cap = lambda x: max(0, min(31, math.floor(x)))
    entropy = math.log2(n) - sum(c * math.log2(c) for _, c in sorted(Counter(url).items()) if c > 1) / n if n else 0.0
    query = re.match(r"[^?#]*\?([^#]*)", url)
    return [cap(3 * math.log2(n + 1)), cap(len([x for x in path.split("/") if x])), cap(31 * len(re.findall("[0-9]", url)) / n) if n else 0, cap(4 * entropy), cap(len([x for x in query[1].split("&") if x])) if query else 0]


def brute_verdicts(rows, rounds=8, depth=3, rate=0.4, unit=1 << 20):
    """Verdicts of (id, url, fold, label bucket, domain bucket): boosting with every labelled URL as a row of its own."""
    data = []
    for _, url, fold, *buckets in rows:
        host, path = brute_parts(url)
        data.append((brute_rule(host, path), brute_features(url, path), fold, buckets))
    seen = [defaultdict(lambda: [[0, 0] for _ in range(4)]) for _ in range(2)]
    for rule, _, fold, buckets in data:
        for table, b in zip(seen, buckets, strict=True):
            if rule:
                table[b][fold][0] += 1
                table[b][fold][1] += rule.block
    cap = lambda x: max(0, min(31, math.floor(x)))

    def vector(f, fold, buckets, own):
        out = list(f)
        for table, b in zip(seen, buckets, strict=True):
            n, k = (sum(c[i] for j, c in enumerate(table[b]) if not (own and j == fold)) for i in (0, 1))
            out += [cap(math.log2(n + 1)), cap(31 * (k + 2) / (n + 4))]
        return out

    train = [(vector(f, fold, b, True), int(rule.block)) for rule, f, fold, b in data if rule]
    x, y = np.array([t[0] for t in train]), np.array([t[1] for t in train])
    b, n = y.sum(), len(y)
    start, trees = math.log((b + 0.5) / (n - b + 0.5)), []
    odds = np.full(n, start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        g, h = p - y, p * (1 - p)
        tree, leaves = {}, {0: np.arange(n)}
        for _ in range(depth):
            for node in [k for k in leaves if k not in tree and k >= 2 ** (len(bin(k + 1)) - 3) - 1]:
                own, best = leaves[node], None
                score = lambda a, c: a * a / (c + 1.0)
                for f in range(9):
                    for cut in sorted(set(x[own, f]))[:-1]:
                        left = own[x[own, f] <= cut]
                        right = own[x[own, f] > cut]
                        if min(h[left].sum(), h[right].sum()) < 1:
                            continue
                        gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[own].sum(), h[own].sum())
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-5):
                            best = gain, f, cut, left, right
                if best:
                    tree[node] = best[1], best[2]
                    leaves[2 * node + 1], leaves[2 * node + 2] = best[3], best[4]
        if not tree:
            break
        values = {k: -rate * g[v].sum() / (h[v].sum() + 1) for k, v in leaves.items() if k not in tree}
        for k, v in values.items():
            odds[leaves[k]] += v
        trees.append((tree, values))

    def probability(v):
        total = start
        for tree, values in trees:
            node = 0
            while node in tree:
                node = 2 * node + (1 if v[tree[node][0]] <= tree[node][1] else 2)
            total += values[node]
        return 1 / (1 + math.exp(-total))

    return [(rule.text if rule else None, rule.block if rule else None, probability(vector(f, fold, bs, False))) for rule, f, fold, bs in data]


def test_url_parts_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "x", 1)], "page_id long, url string, host string, number int")
    got = url_filter.judge(frame).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = brute_parts(URLS[r["id"]] if r["id"] is not None else URLS[0])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] == ("block" if (rule.block if rule else r["score"] > 0.5) else "allow")
    assert url_filter.judge(frame.limit(0)).count() == 0
    unruled = url_filter.judge(frame, rules=()).collect()
    assert {(r["rule"], r["verdict"], r["score"]) for r in unruled} == {(None, "allow", 0.5)}


def test_url_query_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = sorted(map(tuple, url_filter.described(pages.select(F.col("page_id").alias("id"), "url"), url_filter.RULES).select("id", "url", "fold", "label_bucket", "domain_bucket").collect()))
    expected = brute_verdicts(rows)
    got = {r["page_id"]: r for r in queries.op12_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for (i, *_), (rule, block, p) in zip(rows, expected, strict=True):
        assert got[i]["rule"] == rule and abs(got[i]["score"] - p) < 1e-4
        assert got[i]["verdict"] == ("block" if (block if rule else p > 0.5) else "allow")


def test_url_trees_predict_hidden_labels(spark):
    """Labels of a fifth of the URLs are hidden from the fit."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(F.col("page_id").alias("id"), "url")
    rows = url_filter.with_label(url_filter.described(pages, url_filter.RULES), url_filter.RULES)
    seen, hidden = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    statistics = url_filter.suffix_statistics(seen).cache()
    model = url_filter.boost(url_filter.training_vectors(seen, url_filter.RULES, statistics))
    judged = url_filter.with_suffix_features(hidden, statistics, own_fold=False).withColumn("p", model.probability())
    right, base = judged.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("blocked")).cast("double")), F.avg("blocked")).first()
    assert right > max(base, 1 - base) + 0.08


# ---- alignment of two tokenizers

TEXTS = [
    None, "", " ", "  two  spaces ", "it's we'LL they'd 1234567 89", "a" * 3000, "日本語 é́ 🎉🎉 <|endoftext|> <s> </s> <unk>", "\r\n\t mixed \u00a0 space", "▁ low line", "ﬁ ½ ①", "x y\u2003z", "The same", "The same",
    "don 't stop", "foo.\n bar", "\x00 nul \x1f", "<0x41>", "a b " * 3000,
]


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return token_alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(files, rows):
    """By whole texts, two pointers and dictionaries."""
    a_lib, b_lib = files._open()
    letters = {c: b for b, c in token_alignment._byte_letters().items()}
    entries = {i: e for e, i in a_lib.get_vocab().items()}
    bytes_a = lambda i: bytes(letters[c] for c in entries[i]) if all(c in letters for c in entries[i]) else entries[i].encode()

    def bytes_b(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    done, counts = [], Counter()
    for _, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        of_a, of_b = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            done.append((0, 0, [], Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]), np.cumsum([len(x) for x in of_b])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            to_a, to_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((a[i:to_a], b[j:to_b]))
            i, j = to_a, to_b
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        counts.update(links.keys())
        done.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    out = []
    for (i, _), (n_a, n_b, groups, links) in zip(rows, done, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(m for k, m in links.items() if counts[k] == top[k[0]])
        out.append((i, n_a, n_b, len(groups), sum(links.values()), best, sum(m * counts[k] for k, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [3, 65_536])
def test_alignment_equals_brute_force(spark, files, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "repeated id"), (None, "null id"), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pair int, docs string")
    got = sorted(map(tuple, token_alignment.align(frame, files).collect()), key=str)
    assert got == brute_alignment(files, rows)
    assert token_alignment.align(frame.limit(0), files).count() == 0


def test_alignment_query_equals_brute_force(spark, files):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_alignment(spark, D).collect()), key=str) == brute_alignment(files, rows)


@pytest.mark.parametrize("remembered", [0, 4, 150_000])
def test_groups_are_made_once_a_stretch(spark, files, monkeypatch, remembered):
    rows = [(i, "the same words, and the same words again " * 30 + ("▁" if i % 5 == 3 else "")) for i in range(20)]
    frame = spark.createDataFrame(rows + list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    if remembered > 4:
        once = token_alignment.tokenised(frame.where("text like 'the same%'"), files, remembered).where("number is not null").toPandas()
        assert once["number"].tolist() == list(range(len(once))) and len(once) <= 20
    monkeypatch.setattr(token_alignment, "linked", partial(token_alignment.linked, remembered=remembered))
    got = sorted(map(tuple, token_alignment.align(frame, files, "id").collect()), key=str)
    assert got == brute_alignment(files, [tuple(r) for r in frame.collect()])


@pytest.mark.parametrize("most", [0, 30_000])
def test_groups_are_made_once_a_shape(spark, files, monkeypatch, most):
    monkeypatch.setattr(token_alignment, "SHAPES", most)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 7))) for _ in range(400)] + ["q" * 70, "é" * 40]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    worker = token_alignment._Worker(files)
    used = {w for _, text in rows for w in text.split(" ")}
    ids = [(worker.a.encode(" " + w, add_special_tokens=False).ids, worker.b.encode(w)) for w in used]
    shapes = {tuple(tuple(np.cumsum(worker.n_bytes[side][own[side]]).tolist()) for side in (0, 1)) for own in ids}
    made = token_alignment.tokenised(frame, files).where("number is not null").count()
    assert made == len(shapes) < len(used)
    assert sorted(map(tuple, token_alignment.align(frame, files, "id").collect()), key=str) == brute_alignment(files, rows)


def test_plain_texts_are_cut_without_the_pattern(files, monkeypatch):
    rng = random.Random(9)
    worker, pattern = token_alignment._Worker(files), token_alignment._BREAK
    texts = ["".join(rng.choice(["a", "É", "b-c", "ɏ", "ɐ", " ", " ", "\n", "\t", "\u00a0", "¡", "日"]) for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    texts += [" ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "a\nb c", "\n", "a\x7f b"]
    assert [worker.stretches(x) for x in texts] == [pattern.split(x) for x in texts]

    class Unused:
        def split(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(token_alignment, "_BREAK", Unused())
    assert worker.stretches("the first é line,\nand another one") == ["the", "first", "é", "line,\nand", "another", "one"]


def test_stretches_have_the_tokens_of_the_whole(files):
    rng = random.Random(8)
    worker = token_alignment._Worker(files)
    assert worker.splits
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", "ing", "É", " ", " ", " ", "  ", "\n", "'s", "12", "日", ".", "-", "\u00a0", "▁", "🎉", "<s>"]) for _ in range(rng.randrange(1, 25)))
        parts = worker.stretches(text)
        worker.learn(set(parts))
        ids = worker.tokens(parts)
        if not len(ids[0]):
            assert "▁" in text
            continue
        assert ids[0].tolist() == worker.a.encode(" " + text, add_special_tokens=False).ids and ids[1].tolist() == worker.b.encode(text)
