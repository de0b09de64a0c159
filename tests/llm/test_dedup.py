import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helixspark.llm import exact_dedup, near_dedup, queries, shingling, substring_dedup
from helixspark.llm.near_dedup import MinHash
from helixspark.operators import graph
from helixspark.plans.scratch import Run

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, keep_id int, text_sha256 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 3, "y") for i, t in zip(ids, texts, strict=True)], DOCS)


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingle_set(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_components(ids, sets):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * inter >= 75 * union:
                x, y = sorted((top(ids[a]), top(ids[b])))
                parent[y] = x
    return {i: top(i) for i in ids}


def prose(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "ra", "so", "vi"]) + rng.choice(["ka", "lo", "mi", "ne", "tu"]) + rng.choice(["", "s", "n"]) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
    return " ".join(w)


EDGES = [None, "", "  \n\t", "one", "ONE", "one two three four", "One two THREE four five six", "one two three four five six", "x" * 200_000, "é " * 4000, "a b c", "same", "same", "same"]


# ---- exact


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, keep, weak):
    ids = [*range(len(EDGES)), None, None, 5]
    texts = [*EDGES, "same", "lonely", EDGES[5]]
    options = {"content_hash": lambda c: F.pmod(F.length(c), F.lit(2))} if weak else {}
    got = exact_dedup.exact_groups(table(spark, texts, ids), keep=keep, **options).collect()
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in zip(ids, texts, strict=True):
        known = [x for x in groups[t or ""] if x is not None]
        best = (min(known) if keep == "min" else max(known)) if known else None
        want.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("keep", ["min", "max"])
def test_drop_exact_copies(spark, keep):
    ids = [*range(len(EDGES)), None, None, 5]
    docs = table(spark, [*EDGES, "same", "lonely", EDGES[5]], ids)
    got = exact_dedup.drop_exact_copies(docs, keep=keep)
    assert got.columns == docs.columns
    rows = got.collect()
    texts = [r["text"] or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({t or "" for t in [*EDGES, "lonely"]})
    same = next(r for r in rows if r["text"] == "same")
    assert same["doc_id"] == (11 if keep == "min" else 13)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(table(spark, [])).count() == 0


# ---- shingles and near-duplicates


def test_shingles_equal_brute_force():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [*EDGES, *[prose(rng, n) for n in range(12)], "A b\x0bc\x0cd\re\nf", "", "z"]
    for a, b, values, ends in shingling.text_sets(pa.array(texts)):
        for i in range(a, b):
            assert ends[i - a + 1] - ends[i - a] == len(shingle_set(texts[i]))
    seen = {}
    for a, b, values, ends in shingling.text_sets(pa.array(texts)):
        for i in range(a, b):
            assert seen.setdefault(shingle_set(texts[i]), values[ends[i - a] : ends[i - a + 1]].tolist()) == values[ends[i - a] : ends[i - a + 1]].tolist()


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(11)
    texts = list(EDGES)
    for _ in range(12):
        base = prose(rng, rng.randrange(8, 150))
        texts += [base] + [edited(rng, base, k) for k in (1, 1, 2, 3, 5)]
    base = prose(rng, 200)
    texts += [edited(rng, base, 6) for _ in range(60)]  # a large group around one text, in which some pairs are linked
    got = {r["id"]: r for r in near_dedup.near_groups(table(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    want = brute_components(list(range(len(texts))), sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_groups_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    rng = random.Random(2)
    base = prose(rng, 150)
    texts = [edited(rng, base, rng.randrange(1, 8)) for _ in range(50)]
    got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(table(spark, texts)).collect()}
    assert got == brute_components(list(range(50)), [shingle_set(t) for t in texts])


def test_near_odd_rows(spark):
    text = "one two three four five six seven eight"
    docs = table(spark, [text, text, None, "", text, "other words here and there too"], [1, 1, 2, 3, None, 9])
    got = sorted(map(str, near_dedup.near_groups(docs).select("id", "component_id", "kept").collect()))
    assert got == sorted(f"Row(id={i}, component_id={c}, kept={k})" for i, c, k in [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (9, 9, True)])
    assert near_dedup.near_groups(table(spark, [])).count() == 0
    kept = near_dedup.drop_near_copies(table(spark, [text, text + " nine", "a b"], [4, 2, 7]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7] and kept.columns == DOCS.replace(",", "").split()[::2]


def test_estimate_is_near_the_similarity():
    import numpy as np

    rng, p = np.random.default_rng(3), MinHash()
    shared = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for s in (0.5, 0.75, 0.9):
        n = int(3000 * (1 - s) / (2 * s))
        sets = [np.sort(np.concatenate([shared, rng.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2)]
        minima = p.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        assert abs(p.estimate(p.planes(minima))[0, 1] - s) < 0.12
    assert 0.55 < p.cut() < 0.70


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (101, 100)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- passages


def test_passages_of_51_words_are_found(spark):
    rng = random.Random(8)
    passage = prose(rng, 51)
    texts = [prose(rng, 120) for _ in range(12)]
    for i in (3, 6, 9):
        w = texts[i].split(" ")
        texts[i] = " ".join(w[: 10 * i]) + " " + passage.replace(" ", " \n" if i == 6 else " ", 1) + " " + " ".join(w[10 * i :])
    docs = table(spark, texts)
    found = substring_dedup.spans(substring_dedup.pieces(docs)).collect()
    assert {(r["id"], r["removed"], r["keep_id"]) for r in found} == {(3, False, 3), (6, True, 3), (9, True, 3)}
    at = {3: 30, 6: 60, 9: 90}
    assert all(at[r["id"]] <= r["start"] and r["start"] + r["n_words"] <= at[r["id"]] + 51 and r["n_words"] >= 26 for r in found)
    out = {r["doc_id"]: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert all(out[i]["text"] == texts[i] for i in range(12) if i not in (6, 9))
    for i in (6, 9):
        assert len(words(out[i]["text"])) <= 171 - 26 and out[i]["n_chars"] == len(out[i]["text"])
        assert [w for w in words(texts[i])[: at[i]]] == words(out[i]["text"])[: at[i]]


def test_side_tables_of_windows_go_before_paragraphs(spark):
    rng = random.Random(3)
    passage, fill = [" ".join(str(rng.random()) for _ in range(n)) for n in (60, 40)]
    rows = substring_dedup.texts(table(spark, [f"{passage} {fill}", passage]), "doc_id", "text")
    bare, whole = (substring_dedup.windows(rows, 26, 25, b).select("id", "k", "c").collect() for b in (True, False))
    assert len(bare) > 2 and sorted(bare) == sorted(whole)
    with Run() as tables:
        substring_dedup.pieces(rows, "id", min_paragraph=1000)
    assert sorted(path.rsplit("/", 1)[1].split("-")[1] for _, path in tables.written) == ["placed", "verbatim"]


def test_near_paragraphs_are_found(spark):
    rng = random.Random(5)
    para = prose(rng, 80)
    other = " ".join(w if i % 40 else "changed" for i, w in enumerate(para.split(" ")))
    texts = ["first line here\n" + para + "\nlast", prose(rng, 60), "quite another\n" + other]
    got = substring_dedup.spans(substring_dedup.pieces(table(spark, texts))).collect()
    assert {(r["id"], r["start"], r["n_words"], r["removed"]) for r in got} == {(0, 3, 80, False), (2, 2, 80, True)}


def test_sets_of_paragraphs_are_the_candidates_alone(spark, monkeypatch):
    rng = random.Random(31)
    shared = prose(rng, 30)
    texts = ["\n".join([*[prose(rng, 12) for _ in range(9)], edited(rng, shared, 1)]) for _ in range(4)]
    seen, groups_of = [], substring_dedup.groups_of

    def spied(sig, sets_of, params):
        def spied_sets(nodes):
            sets = sets_of(nodes)
            seen.append((sorted(r[0] for r in sets.select("id").collect()), sorted(r[0] for r in nodes.collect())))
            return sets

        return groups_of(sig, spied_sets, params)

    monkeypatch.setattr(substring_dedup, "groups_of", spied)
    substring_dedup.near_paragraphs(substring_dedup.texts(table(spark, texts), "doc_id", "text"), 5, substring_dedup.PARAGRAPH_HASH).collect()
    [(ids, nodes)] = seen
    assert len(nodes) >= 2 and ids == nodes


def test_passages_odd_rows(spark):
    rng = random.Random(6)
    same = prose(rng, 70)
    docs = table(spark, [None, "", same, same, same, "w " * 500, "w " * 400, " \n"], [0, 1, 2, 3, None, 5, 6, 7])
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == same and rows[None] == same and rows[7] == " \n"
    assert 3 not in rows  # nothing of it is left
    assert substring_dedup.drop_repeats(table(spark, [])).count() == 0


def test_cut_words():
    assert substring_dedup.cut_words("a b c d\ne f", [1, 4], [2, 1]) == "a d\nf"
    assert substring_dedup.cut_words("é à ü", [0], [3]) == ""


def test_repeated_words_have_few_anchors():
    import numpy as np

    data = np.frombuffer(b"ab cd " * 2000, dtype=np.uint8)
    hashed, _, first = shingling.words(data, np.array([0, len(data)]))
    assert len(substring_dedup.anchors(hashed, first, 26, 25)) <= 2


def test_repeated_phrases_are_found_whole(spark):
    """Pairs of texts share a phrase said again and again, of every kind of period."""
    rng = random.Random(12)
    texts = []
    for period in (1, 2, 3, 6, 7, 12, 25, 26, 30):
        passage = " ".join(([f"w{period}x{i}" for i in range(period)] * 480)[:480])
        texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 60), prose(rng, 70) + " " + passage + " " + prose(rng, 30)]
    found = dict.fromkeys(range(1, len(texts), 2), 0)
    for r in substring_dedup.spans(substring_dedup.pieces(table(spark, texts))).where("removed").collect():
        found[r["id"]] += min(r["start"] + r["n_words"], 550) - max(r["start"], 70)
    assert min(found.values()) >= 480 - 2 * 25


def test_passages_are_found_whole(spark):
    """From the first word to the last, at the ends of texts too, and by whichever document has how much of it."""
    texts, want = [], {}
    for n in (51, 52, 60, 80, 120):
        passage = [f"p{n}x{i}" for i in range(n)]
        for before, after in ((40, 60), (70, 30), (0, 30), (30, 0)):
            if before != 40:
                want[len(texts)] = {(before, n)}
            own = [f"t{len(texts)}y{i}" for i in range(before + after)]
            texts.append(" ".join([*own[:before], *passage, *own[before:]]))
    short = len(texts)  # the first document has but a part of what the two others have
    passage = [f"q{i}" for i in range(200)]
    texts += [" ".join(["a", "b", *passage[70:130], "c"]), "u " + " ".join(passage) + " v", "x y " + " ".join(passage) + " z"]
    want |= {short + 1: {(71, 60)}, short + 2: {(2, 200)}}
    got = {}
    for r in substring_dedup.spans(substring_dedup.pieces(table(spark, texts), min_paragraph=1000)).where("removed").collect():
        got.setdefault(r["id"], set()).add((r["start"], r["n_words"]))
    assert got == want


def test_short_texts_have_the_same_anchors_alone_in_a_chunk():
    import numpy as np

    rng = random.Random(17)
    for n in range(48, 58):
        text = prose(rng, n)
        alone = np.frombuffer(text.encode(), dtype=np.uint8)
        both = np.frombuffer((text + " " + prose(rng, 100)).encode(), dtype=np.uint8)
        own, of_two = [], []
        for data, offsets, out in ((alone, [0, len(alone)], own), (both, [0, len(alone), len(both)], of_two)):
            hashed, _, first = shingling.words(data, np.array(offsets))
            out += [x for x in substring_dedup.every_anchor(hashed, first, 26, 25).tolist() if x < n]
        assert own == of_two and bool(own) == (n >= 50)


def test_equal_text_before_a_passage_drops_no_anchor():
    import numpy as np

    rng = random.Random(13)
    passage = prose(rng, 60)
    own = []
    for before in ("", " ".join(passage.split(" ")[:20]) + " "):
        data = np.frombuffer((before + passage).encode(), dtype=np.uint8)
        hashed, _, first = shingling.words(data, np.array([0, len(data)]))
        skip = len(words(before))
        own.append([x - skip for x in substring_dedup.every_anchor(hashed, first, 26, 25) if x >= skip])
    assert set(own[0]) <= set(own[1])


def test_queries_run(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert queries.op3_exact_dedup(spark, d).count() == n
    assert queries.op6_minhash_near_dedup(spark, d).count() == n
    assert queries.op4_substring_dedup(spark, d).count() > 0


def test_short_lines_are_passages(spark):
    """A line of 45 words in five documents, and near copies of one of 30 words in two; shorter than five words is none."""
    rng = random.Random(45)
    line, near = prose(rng, 45), prose(rng, 30)
    texts = [f"{prose(rng, 40)}\n{line}\n{prose(rng, 20)}" for _ in range(5)] + [f"{prose(rng, 25)}\n{near}", f"{edited(rng, near, 0)} end\n{prose(rng, 25)}"] + [f"{prose(rng, 30)}\nshort line" for _ in range(2)]
    found = substring_dedup.spans(substring_dedup.pieces(table(spark, texts))).collect()
    where = {(r["id"], r["start"], r["n_words"], r["removed"], r["keep_id"]) for r in found}
    assert {(i, 40, 45, i > 0, 0) for i in range(5)} | {(5, 25, 30, False, 5), (6, 0, 31, True, 5)} == where
