import hashlib
import html
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.llm import bpe, html_text, quality, queries, toxicity
from helixspark.llm.labelled import fold, logistic

D = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "   \n\n  x", "it's we'LL they'd", "a" * 3000, " " * 2000, "日本語 é́ 🎉🎉 <|endoftext|>", "1234567 89", "The same", "The same", "\r\n\t mixed space"]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_perfect_hash(vocabulary):
    slots = {vocabulary.whole.slot(t) for t in vocabulary.tokens}
    assert slots == set(range(len(vocabulary.tokens)))
    assert all(vocabulary.whole.candidate(t) == i for i, t in enumerate(vocabulary.tokens[:2000]))
    assert bpe.PerfectHash.build([]).candidate(b"x") == -1
    with pytest.raises(ValueError):
        bpe.PerfectHash.build([b"a", b"a"])


def test_encode_equals_tiktoken(spark, vocabulary, tiktoken_encoding):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids long")
    got = {r["id"]: r["ids"] for r in bpe.encode(docs, vocabulary).collect()}
    assert got == {i: tiktoken_encoding.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r["id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_merge_of_random_bytes(vocabulary, tiktoken_encoding):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("abcdest ién") for _ in range(rng.randrange(1, 40))).encode()
        assert vocabulary.merge(piece) == tiktoken_encoding._core_bpe.encode_single_piece(piece)


def test_bpe_query(spark, tiktoken_encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# ---- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("only text", "only text"),
        ("<p>a &lt; b &amp c<br>d</p>", "a < b & c d"), ("<div><p>x<p>y</div>", "x\ny"), ("<table><tr><td>a<td>b</table>", "a\nb"), ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("<p>1 < 2 and 3 > 2</p><script>if(a<b){}</script", "1 < 2 and 3 > 2"), ("<p>x</p><!-- never closed <p>y", "x"), ("<p>a</p><style>p{}", "a"),
        ("<p title='a > b'>in  \n\t side</p>", "in side"), ("<P CLASS=x>Up</P>", "Up"), ("<p>&#233;&nbsp;&eacute;</p>", "é é"),
        ("<body><nav><a href=/>Home</a></nav><article><header><h1>T</h1></header><p>Some text.</p></article><footer>f</footer></body>", "T\nSome text."),
        ("<body><header>Site</header><div class='article-body'><p>Words of the text.</p><p>Sh.</p></div><div class='comments'><p>" + "nice " * 40 + "</p></div></body>", "Words of the text.\nSh."),
        ("<body><div id=cookieNotice>We use cookies</div><main><p>A text.</p><form><p>Mail</p><input></form></main><aside><p>Side text that is long.</p></aside></body>", "A text."),
        ("<body><div class='layout has-sidebar'><article><p>Kept here.</p></article><div class=sidebar>No</div></div></body>", "Kept here."),
        ("<body><div class=header>Site name</div><div class='post-header'><h1 class=header>T</h1></div><p>Text that goes on.</p></body>", "T\nText that goes on."),
        ("<body><div id='siteHeader'><p>Site</p></div><article><div class=header><h1>T</h1></div><p>Text.</p></article></body>", "T\nText."),
        ("<body><div class='header'><main><p>All in here.</p></main></div></body>", "All in here."),
        ("<body><ol class='commentlist'><li>hi</li></ol><div><p>Main words here.</p><div class='comment-12'>c</div></div></body>", "Main words here."),
        ("<body><div hidden><p>No</p></div><div><p>Yes it is</p></div></body>", "Yes it is"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("tag", ["div", "section"])
def test_articles_in_several_parts(tag):
    """No element names the article, whose parts are siblings; links beside them stay out."""
    parts = [[f"{name} {i} " + "words of text " * 20 for i in range(10)] for name in ("first", "second", "third")]
    links = "<div>" + "".join(f"<a href='/{i}'>link {i}</a> " for i in range(20)) + "</div>"
    body = links.join(f"<{tag}>" + "".join(f"<p>{p}</p>" for p in part) + f"</{tag}>" for part in parts)
    want = [" ".join(p.split()) for part in parts for p in part]
    assert html_text.main_text(f"<html><body>{links}{body}{links}</body></html>").split("\n") == want
    assert html_text.main_text(f"<html><body>{links}<div>{body}</div>{links}</body></html>").split("\n") == want


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html_text.main_text("<p>" + "word " * 100_000)) == 499_999


def test_pages_against_brute_force(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op8_html_text(spark, D).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = p["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x</p>", 6), (1, "u", "<p>x</p>", 7)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages)
    assert sorted((r["n_chars"], r["text"]) for r in got.collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- classifiers


def test_passage_features_cover_every_byte_and_word():
    texts = ["", "a b c", "word " * 200, "Up DOWN | x!! 12", " \n"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    x, bounds = quality.passage_features(data, offsets)
    assert np.diff(bounds).tolist() == [1, 1, 4, 1, 1] and x.shape == (8, quality.N_FEATURES) and np.isfinite(x).all()
    alone, _ = quality.passage_features(data[offsets[3] : offsets[4]], np.array([0, len(raw[3])]))
    assert np.allclose(alone[0], x[bounds[3]])


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, bounds, y = rng.normal(size=(9, 4)), np.array([0, 2, 5, 9]), np.array([0.0, 1.0, 1.0])
    model = quality.AttentionModel.fit(x, bounds, y, hidden=3, gate=2, epochs=1)

    def loss():
        s = model.forward(x, bounds)[-1]
        return float(np.mean(np.log1p(np.exp(s)) - y * s))

    grads = model._gradients(x, bounds, y)
    for name in model.parts:
        part = model.parts[name]
        at = tuple(0 for _ in np.shape(part))
        base = np.array(part, dtype=float)
        moved = base.copy()
        moved[at] += 1e-6
        model.parts[name] = moved
        up = loss()
        model.parts[name] = base
        assert abs((up - loss()) / 1e-6 - np.asarray(grads[name])[at]) < 1e-4


def accuracy(spark, run, label, d="/root/testdata/sf0.1"):
    rows = run(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_on_held_out_documents(spark):
    assert accuracy(spark, queries.op1_quality, "quality") > 0.97


def test_toxicity_on_held_out_documents(spark):
    assert accuracy(spark, queries.op9_toxicity, "toxic") > 0.97


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "some text", 3.0), (2, "x" * 50_000, 4.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(i, 1, 1) for i in range(1, 3)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    for labels, want in ((none, {0.5}), (one_kind, None)):
        q = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
        t = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
        for rows in (q, t):
            assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
            assert want is None or {r["score"] for r in rows} == want
    model = quality.fit_quality(docs, none)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs, model).count() == 4
    assert quality.keep_good(docs, model, 0.6).count() == 0


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def brute_segments(s):
    best = None
    for i in range(len(s)):
        total = 0
        for j in range(i, len(s)):
            total += s[j]
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j + 1)
    if best is None:
        return []
    left, right = brute_segments(s[: best[1]]), brute_segments(s[best[2] :])
    return [*left, (best[1], best[2]), *[(a + best[2], b + best[2]) for a, b in right]]


def test_segments_equal_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        s = rng.uniform(-3, 3, rng.integers(0, 15))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(list(s))


def test_log_odds_and_lambda():
    delta, z = toxicity.log_odds(np.array([[5.0, 50.0], [50.0, 50.0]]), np.array([1000.0, 1000.0]), 100)
    assert delta[0] > 1.5 and z[0] > 5 and abs(delta[1]) < 0.2
    gain = np.array([3.0] * 5 + [0.0] * 95)
    lam = toxicity.solve_lambda(gain - 0.5, np.ones(100))
    assert abs(np.exp(lam * (gain - 0.5)).mean() - 1) < 1e-6
    assert abs(toxicity.solve_lambda(np.array([2.5, -0.5]), np.array([5.0, 95.0])) - lam) < 1e-9


def test_logistic():
    x = np.array([[0.0], [0.1], [0.9], [1.0], [0.5], [0.5]])
    w = logistic(x, np.array([0, 0, 1, 1, 0, 1.0]), ridge=1e-6)
    assert w[0] > 5 and abs(w[0] * 0.5 + w[1]) < 0.2


# ---- HTML through density, on pages without <article>

SENTENCE = "The quick brown fox jumps over the lazy dog and then it runs far away into the deep woods where nobody lives."
PARAGRAPHS = "".join(f"<p>{n} {SENTENCE} {SENTENCE}</p>" for n in range(6))
ARTICLE = "\n".join(f"{n} {SENTENCE} {SENTENCE}" for n in range(6))
HOSTILE = {
    f"<p data-x=it's>Hello world one two three four five</p>{PARAGRAPHS}": "Hello world one two three four five\n" + ARTICLE,
    f"<div class='legal-news'>{PARAGRAPHS}</div>": ARTICLE,
    f"<div class=share-price>{PARAGRAPHS}</div>": ARTICLE,
    f"<section class='related-work'>{PARAGRAPHS}</section>": ARTICLE,
    f"<div>{PARAGRAPHS}</div><div class=comments><p>{SENTENCE}</p><p>{SENTENCE}</p></div>": ARTICLE,
    f"<div>{PARAGRAPHS}<aside><p>{SENTENCE}</p></aside></div>": ARTICLE,
    f"<div>{PARAGRAPHS}<form><label>Your mail address please</label><input></form></div>": ARTICLE,
    f"<div><section>{PARAGRAPHS}</section><section>{PARAGRAPHS}</section></div>": ARTICLE + "\n" + ARTICLE,
    f"<div><h1>A short title of it</h1><p>By Ann</p><div>{PARAGRAPHS}</div></div>": "A short title of it\nBy Ann\n" + ARTICLE,
    f"<table><tr><td><a href=1>one</a><a href=2>two</a></td><td>{PARAGRAPHS}</td></tr></table>": ARTICLE,
    f"<div class=cookie-notice>We use cookies to make this site better for all of you, please accept.</div><div>{PARAGRAPHS}</div>": ARTICLE,
    f"<div>{PARAGRAPHS}</div><dialog>{SENTENCE}</dialog>": ARTICLE,
    f"<div>{PARAGRAPHS}<ul><li>first thing</li><li>second thing</li></ul></div>": ARTICLE + "\nfirst thing\nsecond thing",
    f"<div title='a > b' data-y=\"it's > that\">{PARAGRAPHS}</div>": ARTICLE,
    f"<div>{PARAGRAPHS}</div><div><ul><li><a href=1>Other page one</a></li><li><a href=2>Other page two</a></li></ul></div>": ARTICLE,
    "<p>Hello</p>": "Hello",
}


@pytest.mark.parametrize("inner", HOSTILE)
def test_hostile_pages(inner):
    frame = "<html><body><nav><a href=/>Home</a><a href=/b>Blog</a></nav>{}<footer>Copyright 2020 all rights reserved by the owners of this site</footer></body></html>"
    assert html_text.main_text(frame.format(inner)) == HOSTILE[inner]


def test_density_decides(spark, monkeypatch):
    """Densities equal a naive recount on every page, and without them most pages come out otherwise."""
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]

    def recount(node):
        c = t = lc = lt = 0
        for x in node.children:
            if isinstance(x, str):
                n = sum(not ch.isspace() for ch in x)
                c, lc = c + n, lc + (html_text.LIGHT_SHARE * n if node.light else 0)
            elif not x.gone:
                c1, t1, lc1, lt1 = recount(x)
                c, t, lc, lt = c + c1, t + t1 + 1, lc + lc1, lt + lt1 + (html_text.LIGHT_SHARE if x.light and x.tag != "a" else 0)
        return (c, t, c, lt + 1) if node.tag == "a" else (c, t, lc, lt)

    for page in pages:
        nodes = html_text._in_order(html_text.parse(page or ""))
        html_text._measure(nodes)
        body = next((x for x in nodes if x.tag == "body"), nodes[0])
        c, _, lc, _ = recount(body)
        for node in nodes[:: max(1, len(nodes) // 40)]:
            cn, tn, lcn, ltn = recount(node)
            assert abs(node.density - html_text.composite_density(cn, max(1, tn), lcn, ltn, lc / max(1, c))) <= 1e-6 * max(1, node.density)
    before = [html_text.main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "composite_density", lambda *a: 0.0)
    assert sum(html_text.main_text(x) != y for x, y in zip(pages, before, strict=True)) > len(pages) / 2
