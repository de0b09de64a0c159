"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, knn, lexical_search, near_dedup, packing, quality, substring_dedup, token_alignment, toxicity, url_filter, warc
from .labelled import fold
from .tables import table

ORACLE_SQL: dict[str, str] = {}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumnRenamed("id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


ORACLE_SQL["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that repeat across documents, and where each passage stays; documents without any have no row."""
    found = substring_dedup.spans(substring_dedup.pieces(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", "removed", F.col("keep_id").alias("keep_doc_id"), "n_pieces")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("id", "doc_id")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE_SQL["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT u.y, reach.c FROM reach JOIN u ON u.x = reach.id),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.sh) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp ON comp.id = s.doc_id
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", knn.quantised(F.col("embedding")).alias("v"))
    return knn.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


ORACLE_SQL["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page, as a crawler would have stored them: a full response, a conditional request by ETag
    answered 304, the page grown by a comment, and a conditional request by date answered 304.

    One ETag in seven and one date in five have changed, as where a cache answered for another version.
    """
    page, n, html = F.col("page_id"), F.col("n"), F.coalesce("html", F.lit(""))
    text = lambda c: c.cast("string")
    etag, modified = F.md5(html.cast("binary")), F.concat(F.lit("m"), text(page))
    stamp = F.concat(F.lit("t"), text(page * 4 + n))
    pairs = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    headers = (
        F.when(n == 0, pairs("ETag", etag, "Last-Modified", modified, "Date", stamp, "Content-Type", "text/html"))
        .when(n == 1, pairs("etag", F.when(page % 7 == 0, F.lit("changed")).otherwise(etag), "date", stamp, "Content-Type", "message/http"))
        .when(n == 2, pairs("ETag", F.concat(etag, F.lit("-2")), "Last-Modified", F.concat(modified, F.lit("-2")), "Date", stamp, "Content-Type", "text/html"))
        .otherwise(pairs("last-modified", F.when(page % 5 == 0, F.lit("changed")).otherwise(F.concat(modified, F.lit("-2"))), "date", stamp, "Content-Type", "message/http"))
    )
    captures = pages.select("page_id", "url", "html", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n"))
    return captures.select(
        (page * 4 + n).alias("record_id"), "url", (page * 4 + n).alias("ts"), F.when(n % 2 == 0, "response").otherwise("revisit").alias("kind"), headers.alias("headers"),
        F.when(n == 0, html).when(n == 2, F.concat(html, F.lit("<!-- 2 -->"))).alias("body"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return done.select(
        "record_id", "url_key", "kind", "status", "refers_to",
        F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), F.col("headers")["date"].alias("date"),
        F.col("headers")["content-type"].alias("content_type"), F.length("body").cast("long").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"),
    )


ORACLE_SQL["op10_warc"] = r"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag, 'm' || page_id AS changed_at,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare
  FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept
  FROM bare
), r AS (
  SELECT page_id * 4 + n AS record_id, CASE WHEN n % 2 = 0 THEN 'response' ELSE 'revisit' END AS kind, 't' || (page_id * 4 + n) AS date,
         host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key,
         CASE n WHEN 0 THEN tag WHEN 1 THEN CASE WHEN page_id % 7 = 0 THEN 'changed' ELSE tag END WHEN 2 THEN tag || '-2' END AS etag,
         CASE n WHEN 0 THEN changed_at WHEN 2 THEN changed_at || '-2' WHEN 3 THEN CASE WHEN page_id % 5 = 0 THEN 'changed' ELSE changed_at || '-2' END END AS modified,
         CASE n WHEN 0 THEN html WHEN 2 THEN html || '<!-- 2 -->' END AS body
  FROM parts, range(4) AS c(n)
), dated AS (
  SELECT *, max(CASE WHEN kind = 'response' THEN record_id END) OVER (PARTITION BY url_key ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM r
), judged AS (
  SELECT a.*, b.etag AS prior_etag, b.modified AS prior_modified, b.body AS prior_body,
         CASE WHEN a.kind = 'response' THEN 'response' WHEN a.prior_id IS NULL THEN 'no_response'
              WHEN coalesce(CASE WHEN a.etag IS NOT NULL THEN a.etag = b.etag ELSE a.modified = b.modified END, false) THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM dated a LEFT JOIN r b ON b.record_id = a.prior_id
)
SELECT record_id, url_key, kind, status, CASE WHEN status = 'resolved' THEN prior_id END AS refers_to,
  CASE WHEN status = 'resolved' THEN coalesce(etag, prior_etag) ELSE etag END AS etag,
  CASE WHEN status = 'resolved' THEN coalesce(modified, prior_modified) ELSE modified END AS modified, date,
  CASE WHEN status IN ('response', 'resolved') THEN 'text/html' ELSE 'message/http' END AS content_type,
  length(CASE WHEN status = 'resolved' THEN prior_body ELSE body END) AS n_chars, sha256(CASE WHEN status = 'resolved' THEN prior_body ELSE body END) AS body_sha256
FROM judged
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.withColumnRenamed("id", "doc_id")


ORACLE_SQL["op11_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), g AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (
  SELECT item_id, t, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL
  ) GROUP BY ALL
), p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(ts) * n_docs) // n_terms AS m FROM d, g),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) WHERE doc_id IS NOT NULL GROUP BY ALL
), k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), files).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_packing, op3_exact_dedup, op4_substring_dedup, op5_byte_bpe, op6_minhash_near_dedup, op7_exact_top_k, op8_html_text, op9_toxicity, op10_warc,
        op11_lexical_search, op12_url_filter, op13_token_alignment,
    )
}
