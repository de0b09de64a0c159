"""The registered queries of the library and the SQL that checks them.

Inputs are mapped as follows: a document is a read, whose bases are the letters A, C, G, T of its text; a sample is a
language and source; metadata are language, source and the mean number of characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import kmers, scalars
from helixspark.operators import adapters, clusters, graph, lsh, ordination, pairs, plotdata, preprocess, profiles, recommend, sketch, stats
from helixspark.plans.scratch import keep, new_folder
from helixspark.sources import fastq, fastq_scan, metadata, results

K = 11
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, letters: str = "ACGTacgt") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("_", "lang", "source").alias("sample"), F.lit("documents").alias("file"), F.col("doc_id").alias("read_no"),
        F.upper(F.regexp_replace("text", f"[^{letters}]+", "")).alias("seq"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.kmer_counts(reads(spark, sf_dir), K)


def prof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(counts(spark, sf_dir))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.concat_ws("_", "lang", "source").alias("sample")).agg(F.max("lang").alias("lang"), F.max("source").alias("source"), F.avg("n_chars").alias("mean_chars"))


def r6(c):
    return F.round(c, 6)


def braycurtis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairwise(prof(spark, sf_dir), "braycurtis")


# ---- SQL building blocks

WITH_READS = "WITH RECURSIVE r AS (SELECT concat_ws('_', lang, source) AS sample, doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"
KC = """, w AS (SELECT sample, substr(seq, i, 11) AS f FROM (SELECT sample, seq, unnest(range(1, len(seq) - 9)) AS i FROM r WHERE len(seq) >= 11)),
kc AS (SELECT sample, least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer, count(*) AS cnt FROM w GROUP BY ALL)"""
PROF = ", prof AS (SELECT sample, kmer, cnt, CAST(sum(cnt) OVER (PARTITION BY sample) AS BIGINT) AS total FROM kc)"
PAIRS = """, st AS (SELECT sample, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS s, CAST(sum(cnt * cnt) AS BIGINT) AS q, max(total) AS t FROM prof GROUP BY sample),
ps AS (SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS inter, CAST(sum(least(a.cnt * b.total, b.cnt * a.total)) AS BIGINT) AS m,
         CAST(sum(a.cnt * b.cnt) AS BIGINT) AS p, CAST(sum(CASE WHEN a.cnt * b.total = b.cnt * a.total THEN 1 ELSE 0 END) AS BIGINT) AS e
       FROM prof a JOIN prof b ON a.kmer = b.kmer AND a.sample < b.sample GROUP BY ALL),
pt AS (SELECT a.sample AS sample_a, b.sample AS sample_b, coalesce(inter, 0) AS inter, coalesce(m, 0) AS m, coalesce(p, 0) AS p, coalesce(e, 0) AS e,
         a.n AS n_a, b.n AS n_b, a.s AS s_a, b.s AS s_b, a.q AS q_a, b.q AS q_b, a.t AS t_a, b.t AS t_b, a.s * b.t + b.s * a.t AS both_
       FROM st a JOIN st b ON a.sample < b.sample LEFT JOIN ps ON ps.sample_a = a.sample AND ps.sample_b = b.sample)"""
BASE = WITH_READS + KC
PROFILE = BASE + PROF
TABLE = PROFILE + PAIRS
BC = TABLE + ", bc AS (SELECT sample_a, sample_b, (both_ - 2 * m) / both_ AS distance, 1 - (both_ - 2 * m) / both_ AS similarity FROM pt)"
META = ", meta AS (SELECT concat_ws('_', lang, source) AS sample, max(lang) AS lang, max(source) AS source, avg(n_chars) AS mean_chars FROM documents GROUP BY 1)"
MIRROR = ", mi AS (SELECT sample_a AS sample, sample_b AS other, distance, similarity FROM bc UNION ALL SELECT sample_b, sample_a, distance, similarity FROM bc)"


# ---- k-mers and profiles


@query(BASE + " SELECT sample, kmer, cnt FROM kc")
def kmer_counts(spark, sf_dir):
    return profiles.with_strings(counts(spark, sf_dir), K)


@query(BASE + " SELECT sample, kmer, cnt FROM kc")
def kmer_counts_strings(spark, sf_dir):
    """The same by SQL expressions on strings only."""
    return profiles.kmer_counts(reads(spark, sf_dir), K, packed=False)


@query(
    """WITH s AS (SELECT concat_ws('_', lang, source) AS sample, unnest(string_split(upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')), 'N')) AS seq FROM documents),
w AS (SELECT sample, substr(seq, i, 5) AS f FROM (SELECT sample, seq, unnest(range(1, len(seq) - 3)) AS i FROM s WHERE len(seq) >= 5))
SELECT sample, least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer, count(*) AS cnt FROM w GROUP BY ALL"""
)
def kmer_n_segments(spark, sf_dir):
    return profiles.with_strings(profiles.kmer_counts(reads(spark, sf_dir, "ACGTNacgtn"), 5), 5)


@query(
    BASE
    + """ SELECT DISTINCT kmer, list_reduce(list_transform(range(1, 12), lambda i: CAST(instr('ACGT', substr(kmer, i, 1)) - 1 AS BIGINT)), lambda a, x: a * 4 + x) AS packed,
translate(reverse(kmer), 'ACGT', 'TGCA') AS rc, list_reduce(list_transform(range(1, 12), lambda i: CAST(instr('ACGT', substr(translate(reverse(kmer), 'ACGT', 'TGCA'), i, 1)) - 1 AS BIGINT)), lambda a, x: a * 4 + x) AS rc_packed FROM kc"""
)
def kmer_packed(spark, sf_dir):
    each = counts(spark, sf_dir).select("kmer").distinct()
    named = each.select(kmers.unpack(F.col("kmer"), K).alias("kmer"), F.col("kmer").alias("code"))
    return named.select("kmer", kmers.pack(F.col("kmer"), K).alias("packed"), kmers.reverse_complement(F.col("kmer")).alias("rc"), kmers.reverse_complement_packed(F.col("code"), K).alias("rc_packed"))


@query(PROFILE + " SELECT sample, kmer, cnt, total, round(cnt / total, 9) AS freq FROM prof")
def kmer_profile(spark, sf_dir):
    return profiles.with_strings(prof(spark, sf_dir), K).select("sample", "kmer", "cnt", "total", F.round(F.col("cnt") / F.col("total"), 9).alias("freq"))


@query(BASE + " SELECT sample, kmer, cnt, CAST(sum(cnt) OVER (PARTITION BY sample) AS BIGINT) AS total FROM kc WHERE cnt >= 3")
def min_freq_profile(spark, sf_dir):
    return profiles.with_strings(profiles.profile(counts(spark, sf_dir), 3), K)


@query(
    "WITH r AS (SELECT * FROM (SELECT concat_ws('_', lang, source) AS sample, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5)"
    + KC + PROF + " SELECT sample, kmer, cnt, total FROM prof"
)
def capped_reads_profile(spark, sf_dir):
    capped = profiles.cap_reads(reads(spark, sf_dir), 5)
    return profiles.with_strings(profiles.profile(profiles.kmer_counts(capped, K)), K)


@query(BASE + " SELECT kmer, count(*) AS n_samples FROM kc GROUP BY kmer")
def kmer_doc_freq(spark, sf_dir):
    return profiles.with_strings(profiles.document_frequency(prof(spark, sf_dir)), K)


@query(BASE + " SELECT DISTINCT kmer FROM kc")
def vocabulary(spark, sf_dir):
    return profiles.with_strings(profiles.vocabulary(counts(spark, sf_dir)), K)


@query(
    PROFILE + """, n AS (SELECT count(DISTINCT sample) AS n FROM prof), c AS (SELECT kmer FROM prof, n GROUP BY kmer, n.n HAVING count(*) >= greatest(2, CAST(floor(0.1 * n.n) AS BIGINT)))
SELECT sample, kmer, cnt, total FROM prof, n WHERE n.n <= 50 OR kmer IN (SELECT kmer FROM c) OR NOT EXISTS (SELECT 1 FROM c)"""
)
def common_kmer_profile(spark, sf_dir):
    return profiles.with_strings(profiles.common_only(keep(prof(spark, sf_dir), "profile")), K)


@query(PROFILE + " SELECT sample, max(total) AS total, count(*) AS n_kmers FROM prof GROUP BY sample")
def sample_totals(spark, sf_dir):
    return profiles.sample_totals(prof(spark, sf_dir))


# ---- sketches

TOP = "SELECT sample, kmer, cnt FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY cnt DESC, kmer) AS k FROM kc) WHERE k <= {n}"
DRAW = "SELECT sample, kmer, count(*) AS cnt FROM (SELECT sample, kmer, row_number() OVER (PARTITION BY sample ORDER BY md5(kmer || '#' || i || '#7'), kmer, i) AS k FROM (SELECT sample, kmer, unnest(range(1, cnt + 1)) AS i FROM {src})) WHERE k <= {n} GROUP BY ALL"
WITH_TOTAL = " SELECT sample, kmer, cnt, CAST(sum(cnt) OVER (PARTITION BY sample) AS BIGINT) AS total FROM x"


def string_counts(spark, sf_dir):
    return profiles.with_strings(counts(spark, sf_dir), K)


@query(BASE + ", x AS (" + TOP.format(n=500) + ")" + WITH_TOTAL)
def sketch_frequency(spark, sf_dir):
    return sketch.frequency_sketch(string_counts(spark, sf_dir), 500)


@query(BASE + ", x AS (" + DRAW.format(src="kc", n=1000) + ")" + WITH_TOTAL)
def sketch_reservoir(spark, sf_dir):
    return sketch.reservoir_sketch(string_counts(spark, sf_dir), 1000, seed=7)


@query(BASE + ", t AS (" + TOP.format(n=350) + "), o AS (SELECT * FROM kc ANTI JOIN t USING (sample, kmer)), x AS (SELECT * FROM t UNION ALL " + DRAW.format(src="o", n=150) + ")" + WITH_TOTAL)
def sketch_adaptive(spark, sf_dir):
    return sketch.adaptive_sketch(string_counts(spark, sf_dir), 500, seed=7)


@query(
    BASE + ", x AS (" + TOP.format(n=500) + "), y AS (" + WITH_TOTAL + """) SELECT sample, count(*) AS unique_kmers, CAST(sum(cnt) AS BIGINT) AS total_kmers_sampled, round(count(*) / 500, 6) AS sampling_efficiency,
round(avg(cnt / total), 6) AS average_frequency, round(min(cnt / total), 6) AS min_frequency, round(max(cnt / total), 6) AS max_frequency FROM y GROUP BY sample"""
)
def sketch_stats(spark, sf_dir):
    s = sketch.sketch_statistics(sketch.frequency_sketch(string_counts(spark, sf_dir), 500), 500)
    return s.select("sample", "unique_kmers", "total_kmers_sampled", *[r6(c).alias(c) for c in ("sampling_efficiency", "average_frequency", "min_frequency", "max_frequency")])


@query(
    BASE + ", x AS (" + TOP.format(n=500) + """), y AS (SELECT sample, count(*) AS n FROM x GROUP BY sample)
SELECT count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS total_kmers, round(sum(n) * 29 / 1048576.0, 6) AS sketch_mb, round(count(*) * 100000 * 29 / 1048576.0, 6) AS full_mb, round(count(*) * 100000 / sum(n), 6) AS reduction FROM y"""
)
def sketch_memory(spark, sf_dir):
    s = sketch.sketch_memory(sketch.frequency_sketch(string_counts(spark, sf_dir), 500))
    return s.select("n_samples", "total_kmers", *[r6(c).alias(c) for c in ("sketch_mb", "full_mb", "reduction")])


# ---- pairs

FORMULA = {
    "jaccard": ("inter / (n_a + n_b - inter)", True),
    "weighted_jaccard": ("m / (both_ - m)", True),
    "cosine": ("p / sqrt(CAST(q_a AS DOUBLE) * q_b)", True),
    "braycurtis": ("(both_ - 2 * m) / both_", False),
    "euclidean": ("sqrt(greatest(0.0, CAST(q_a AS DOUBLE) / (CAST(t_a AS DOUBLE) * t_a) + CAST(q_b AS DOUBLE) / (CAST(t_b AS DOUBLE) * t_b) - 2 * CAST(p AS DOUBLE) / (CAST(t_a AS DOUBLE) * t_b)))", False),
    "manhattan": ("(both_ - 2 * m) / (t_a * t_b)", False),
    "hamming": ("(n_a + n_b - inter - e) / (SELECT count(DISTINCT kmer) FROM prof)", False),
}


def _register_pairs(name: str) -> None:
    formula, similar = FORMULA[name]
    sim = formula if similar else f"greatest(0.0, 1 - ({formula}) / 2)" if name == "euclidean" else f"1 - {formula}"
    dist = f"1 - {formula}" if similar else formula

    def run(spark, sf_dir):
        return pairs.pairwise(prof(spark, sf_dir), name).select("sample_a", "sample_b", r6("distance").alias("distance"), r6("similarity").alias("similarity"))

    run.__name__ = f"pairs_{name}"
    query(f"{TABLE} SELECT sample_a, sample_b, round({dist}, 6) AS distance, round({sim}, 6) AS similarity FROM pt")(run)


for _name in pairs.METRICS:
    _register_pairs(_name)


@query(BC + " SELECT sample_a, sample_b, distance, similarity FROM bc WHERE similarity > 0.1")
def similar_pairs(spark, sf_dir):
    return pairs.similar(prof(spark, sf_dir), "braycurtis", 0.1)


@query(
    """WITH c AS (SELECT nation.n_name AS sample, part.p_brand AS kmer, count(*) AS cnt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
prof AS (SELECT sample, kmer, cnt, CAST(sum(cnt) OVER (PARTITION BY sample) AS BIGINT) AS total FROM c)""" + PAIRS + " SELECT sample_a, sample_b, (both_ - 2 * m) / both_ AS distance, 1 - (both_ - 2 * m) / both_ AS similarity FROM pt"
)
def nation_brand_pairs(spark, sf_dir):
    """The same plan over another sparse profile: nations by the brands that their suppliers ship."""
    li, su, na, pa = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "part"))
    joined = li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey).join(pa, li.l_partkey == pa.p_partkey)
    return pairs.pairwise(profiles.profile(joined.groupBy(F.col("n_name").alias("sample"), F.col("p_brand").alias("kmer")).agg(F.count("*").alias("cnt"))), "braycurtis")


@query(BC + MIRROR + " SELECT sample, CAST(k AS INTEGER) AS rank, other, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY similarity DESC, other) AS k FROM mi WHERE similarity > 0) WHERE k <= 5")
def top_neighbors(spark, sf_dir):
    return pairs.top_neighbours(braycurtis(spark, sf_dir), 5).withColumn("similarity", r6("similarity"))


@query(
    BC + """, n AS (SELECT count(*) AS n FROM st) SELECT max(n.n) AS n_samples, count(*) AS n_significant_pairs, CAST(max(n.n * (n.n - 1) // 2) AS BIGINT) AS total_possible_pairs, round(1 - count(*) / max(n.n * (n.n - 1) // 2), 6) AS sparsity,
round(avg(similarity), 6) AS mean_similarity, round(stddev_pop(similarity), 6) AS std_similarity, round(min(similarity), 6) AS min_similarity, round(max(similarity), 6) AS max_similarity, round(quantile_cont(similarity, 0.5), 6) AS median_similarity FROM bc, n WHERE similarity > 0.1"""
)
def similarity_summary(spark, sf_dir):
    p = keep(prof(spark, sf_dir), "profile")
    s = pairs.similarity_summary(pairs.pairwise(p, "braycurtis"), p.select("sample").distinct().count(), 0.1)
    return s.select("n_samples", "n_significant_pairs", "total_possible_pairs", *[r6(c).alias(c) for c in s.columns[3:]])


@query(
    BC + """, s AS (SELECT avg(similarity) AS a, quantile_cont(similarity, 0.5) AS m, stddev_pop(similarity) AS d, min(similarity) AS lo, max(similarity) AS hi, quantile_cont(similarity, 0.25) AS q1, quantile_cont(similarity, 0.75) AS q3 FROM bc)
SELECT round(a, 6) AS mean_similarity, round(m, 6) AS median_similarity, round(d, 6) AS std_similarity, round(lo, 6) AS min_similarity, round(hi, 6) AS max_similarity, round(q1, 6) AS q25_similarity, round(q3, 6) AS q75_similarity,
CASE WHEN m > 0.85 THEN 'very_high' WHEN m > 0.3 THEN 'moderate' WHEN q3 > 0.3 THEN 'mixed' ELSE 'low' END AS similarity_pattern FROM s"""
)
def similarity_structure(spark, sf_dir):
    s = pairs.similarity_structure(braycurtis(spark, sf_dir))
    return s.select(*[r6(c).alias(c) for c in s.columns[:-1]], "similarity_pattern")


@query(
    BC + """, n AS (SELECT count(*) AS n FROM st), f AS (SELECT distance FROM bc UNION ALL SELECT distance FROM bc UNION ALL SELECT 0.0 FROM st)
SELECT round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, round(min(distance) FILTER (distance > 0), 6) AS min_positive, round(max(distance), 6) AS max FROM f"""
)
def distance_overview(spark, sf_dir):
    p = keep(prof(spark, sf_dir), "profile")
    s = pairs.distance_overview(pairs.pairwise(p, "braycurtis"), p.select("sample").distinct().count())
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query(
    BC + """, e AS (SELECT min(distance) AS lo, max(distance) AS hi FROM bc), b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((distance - lo) / ((hi - lo) / 20)) AS INTEGER), 19) END AS bin FROM bc, e)
SELECT CAST(g AS INTEGER) AS bin, round(lo + g * ((hi - lo) / 20), 6) AS low, round(lo + (g + 1) * ((hi - lo) / 20), 6) AS high, (SELECT count(*) FROM b WHERE bin = g) AS n FROM e, (SELECT unnest(range(0, 20)) AS g)"""
)
def distance_histogram(spark, sf_dir):
    return pairs.distance_histogram(braycurtis(spark, sf_dir)).select("bin", r6("low").alias("low"), r6("high").alias("high"), "n")


@query(
    BC + MIRROR + """, reach AS (SELECT sample AS id, sample AS c FROM st UNION SELECT mi.other, reach.c FROM reach JOIN mi ON mi.sample = reach.id WHERE mi.similarity >= 0.35),
comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id) SELECT component, list_sort(list(id)) AS samples, count(*) AS n FROM comp GROUP BY component HAVING count(*) >= 2"""
)
def sample_components(spark, sf_dir):
    p = keep(prof(spark, sf_dir), "profile")
    return graph.sample_clusters(p.select("sample").distinct(), pairs.pairwise(p, "braycurtis"), 0.35)


_HASHES = ", ".join(f"min(({a} * x + {b}) % 2147483647)" for a, b in lsh.coefficients(128))


@query(
    BASE + f""", pk AS (SELECT sample, list_reduce(list_transform(range(1, 12), lambda i: CAST(instr('ACGT', substr(kmer, i, 1)) - 1 AS BIGINT)), lambda a, x: a * 4 + x) AS x FROM kc),
sg AS (SELECT sample, [{_HASHES}] AS g FROM pk GROUP BY sample), bd AS (SELECT sample, i, g[i + 1] AS u FROM sg, (SELECT unnest(range(0, 128)) AS i)),
cd AS (SELECT DISTINCT a.sample AS sample_a, b.sample AS sample_b FROM bd a JOIN bd b ON a.i = b.i AND a.u = b.u AND a.sample < b.sample)
SELECT * FROM (SELECT sample_a, sample_b, len(list_filter(list_zip(a.g, b.g), lambda z: z[1] = z[2])) / 128 AS similarity FROM cd JOIN sg a ON a.sample = sample_a JOIN sg b ON b.sample = sample_b) WHERE similarity > 0.1"""
)
def lsh_pairs(spark, sf_dir):
    """128 bands of one row: pairs whose estimate is above 0.1 agree in 13 hashes and so meet in 13 bands."""
    return lsh.lsh_similarities(counts(spark, sf_dir), 0.1, bands=128, rows=1)


@query(BC + """, n AS (SELECT sample, row_number() OVER (ORDER BY sample) AS i FROM st), c AS (SELECT * FROM bc)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(similarity, 6) AS value FROM (SELECT sample_a, sample_b, similarity FROM c UNION ALL SELECT sample_b, sample_a, similarity FROM c) JOIN n a ON a.sample = sample_a JOIN n b ON b.sample = sample_b
UNION ALL SELECT CAST(i AS INTEGER), CAST(i AS INTEGER), 1.0 FROM n""")
def similarity_coordinates(spark, sf_dir):
    p = keep(prof(spark, sf_dir), "profile")
    return results.coordinates(pairs.pairwise(p, "braycurtis"), p).withColumn("value", r6("value"))


@query(BC + MIRROR + " SELECT sample, other, round(distance, 6) AS value FROM mi UNION ALL SELECT sample, sample, 0.0 FROM st")
def distance_heatmap(spark, sf_dir):
    p = keep(prof(spark, sf_dir), "profile")
    return plotdata.heatmap(pairs.pairwise(p, "braycurtis"), p).withColumn("value", r6("value"))


@query(BC + " SELECT round(corr(bc.distance, 1 - pt.inter / (pt.n_a + pt.n_b - pt.inter)), 6) AS r, count(*) AS n_pairs FROM bc JOIN pt USING (sample_a, sample_b)")
def matrix_correlation(spark, sf_dir):
    p = keep(prof(spark, sf_dir), "profile")
    return pairs.matrix_correlation(pairs.pairwise(p, "braycurtis"), pairs.pairwise(p, "jaccard")).select(r6("r").alias("r"), "n_pairs")


# ---- metadata and statistics


@query(PROFILE + META + ", s AS (SELECT DISTINCT sample FROM prof) SELECT s.sample, lang, source, round(mean_chars, 6) AS mean_chars FROM s LEFT JOIN meta USING (sample)")
def metadata_join(spark, sf_dir):
    return metadata.align(prof(spark, sf_dir).select("sample").distinct(), meta(spark, sf_dir)).withColumn("mean_chars", r6("mean_chars"))


@query(META.replace(", meta", "WITH meta", 1) + """, a AS (SELECT sample FROM meta WHERE lang <> 'fr'), b AS (SELECT sample FROM meta WHERE lang <> 'es')
SELECT coalesce(a.sample, b.sample) AS sample, CASE WHEN b.sample IS NULL THEN 'missing' WHEN a.sample IS NULL THEN 'extra' ELSE 'common' END AS status FROM a FULL JOIN b ON a.sample = b.sample""")
def metadata_coverage(spark, sf_dir):
    m = meta(spark, sf_dir)
    return metadata.coverage(m.where("lang <> 'fr'").select("sample"), m.where("lang <> 'es'"))


@query(META.replace(", meta", "WITH meta", 1) + """, q AS (SELECT quantile_cont(mean_chars, 0.33) AS lo, quantile_cont(mean_chars, 0.67) AS hi, count(DISTINCT mean_chars) AS n FROM meta)
SELECT sample, CASE WHEN n <= 10 THEN mean_chars WHEN mean_chars < lo THEN 0.0 WHEN mean_chars < hi THEN 1.0 ELSE 2.0 END AS bin FROM meta, q""")
def numeric_bins(spark, sf_dir):
    return stats.bin_numeric(meta(spark, sf_dir), "mean_chars").select("sample", "bin")


@query(META.replace(", meta", "WITH meta", 1) + " SELECT sample, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM meta")
def label_codes(spark, sf_dir):
    return stats.label_encode(meta(spark, sf_dir), "source").select("sample", "code")


@query("SELECT 'lang' AS variable, count(*) FILTER (lang IS NULL) AS missing_count FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents")
def missing_counts(spark, sf_dir):
    return stats.missing_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


LABELS = META + ", g0 AS (SELECT 'lang' AS variable, sample, lang AS value FROM meta UNION ALL SELECT 'source', sample, source FROM meta)"
PERMUTED = LABELS + """, dealt AS (SELECT variable, perm, sample, row_number() OVER (PARTITION BY variable, perm ORDER BY md5(perm || '#' || sample || '#0'), sample) AS k FROM g0, (SELECT unnest(range(1, 100)) AS perm)),
given AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY sample) AS k FROM g0),
g AS (SELECT variable, 0 AS perm, sample, value FROM g0 UNION ALL SELECT variable, perm, sample, value FROM dealt JOIN given USING (variable, k)),
sz AS (SELECT variable, perm, value, count(*) AS n FROM g GROUP BY ALL), wh AS (SELECT variable, perm, sum(n) AS nn, count(*) AS gg, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS idf FROM sz GROUP BY ALL),
d AS (SELECT a.variable, a.perm, a.value AS va, b.value AS vb, distance * distance AS d2 FROM bc JOIN g a ON a.sample = sample_a JOIN g b ON b.sample = sample_b AND b.variable = a.variable AND b.perm = a.perm),
tot AS (SELECT variable, perm, sum(d2) AS s1, sum(d2 * d2) AS s2 FROM d GROUP BY ALL), inn AS (SELECT variable, perm, va AS value, sum(d2) AS g1, sum(d2 * d2) AS g2 FROM d WHERE va = vb GROUP BY ALL)"""
FINISH = """, f AS (SELECT variable, perm, ((sst - ssw) / (gg - 1)) / (ssw / dfw) AS f, (sst - ssw) / sst AS r2, nn, gg FROM x)
SELECT o.variable, round(o.f, 6) AS f_statistic, round({p}, 6) AS p_value, round(o.r2, 6) AS r_squared, CAST(o.nn AS BIGINT) AS n_samples, CAST(o.gg AS BIGINT) AS n_groups FROM f o WHERE o.perm = 0"""


def _permanova(spark, sf_dir, variant):
    m = meta(spark, sf_dir).select("sample", "lang", "source")
    done = stats.permanova(braycurtis(spark, sf_dir).persist(), stats.long_metadata(m), 99, variant)
    return done.select("variable", r6("f_statistic").alias("f_statistic"), r6("p_value").alias("p_value"), r6("r_squared").alias("r_squared"), "n_samples", "n_groups")


@query(
    BC + PERMUTED + ", x AS (SELECT variable, perm, s1 / nn AS sst, (SELECT sum(coalesce(g1, 0) / n) FROM sz LEFT JOIN inn USING (variable, perm, value) WHERE sz.variable = wh.variable AND sz.perm = wh.perm) AS ssw, nn, gg, nn - gg AS dfw FROM wh JOIN tot USING (variable, perm))"
    + FINISH.format(p="(1 + (SELECT count(*) FROM f s WHERE s.variable = o.variable AND s.perm > 0 AND s.f >= o.f * (1 - 1e-9))) / 100")
)
def permanova_standard(spark, sf_dir):
    return _permanova(spark, sf_dir, "standard")


@query(
    BC + PERMUTED + ", x AS (SELECT variable, perm, 2 * s2 - 4 * s1 * s1 / (nn * nn) AS sst, (SELECT sum(CASE WHEN n > 1 THEN 2 * coalesce(g2, 0) - 4 * coalesce(g1, 0) * coalesce(g1, 0) / (n * n) ELSE 0 END) FROM sz LEFT JOIN inn USING (variable, perm, value) WHERE sz.variable = wh.variable AND sz.perm = wh.perm) AS ssw, nn, gg, idf AS dfw FROM wh JOIN tot USING (variable, perm))"
    + FINISH.format(p="(SELECT count(*) FROM f s WHERE s.variable = o.variable AND s.perm > 0 AND s.f >= o.f * (1 - 1e-9)) / 99")
)
def permanova_simple(spark, sf_dir):
    return _permanova(spark, sf_dir, "simple")


@query()
def variable_ranking(spark, sf_dir):
    """All metadata columns, numeric ones binned, ranked by R squared."""
    return stats.analyze_variables(braycurtis(spark, sf_dir).persist(), meta(spark, sf_dir), n_permutations=99)


@query(
    BC + MIRROR + META + """, sz AS (SELECT lang, count(*) AS n FROM meta GROUP BY lang), nr AS (SELECT mi.sample, o.lang AS ol, sum(distance) AS d FROM mi JOIN meta o ON o.sample = mi.other GROUP BY ALL),
x AS (SELECT s.sample, s.lang AS label, z.n, max(CASE WHEN ol = s.lang THEN d / (z.n - 1) END) AS a, min(CASE WHEN ol <> s.lang THEN d / y.n END) AS b FROM meta s JOIN nr USING (sample) JOIN sz z ON z.lang = s.lang JOIN sz y ON y.lang = ol GROUP BY ALL)
SELECT sample, label, round(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END, 6) AS silhouette FROM x"""
)
def silhouette_by_label(spark, sf_dir):
    labels = meta(spark, sf_dir).select("sample", F.col("lang").alias("label"))
    return stats.silhouette(braycurtis(spark, sf_dir), labels).withColumn("silhouette", r6("silhouette"))


@query(
    """WITH c AS (SELECT CAST(label AS VARCHAR) AS label, CAST(vec_id % 7 AS VARCHAR) AS value, count(*) AS n FROM embeddings GROUP BY ALL),
a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY value)), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS s FROM c)
SELECT round((t.s - a.s * b.s / (t.n * (t.n - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (t.n * (t.n - 1) / 2)), 9) AS ari, CAST(t.n AS BIGINT) AS n_samples FROM a, b, t"""
)
def adjusted_rand(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels, values = e.select(F.col("vec_id").alias("sample"), "label"), e.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 7).alias("value"))
    return stats.adjusted_rand(labels, values).select(F.round("ari", 9).alias("ari"), "n_samples")


@query("WITH m AS (SELECT n_chars, avg(n_chars) OVER (PARTITION BY lang) AS a FROM documents) SELECT round(corr(n_chars, a) * corr(n_chars, a), 6) AS r_squared, count(*) AS n_samples FROM m")
def numeric_agreement(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labels, values = d.select(F.col("doc_id").alias("sample"), F.col("lang").alias("label")), d.select(F.col("doc_id").alias("sample"), F.col("n_chars").cast("double").alias("value"))
    return stats.numeric_agreement(labels, values).withColumn("r_squared", r6("r_squared"))


@query()
def pcoa_points(spark, sf_dir):
    names, points, _ = ordination.pcoa(braycurtis(spark, sf_dir))
    return ordination.as_table(spark, names, points, "axis")


@query()
def pca_points(spark, sf_dir):
    names, points, _ = ordination.pca(prof(spark, sf_dir))
    return ordination.as_table(spark, names, points)


@query()
def cluster_scores(spark, sf_dir):
    return clusters.identify_clusters(spark, braycurtis(spark, sf_dir))[1]


@query()
def dendrogram(spark, sf_dir):
    return plotdata.dendrogram(spark, braycurtis(spark, sf_dir))


# ---- recommendations


def lang_groups(spark, sf_dir):
    return meta(spark, sf_dir).groupBy(F.col("lang").alias("group_id")).agg(F.array_sort(F.collect_list("sample")).alias("sample_names"))


GROUPS = META + ", gd AS (SELECT a.lang AS group_id, avg(distance) AS ad, max(distance) AS md, avg(similarity) AS ms, min(similarity) AS mn, stddev_pop(similarity) AS sd FROM bc JOIN meta a ON a.sample = sample_a JOIN meta b ON b.sample = sample_b AND a.lang = b.lang GROUP BY 1), gs AS (SELECT lang AS group_id, count(*) AS n, list_sort(list(sample)) AS names FROM meta GROUP BY 1)"


@query(
    BC + GROUPS + """, q AS (SELECT gs.group_id, n, coalesce(ad, 0.0) AS a, coalesce(md, 0.0) AS m FROM gs LEFT JOIN gd USING (group_id))
SELECT group_id, CAST(n AS INTEGER) AS n, round(a, 6) AS avg_distance, round(m, 6) AS max_distance,
round(CASE WHEN n < 2 THEN 0.0 ELSE least(1.0, greatest(0.0, greatest(0.0, 1 - a / 0.3) * 0.4 + CASE WHEN n < 3 THEN 0.8 WHEN n > 8 THEN 0.7 ELSE 1.0 END * 0.2 + greatest(0.0, 1 - m / 0.3) * 0.4)) END, 6) AS quality FROM q"""
)
def group_quality(spark, sf_dir):
    g = recommend.group_distances(lang_groups(spark, sf_dir), braycurtis(spark, sf_dir))
    q = recommend.group_quality(F.col("n"), F.col("avg_distance"), F.col("max_distance"))
    return g.select("group_id", "n", r6("avg_distance").alias("avg_distance"), r6("max_distance").alias("max_distance"), r6(q).alias("quality"))


@query(
    BC + GROUPS + """, q AS (SELECT gs.group_id, n, coalesce(ms, 1.0) AS a, coalesce(mn, 1.0) AS m, coalesce(sd, 0.0) AS s FROM gs LEFT JOIN gd USING (group_id))
SELECT group_id, CAST(n AS INTEGER) AS n, round(a, 6) AS mean_similarity, round(m, 6) AS min_similarity, round(s, 6) AS std_similarity,
CASE WHEN n = 1 THEN 'individual' WHEN n > 10 AND a > 0.85 THEN 'global' ELSE 'grouped' END AS strategy, round(CASE WHEN n = 1 THEN 0.7 WHEN n > 10 AND a <= 0.85 THEN a * 0.8 ELSE a * 0.9 END, 6) AS confidence FROM q"""
)
def group_strategy(spark, sf_dir):
    g = recommend.score_groups(recommend.group_similarities(lang_groups(spark, sf_dir), braycurtis(spark, sf_dir)))
    return g.select("group_id", "n", *[r6(c).alias(c) for c in ("mean_similarity", "min_similarity", "std_similarity")], "strategy", r6("confidence").alias("confidence"))


@query(META.replace(", meta", "WITH meta", 1) + " SELECT lang AS group_id, 'source' AS variable, count(DISTINCT source) AS unique_values, count(source) AS total_samples, round(1 - (count(DISTINCT source) - 1) / count(source), 6) AS consistency FROM meta GROUP BY lang HAVING count(*) > 1 UNION ALL SELECT lang, 'lang', 1, count(*), 1.0 FROM meta GROUP BY lang HAVING count(*) > 1")
def group_consistency(spark, sf_dir):
    done = recommend.group_consistency(lang_groups(spark, sf_dir), stats.long_metadata(meta(spark, sf_dir).select("sample", "lang", "source")))
    return done.withColumn("consistency", r6("consistency"))


@query(
    BC + GROUPS + """, q AS (SELECT gs.group_id, n, coalesce(ms, 1.0) AS a FROM gs LEFT JOIN gd USING (group_id)), s AS (SELECT n, CASE WHEN n = 1 THEN 'individual' WHEN n > 10 AND a > 0.85 THEN 'global' ELSE 'grouped' END AS st, CASE WHEN n = 1 THEN 0.7 WHEN n > 10 AND a <= 0.85 THEN a * 0.8 ELSE a * 0.9 END AS c FROM q)
SELECT CASE WHEN count(*) = 1 THEN min(st) WHEN count(*) FILTER (st = 'individual') > count(*) * 0.7 THEN 'individual' WHEN count(*) FILTER (st = 'global') > 0 THEN 'mixed' ELSE 'grouped' END AS strategy,
round(greatest(0.1, sum(c * n) / sum(n) - least(0.2, count(*) FILTER (n = 1) / count(*) * 0.3)), 6) AS overall_confidence, count(*) - count(*) FILTER (n = 1) AS n_groups, count(*) FILTER (n = 1) AS n_individual FROM s"""
)
def strategy_overall(spark, sf_dir):
    g = recommend.score_groups(recommend.group_similarities(lang_groups(spark, sf_dir), braycurtis(spark, sf_dir)))
    return recommend.overall(g).withColumn("overall_confidence", r6("overall_confidence"))


@query(
    BC + GROUPS + """, q AS (SELECT group_id, n, ad FROM gs JOIN gd USING (group_id)) SELECT group_id, CAST(n AS INTEGER) AS n_samples, round(ad, 6) AS avg_distance,
CASE WHEN ad < 0.1 THEN 'Very High' WHEN ad < 0.2 THEN 'High' WHEN ad < 0.3 THEN 'Medium' ELSE 'Low-Medium' END AS predicted_quality, CASE WHEN ad < 0.1 THEN 'Low' WHEN ad < 0.2 THEN 'Low-Medium' WHEN ad < 0.3 THEN 'Medium' ELSE 'High' END AS contamination_risk,
printf('%.1fx', greatest(1.0, 2.0 - ad * 3)) AS expected_contiguity_improvement, printf('%.1fx', least(n * 0.8, 5.0)) AS expected_coverage_boost, printf('%.1fx', pow(n, 1.5)) AS computational_cost_multiplier FROM q"""
)
def group_predictions(spark, sf_dir):
    g = recommend.group_distances(lang_groups(spark, sf_dir), braycurtis(spark, sf_dir)).withColumn("confidence", F.lit(1.0))
    return recommend.predictions(g).drop("confidence").withColumn("avg_distance", r6("avg_distance"))


@query(
    META.replace(", meta", "WITH meta", 1) + """, e AS (SELECT lang AS g, sample, row_number() OVER (PARTITION BY lang ORDER BY sample) - 1 AS i FROM meta), f AS (SELECT g, CAST(i // 10 AS INTEGER) AS step, string_agg(sample || '.fastq.gz', ',' ORDER BY i) AS files, (SELECT count(*) FROM e z WHERE z.g = e.g) AS n FROM e GROUP BY ALL)
SELECT 'megahit' AS tool, g AS group_id, step, 'megahit -1 ' || files || ' --min-contig-len 1000 --k-min 21 --k-max 141 --k-step 12 --merge-level 20,0.95 -o group_' || g || CASE WHEN n > 10 THEN '_batch_' || step ELSE '' END || '_megahit --out-prefix group_' || g || CASE WHEN n > 10 THEN '_batch_' || step ELSE '' END AS command FROM f
UNION ALL SELECT 'spades', g, CAST(i AS INTEGER), 'spades.py --meta -k 21,33,55,77,99 -1 ' || sample || '.fastq.gz -o ' || sample || '_spades_group_' || g FROM e
UNION ALL SELECT 'flye', g, 0, 'cat ' || string_agg(sample || '.fastq.gz', ' ' ORDER BY i) || ' > group_' || g || '_combined.fastq && flye --nano-raw group_' || g || '_combined.fastq --meta --genome-size 10m --out-dir group_' || g || '_flye' FROM e GROUP BY g"""
)
def assembly_commands(spark, sf_dir):
    return recommend.simple_commands(lang_groups(spark, sf_dir).withColumn("strategy", F.lit("grouped")))


@query()
def recommend_simple(spark, sf_dir):
    return recommend.simple_groups(spark, braycurtis(spark, sf_dir).persist())


@query()
def recommend_standard(spark, sf_dir):
    p, long = braycurtis(spark, sf_dir).persist(), stats.long_metadata(meta(spark, sf_dir).select("sample", "lang", "source"))
    return recommend.standard_groups(spark, p, long, stats.permanova(p, long, 99))


# ---- reads


def faulty_reads(spark, sf_dir):
    """Records with faults by rule: every 7th header, 11th separator and 13th quality is broken."""
    d = scalars.evaluated(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), seq=F.upper(F.regexp_replace("text", "[^ACGTRacgtr]+", "")))
    return scalars.evaluated(
        d.select(
            F.concat_ws("_", "lang", "source").alias("sample"), F.lit("documents").alias("file"), F.col("doc_id").alias("read_no"), "seq",
            F.concat(F.when(F.col("doc_id") % 7 == 0, ">").otherwise("@"), F.col("doc_id")).alias("header"), F.when(F.col("doc_id") % 11 == 0, "-").otherwise("+").alias("plus"),
        ),
        qual=F.repeat(F.when(F.col("read_no") % 5 == 0, "#").otherwise("I"), F.length("seq") - F.when(F.col("read_no") % 13 == 0, 1).otherwise(0)),
    )


FAULTY = """WITH b AS (SELECT concat_ws('_', lang, source) AS sample, doc_id AS read_no, upper(regexp_replace(text, '[^ACGTRacgtr]', '', 'g')) AS seq FROM documents),
fr AS (SELECT *, CASE WHEN read_no % 7 = 0 THEN '>' ELSE '@' END || read_no AS header, CASE WHEN read_no % 11 = 0 THEN '-' ELSE '+' END AS plus, repeat(CASE WHEN read_no % 5 = 0 THEN '#' ELSE 'I' END, greatest(0, len(seq) - CASE WHEN read_no % 13 = 0 THEN 1 ELSE 0 END)) AS qual FROM b)"""


@query(FAULTY + " SELECT read_no, CASE WHEN header NOT LIKE '@%' THEN 'header' WHEN plus NOT LIKE '+%' THEN 'separator' WHEN len(seq) <> len(qual) THEN 'length' ELSE 'warning: letters' END AS reason FROM fr WHERE header NOT LIKE '@%' OR plus NOT LIKE '+%' OR len(seq) <> len(qual) OR NOT regexp_matches(seq, '^[ACGTN]*$')")
def bad_records(spark, sf_dir):
    return fastq.bad_records(faulty_reads(spark, sf_dir)).select("read_no", "reason")


@query(FAULTY + " SELECT read_no, seq, qual FROM fr WHERE header LIKE '@%' AND plus LIKE '+%' AND len(seq) = len(qual)")
def fastq_scan_reads(spark, sf_dir):
    """The records written as FASTQ files and scanned in ranges of 64 KiB."""
    folder = new_folder(spark, "fastq")
    record = F.concat_ws("\n", "header", "seq", "plus", "qual")
    faulty_reads(spark, sf_dir).where("seq is not null").select(record.alias("value")).write.text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path")
    scanned = fastq_scan.scan(files, split_bytes=1 << 16).records
    return fastq.valid_records(scanned).select(F.expr("cast(substr(header, 2) as long)").alias("read_no"), "seq", "qual")


@query(
    FAULTY + """, v AS (SELECT sample, read_no, regexp_replace(seq, 'G{10,}$', '') AS seq, qual FROM fr WHERE header LIKE '@%' AND plus LIKE '+%' AND len(seq) = len(qual)), t AS (SELECT sample, read_no, seq, substr(qual, 1, len(seq)) AS qual FROM v),
c AS (SELECT * FROM t WHERE len(seq) >= 50 AND len(replace(qual, 'I', '')) * 100 <= len(qual) * 30 AND len(seq) - len(replace(seq, 'N', '')) <= 5)
SELECT sample, read_no, seq, qual FROM (SELECT *, row_number() OVER (PARTITION BY sample, seq ORDER BY read_no) AS k FROM c) WHERE k = 1"""
)
def quality_filter_dedup(spark, sf_dir):
    return preprocess.clean_reads(fastq.valid_records(faulty_reads(spark, sf_dir))).select("sample", "read_no", "seq", "qual")


# The usual adapters of paired reads, planted behind the inserts.
ADAPTERS = ("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT")


def planted_mates(spark, sf_dir):
    """Mates of 75 letters from inserts of 20 to 89; the fifth letter of every third first mate is overwritten."""
    r = reads(spark, sf_dir).where("length(seq) >= 100")
    insert = F.substr(F.col("seq"), F.lit(1), (20 + F.col("read_no") % 70).cast("int"))
    mate = lambda s, adapter: F.substring(F.concat(s, F.lit(adapter + "A" * 75)), 1, 75)
    one, two = mate(insert, ADAPTERS[0]), mate(kmers.reverse_complement(insert), ADAPTERS[1])
    one = F.when(F.col("read_no") % 3 == 0, F.concat(F.substring(one, 1, 4), F.lit("A"), F.substring(one, 6, 70))).otherwise(one)
    return r.select("sample", "read_no", one.alias("seq1"), F.lit("I" * 75).alias("qual1"), two.alias("seq2"), F.lit("I" * 75).alias("qual2"))


MATES = WITH_READS + f""", ins AS (SELECT doc_id, substr(seq, 1, 20 + doc_id % 70) AS x FROM r WHERE len(seq) >= 100),
raw AS (SELECT doc_id, substr(x || '{ADAPTERS[0]}' || repeat('A', 75), 1, 75) AS a, substr(translate(reverse(x), 'ACGT', 'TGCA') || '{ADAPTERS[1]}' || repeat('A', 75), 1, 75) AS b FROM ins),
mt AS (SELECT doc_id AS read_no, CASE WHEN doc_id % 3 = 0 THEN substr(a, 1, 4) || 'A' || substr(a, 6) ELSE a END AS a, b FROM raw),
ov AS (SELECT read_no, l, sum(CASE WHEN substr(a, i, 1) <> translate(substr(b, l - i + 1, 1), 'ACGT', 'TGCA') THEN 1 ELSE 0 END) AS wrong
       FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM (SELECT *, unnest(range(20, 76)) AS l FROM mt)) GROUP BY read_no, l),
bo AS (SELECT read_no, l FROM (SELECT *, row_number() OVER (PARTITION BY read_no ORDER BY wrong / l, l DESC) AS k FROM ov WHERE wrong * 100 <= 10 * l) WHERE k = 1)"""


@query(MATES + " SELECT read_no, CASE WHEN l < 75 THEN CAST(l AS INTEGER) END AS insert_length, CASE WHEN l < 75 THEN substr(a, 1, l) ELSE a END AS seq1, CASE WHEN l < 75 THEN substr(b, 1, l) ELSE b END AS seq2 FROM mt LEFT JOIN bo USING (read_no)")
def adapter_overlaps(spark, sf_dir):
    found = adapters.overlaps(planted_mates(spark, sf_dir))
    cut = lambda c: F.coalesce(F.substr(F.col(c), F.lit(1), F.col("insert_length")), F.col(c)).alias(c)
    return found.select("read_no", "insert_length", cut("seq1"), cut("seq2"))


@query(
    WITH_READS + """, w AS (SELECT DISTINCT doc_id, least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer FROM (SELECT doc_id, substr(seq, i, 11) AS f FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - 9)) AS i FROM r WHERE len(seq) >= 11))),
h AS (SELECT DISTINCT kmer FROM w WHERE doc_id % 10 = 0) SELECT doc_id AS read_no, round(count(h.kmer) / count(*), 6) AS host_share FROM w LEFT JOIN h USING (kmer) GROUP BY doc_id"""
)
def host_share(spark, sf_dir):
    """Reads against a host made of every tenth read."""
    r = reads(spark, sf_dir)
    host = kmers.packed_sets(r.where("read_no % 10 = 0"), K, ["read_no"]).select("kmer").distinct()
    return preprocess.host_fraction(r, host, K).select("read_no", r6("host_share").alias("host_share"))


@query(
    """SELECT n_nationkey AS n, round(least(1000.0 * greatest(150 - 21 + 1, 0) * 0.1, pow(4.0, 15)) * (21 + 8) * n_nationkey / 1048576.0, 6) AS memory_mb, round(CAST(n_nationkey AS DOUBLE) * 20 + CAST(999 * n_nationkey AS DOUBLE) * 0.01, 6) AS seconds,
CASE WHEN n_nationkey > 20 THEN 'default' ELSE 'high_quality' END AS preset FROM nation"""
)
def resource_estimates(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.alias("n"), r6(scalars.memory_estimate_mb(n, F.lit(1000), F.lit(21))).alias("memory_mb"), r6(scalars.runtime_seconds(n, F.lit(21), F.lit(999))).alias("seconds"), scalars.recommended_preset(n, F.lit(16.0)).alias("preset")
    )
