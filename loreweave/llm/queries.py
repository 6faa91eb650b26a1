"""The registered queries of this folder's operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fingerprint import fingerprints
from .html import extract
from .jaccard import jaccard_components
from .media import digests, store
from .packing import pack
from .pieces import round_trip, token_count
from .quality import resample
from .sentences import dedup_sentences
from .suffix import dedup_substrings
from .toxicity import held_out, score_toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key", "selected")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), token_count())


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return digests(store(docs)).drop("text", "media")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_fingerprints, op3_ngram_jaccard_join, op4_quality_classifier, op5_sentencepiece, op6_packing, op7_media_columns, op8_html_extraction, op9_suffix_array_dedup, op10_toxicity, pipeline)
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Twins of the queries that SQL can express; the others hash, train or decode, and are held against brute force in the tests.
ORACLE_SQL = {
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.u, r.c FROM r JOIN b ON r.doc_id = b.v)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = n.doc_id) AS component_id, (SELECT count(*) FROM b WHERE b.u = n.doc_id) AS n_links FROM n""",
    "op9_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM w) WHERE f < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i > p + 50 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m)),
x AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY doc_id, k),
y AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
k AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN z IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
