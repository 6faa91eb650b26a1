"""Queries of retrieval: sparse, dense, fused, filtered, reranked and budgeted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions import text as T
from ..operators import retrieval as R
from ..sources.tables import table
from .text import TOKENS

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


SOURCES = ["src1", "src2", "src3", "src5", "src8"]
IN_SOURCES = "source IN (" + ", ".join(f"'{s}'" for s in SOURCES) + ")"
SPARSE = f"""t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM t GROUP BY term), n),
q AS (SELECT item_id, term, count(*) AS tf_q FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(tf_q::DOUBLE * idf * tf), 6) AS score FROM q JOIN t USING (term) JOIN i USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""
DENSE = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS score
FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d)"""


def _sparse(spark, sf, k: int, filters: dict | None = None) -> DataFrame:
    return R.sparse_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), k, filters=filters)


def _dense(spark, sf, k: int, filters: dict | None = None) -> DataFrame:
    v = table(spark, sf, "embeddings")
    wanted = R.payload_filter(filters)
    held = v if wanted is None else v.join(table(spark, sf, "documents").where(wanted).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return R.dense_topk(v.where("vec_id % 20 = 0"), held, k)  # the stated query set of searches


@query(f"WITH {SPARSE} SELECT item_id, doc_id, score, rank FROM sparse WHERE rank <= 10")
def sparse_topk(spark, sf):
    return _sparse(spark, sf, 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark, sf):
    return _dense(spark, sf, 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


FUSED = """f AS (SELECT qid, id, round(sum(1.0 / (2 + rank - 1)), 6) AS score FROM (SELECT item_id * 20 AS qid, doc_id AS id, rank FROM sparse WHERE rank <= 45
UNION ALL SELECT query_id, vec_id, rank FROM dense WHERE rank <= 45) GROUP BY ALL), fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)"""
FILTERED = f"""sparse_f AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id) WHERE {IN_SOURCES}),
dense_f AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d JOIN documents ON vec_id = doc_id WHERE {IN_SOURCES})"""


def _fused(spark, sf, limit: int, filters: dict | None = None) -> DataFrame:
    """Both channels' best, each under the filter, fused."""
    a = _sparse(spark, sf, 3 * limit, filters).select((F.col("item_id") * 20).alias("qid"), F.col("doc_id").alias("id"), "rank")
    b = _dense(spark, sf, 3 * limit, filters).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("id"), "rank")
    return R.rrf([a, b], "qid", "id", limit)


@query(f"WITH {SPARSE}, {DENSE}, {FUSED} SELECT qid, id, score, rank FROM fused WHERE rank <= 15")
def rrf_fusion(spark, sf):
    return _fused(spark, sf, 15).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SPARSE}, {DENSE}, {FILTERED}, {FUSED.replace('FROM sparse', 'FROM sparse_f').replace('FROM dense', 'FROM dense_f')} SELECT qid, id, score, source FROM fused JOIN documents ON id = doc_id WHERE rank <= 15")
def filtered_hybrid(spark, sf):
    """Hybrid search in some sources: both channels rank only what passes the filter, so that each question gets its full number of hits."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return _fused(spark, sf, 15, {"source": SOURCES}).join(docs, "id").select("qid", "id", "score", "source")


@query(f"WITH {SPARSE} SELECT item_id, doc_id, score, rank FROM sparse WHERE rank <= 10")
def unselected_is_all(spark, sf):
    """An empty selection of documents filters nothing."""
    return _sparse(spark, sf, 10, {"source": []}).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


SUBS = """g AS (SELECT item_id // 2 AS question, list(text ORDER BY item_id) AS parts FROM benchmark GROUP BY 1),
x AS (SELECT question, CASE WHEN len(parts) > 1 THEN list_concat([array_to_string(parts, ' ')], parts) ELSE parts END AS parts FROM g),
subs AS (SELECT question * 10 + ix AS item_id, question, ix AS sub, text, n FROM (SELECT question, unnest(parts) AS text, unnest(range(len(parts))) AS ix, len(parts) AS n FROM x))"""


def _subs(spark, sf) -> DataFrame:
    """Two benchmark items make one question: its parts, and before them the question itself."""
    pairs = table(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 2).alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]).alias("parts"))
    return R.sub_queries(pairs.withColumn("whole", F.array_join("parts", " ")), "question", "whole", "parts")


@query(f"WITH {SUBS} SELECT question, sub::BIGINT AS sub, md5(text) AS digest FROM subs")
def sub_query_expansion(spark, sf):
    return _subs(spark, sf).select("question", F.col("sub").cast("long").alias("sub"), F.md5("text").alias("digest"))


@query(f"""WITH {SUBS}, {SPARSE.replace("FROM benchmark", "FROM subs")},
h AS (SELECT question, sub, rank, doc_id, md5(substr(d.text, 1, 200)) AS fp FROM sparse JOIN subs USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= greatest(5, 10 // n))
SELECT question, doc_id, sub::BIGINT AS from_subquery FROM h QUALIFY row_number() OVER (PARTITION BY question, fp ORDER BY sub, rank) = 1""")
def multi_query_limit(spark, sf):
    """Each part of a question, and the question itself, has its share of the limit; repeated texts count once."""
    subs = _subs(spark, sf)
    n = subs.groupBy("question").agg(F.count("*").alias("n"))
    asked = subs.withColumn("qid", F.col("question") * 10 + F.col("sub"))
    hits = R.sparse_topk(asked.select("qid", "text"), table(spark, sf, "documents"), 10, "qid").withColumn("question", F.floor(F.col("qid") / 10)).withColumn("sub", F.col("qid") % 10)
    hits = hits.join(n, "question").where(F.col("rank") <= R.per_query_limit(F.col("n"), F.lit(False)))
    docs = table(spark, sf, "documents").select("doc_id", T.text_fingerprint(F.col("text")).alias("fp"))
    return R.keep_first(hits.join(docs, "doc_id"), ["question", "fp"], ["sub", "rank"]).select("question", "doc_id", F.col("sub").alias("from_subquery"))


RERANK = f"""r AS (SELECT item_id, doc_id, rank AS prior, (SELECT count(*) FROM (SELECT DISTINCT unnest({TOKENS.replace("text", "b.text")}) AS w INTERSECT SELECT DISTINCT unnest({TOKENS.replace("text", "d.text")}))) - 5.0 AS rerank_score
FROM sparse JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 15), m AS (SELECT *, max(rerank_score) OVER (PARTITION BY item_id) AS best FROM r),
top7 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, prior) AS rank FROM m WHERE rerank_score > 2.0 OR best <= 2.0)"""


def _reranked(spark, sf) -> DataFrame:
    """The stub model's score is the number of distinct terms that question and document share, which the search has counted."""
    hits = _sparse(spark, sf, 15).select("item_id", "doc_id", F.col("rank").alias("prior"), (F.col("shared") - 5).cast("double").alias("rerank_score"))
    return R.rerank(hits, "item_id", "rerank_score", "prior", 2.0)


def _with_texts(spark, sf, hits: DataFrame) -> DataFrame:
    return hits.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(f"WITH {SPARSE}, {RERANK} SELECT item_id, doc_id, CAST(rerank_score AS DOUBLE) AS rerank_score, rank FROM top7 WHERE rank <= 7")
def rerank_threshold_top7(spark, sf):
    return _reranked(spark, sf).select("item_id", "doc_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SPARSE}, {RERANK} SELECT item_id, doc_id, rank, running FROM (SELECT item_id, doc_id, rank, sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank) AS running
FROM top7 JOIN documents USING (doc_id) WHERE rank <= 7) WHERE running < 58000""")
def context_budget(spark, sf):
    return R.within_budget(_with_texts(spark, sf, _reranked(spark, sf)), ["item_id"], [F.col("rank")], F.length("text").cast("long"), 58_000).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "running")


@query("""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS ix FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT *, 2 * len(regexp_extract_all(line, '[0-9]+\\.?[0-9]*')) + CASE WHEN regexp_matches(line, '[$€£%]|[0-9]+[MBK]|[0-9]+\\.[0-9]+') THEN 5 ELSE 0 END AS score FROM l)
SELECT doc_id, ix AS line_no, score FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY score DESC, ix) AS running FROM s) WHERE running <= 6000""")
def number_dense_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("score", T.line_density(F.col("line")))
    kept = R.within_budget(lines, ["doc_id"], [F.desc("score"), F.col("line_no")], F.length("line"), 6000, strict=False)
    return kept.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("score").cast("long").alias("score"))


@query(f"""WITH {SPARSE}, c AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT count(*) AS n_pairs, count(s.doc_id) AS n_found, round(count(s.doc_id)::DOUBLE / greatest(count(*), 1), 6) AS recall FROM c LEFT JOIN (SELECT item_id, doc_id FROM sparse WHERE rank <= 10) s USING (item_id, doc_id)""")
def retrieval_recall(spark, sf):
    """Share of (item, document that contains it) pairs that the sparse top 10 finds; candidates share the rarest inner word of the item."""
    items = table(spark, sf, "benchmark")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # a document that holds the item holds all of its inner words: the rarest of them bounds the pairs; items without an inner word are few and short, and meet all documents
    inner = lambda c: F.slice(F.split(c, r"\s"), 2, F.greatest(F.size(F.split(c, r"\s")) - 2, F.lit(0)))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s"))).alias("word"))
    asked = items.select("item_id", F.explode_outer(F.filter(F.array_distinct(inner(F.col("text"))), lambda w: w != "")).alias("word"))
    seen = words.join(asked.select("word").distinct(), "word", "left_semi")
    rare = asked.where("word IS NOT NULL").join(seen.groupBy("word").agg(F.count("*").alias("n")), "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"))
    short = [r["item_id"] for r in asked.where("word IS NULL").select("item_id").collect()]
    near = seen.join(rare, "word").select("item_id", "doc_id")
    if short:
        near = near.union(docs.select(F.explode(F.array(*[F.lit(i) for i in short])).cast("long").alias("item_id"), "doc_id"))
    pairs = near.join(items.select("item_id", F.col("text").alias("item")), "item_id").join(docs, "doc_id").where(F.col("text").contains(F.col("item"))).select("item_id", "doc_id")
    found = _sparse(spark, sf, 10).select("item_id", "doc_id", F.lit(1).alias("hit"))
    n, k = F.count("*"), F.count("hit")
    return pairs.join(found, ["item_id", "doc_id"], "left").agg(n.alias("n_pairs"), k.alias("n_found"), F.round(k / F.greatest(n, F.lit(1)), 6).alias("recall"))


@query("""SELECT doc_id, printf('[Source: %s | Section: %s | Pg %s | Score: %.2f]', CASE WHEN doc_id % 4 = 0 THEN 'Unknown' ELSE source END, CASE WHEN doc_id % 3 = 0 THEN 'General' ELSE concat('S', doc_id % 4) END,
CASE WHEN doc_id % 7 = 0 THEN '?' ELSE (doc_id % 50)::VARCHAR END, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE (doc_id % 97) / 10.0 END::DOUBLE) || chr(10) || text AS line FROM documents""")
def context_lines(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.context_line(F.when(i % 4 != 0, F.col("source")), F.when(i % 3 != 0, F.concat(F.lit("S"), (i % 4).cast("string"))), F.when(i % 7 != 0, i % 50), F.when(i % 5 != 0, (i % 97) / F.lit(10.0)), F.col("text")).alias("line"))


MARKED = "CASE WHEN doc_id % 3 = 0 THEN concat('GRAPH CONNECTIONS ', text) ELSE text END"


@query(f"""WITH {SPARSE}, {RERANK}, x AS (SELECT item_id, rank, {MARKED} AS text FROM (SELECT * FROM top7 WHERE rank <= 7) JOIN documents USING (doc_id)),
v AS (SELECT item_id, count(*) AS n, string_agg(text, chr(10) ORDER BY rank) AS t FROM (SELECT *, sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank) AS run FROM x WHERE NOT contains(text, 'GRAPH CONNECTIONS')) WHERE run + 100 < 18000 GROUP BY item_id),
g AS (SELECT item_id, arg_min(text, rank) AS g FROM x WHERE contains(text, 'GRAPH CONNECTIONS') GROUP BY item_id)
SELECT item_id, coalesce(n, 0) AS n_docs, md5(CASE WHEN n IS NULL THEN 'No relevant context.' ELSE coalesce(g, '') || chr(10) || chr(10) || t END) AS digest FROM (SELECT DISTINCT item_id FROM x) LEFT JOIN v USING (item_id) LEFT JOIN g USING (item_id)""")
def context_assembled(spark, sf):
    """Documents with the graph's mark apart from the others, which share a budget of 20,000 characters."""
    docs = _with_texts(spark, sf, _reranked(spark, sf)).withColumn("text", F.expr(MARKED))
    return R.assembled_context(docs, "item_id", "rank", F.lit(100), 20_000).select("item_id", "n_docs", F.md5("context").alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS ix FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT *, 2 * len(regexp_extract_all(line, '[0-9]+\\.?[0-9]*')) + CASE WHEN regexp_matches(line, '[$€£%]|[0-9]+[MBK]|[0-9]+\\.[0-9]+') THEN 5 ELSE 0 END AS score FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY score DESC, ix) AS t FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY score DESC, ix) AS running FROM s) WHERE running <= 6000 GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN regexp_replace(coalesce(t, ''), '\\s+', '', 'g') <> '' THEN t ELSE substr(text, 1, 6000) END) AS digest FROM documents LEFT JOIN k USING (doc_id)""")
def dense_context(spark, sf):
    """The densest lines of each document, or its beginning where no line fits."""
    return R.dense_lines(table(spark, sf, "documents")).select("doc_id", F.md5("context").alias("digest"))


def flagship(spark, sf):
    return filtered_hybrid(spark, sf)


@query(None)
def answer_pipeline(spark, sf):
    """From question to answer, all stages: type, candidates, rerank, budget, stub answer, audit class and confidence."""
    asked = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    ranked = R.within_budget(_with_texts(spark, sf, _reranked(spark, sf)), ["item_id"], [F.col("rank")], F.length("text").cast("long"), 58_000).join(asked, "item_id")
    context = ranked.groupBy("item_id", "question").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("parts"), F.max("rerank_score").alias("top"), F.array_sort(F.collect_set("doc_id")).alias("sources"))
    joined = context.withColumn("context", F.array_join("parts", "\n"))
    kind = T.contradiction(F.col("context"))
    return joined.select("item_id", T.question_type(F.col("question")).alias("question_type"), T.is_multi_entity(F.col("question")).alias("multi_entity"), "sources", models.stub_answer(F.col("question"), F.col("context")).alias("answer"), kind.alias("contradiction"), F.round(T.confidence(F.col("top"), kind != "none", F.lit(False)), 6).alias("confidence"))


@query("SELECT source, count(*) AS n_documents, sum(length(text)) AS n_chars, min_by(concat('Q: Summarize ', source, ' A: ', substr(text, 1, 60)), doc_id) AS answer FROM documents GROUP BY source")
def summarize_source(spark, sf):
    d = table(spark, sf, "documents")
    answer = models.stub_answer(F.concat(F.lit("Summarize "), "source"), F.col("text"))
    return d.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"), F.min_by(answer, "doc_id").alias("answer"))
