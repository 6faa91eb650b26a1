"""Sparse and dense retrieval, fusion, reranking and context budgets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage

RRF_K = 2
#: Vectors and queries that a task multiplies at once.
VECTOR_ROWS, QUERY_ROWS = 65_536, 2048


def chunk_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with text: doc_id, chunk_ix from 0, source, text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", "source", F.posexplode(lines).alias("chunk_ix", "text")).select("doc_id", "chunk_ix", "source", "text")


def term_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, n: int) -> DataFrame:
    """ln(1 + (N - df + 0.5) / (df + 0.5)) for each term."""
    df = F.col("df").cast("double")
    return tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5)))


def top(df: DataFrame, per: str | list[str], score: Column, tie: str, k: int | Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(per).orderBy(score.desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def payload_filter(filters: dict | None) -> Column | None:
    """All of the columns' conditions: one of a list's values, or a single value. None for no filter; an empty list filters nothing."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in (filters or {}).items() if not (isinstance(v, (list, tuple, set)) and not v)]
    return reduce(lambda a, b: a & b, parts) if parts else None


def sparse_topk(questions: DataFrame, docs: DataFrame, k: int = 10, question_key: str = "item_id", filters: dict | None = None) -> DataFrame:
    """Sum of tf (question) x idf x tf (document), rounded before ranking, and ``shared``, the number of distinct terms in common.

    A term's document frequency is counted over all documents; postings of
    terms in no question leave before the join's shuffle by a semi-join and are
    worked out once. ``filters`` restrict the documents that are ranked.
    """
    wanted = payload_filter(filters)
    columns = list(filters) if wanted is not None else []
    asked = term_counts(questions, question_key).withColumnRenamed("tf", "tf_q")
    terms = docs.select("doc_id", *columns, F.explode(T.tokens(F.col("text"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = stage(terms.groupBy("doc_id", "term", *columns).agg(F.count("*").alias("tf")))
    weights = idf(tf, docs.count()).select("term", "idf")
    ranked = tf if wanted is None else tf.where(wanted)
    gained = F.round(F.sum(F.col("tf_q").cast("double") * F.col("idf") * F.col("tf")), 6)
    hits = ranked.join(asked.join(weights, "term"), "term").groupBy(question_key, "doc_id").agg(gained.alias("score"), F.count("*").alias("shared"))
    return top(hits, question_key, F.col("score"), "doc_id", k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """Exact cosine top ``k`` of each query over all vectors: query_id, vec_id, score, rank.

    One plan over a grid of query blocks and vector blocks of bounded size: a
    task multiplies two blocks and passes on each query's best ``k`` of them.
    """
    spark = vectors.sparkSession
    down = max(1, -(-queries.count() // QUERY_ROWS))
    across = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // VECTOR_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(key).cast("long").alias("query_id"), F.col(col).cast("array<double>").alias("q"), F.pmod(F.xxhash64(key), F.lit(down)).cast("int").alias("down"), spread(across).alias("across"))
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(across)).cast("int").alias("across"), spread(down).alias("down"))
    best = q.groupBy("down", "across").cogroup(v.groupBy("down", "across")).applyInArrow(lambda a, b: _best(a, b, k, exclude_self), "query_id long, id long, score double")
    return top(best.withColumnRenamed("id", key), "query_id", F.col("score"), key, k)


def _unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(queries: pa.Table, vectors: pa.Table, k: int, exclude_self: bool) -> pa.Table:
    rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(queries) and len(vectors):
        ids, vid = queries.column("query_id").to_numpy(), vectors.column("id").to_numpy()
        q, v = _unit(queries.column("q"), len(ids)), _unit(vectors.column("v"), len(vid))
        for a in range(0, len(ids), 256):
            s = np.round(q[a : a + 256] @ v.T, 6)
            if exclude_self:
                s[ids[a : a + 256, None] == vid[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
            score = np.take_along_axis(s, order, 1)
            ok = np.isfinite(score)
            rows.append((np.broadcast_to(ids[a : a + 256, None], order.shape)[ok], vid[order[ok]], score[ok]))
    return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))


def rrf(channels: list[DataFrame], per: str, item: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (columns per, item, rank from 1); a missing channel adds nothing."""
    union = channels[0].select(per, item, "rank")
    for c in channels[1:]:
        union = union.unionByName(c.select(per, item, "rank"))
    fused = union.groupBy(per, item).agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1)), 6).alias("score"))
    return top(fused, per, F.col("score"), item, limit)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def per_query_limit(n: Column, multi_entity: Column) -> Column:
    """max(5, base div n), base 10 or 15; n counts the original question when there are several."""
    return F.greatest(F.lit(5), F.floor(F.when(multi_entity, 15).otherwise(10) / n)).cast("int")


def rerank(df: DataFrame, per: str, score: str, prior: str, threshold: float | None, k: int = 7) -> DataFrame:
    """Rows over the threshold, or all where none is or no threshold is set, best ``k`` of each question; ties keep the prior order."""
    kept = df
    if threshold is not None:
        best = F.max(score).over(Window.partitionBy(per))
        kept = df.withColumn("__best", best).where((F.col(score) > threshold) | (F.col("__best") <= threshold)).drop("__best")
    return top(kept, per, F.col(score), prior, k)


def within_budget(df: DataFrame, per: list[str], order: list[Column], size: Column, limit: int, strict: bool = True) -> DataFrame:
    """The leading rows whose running size stays under (or at) the limit."""
    run = F.sum(size).over(Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", run).where(F.col("running") < limit if strict else F.col("running") <= limit)


def last_turns(df: DataFrame, per: str, turn: str, n: int) -> DataFrame:
    return df.withColumn("back", F.row_number().over(Window.partitionBy(per).orderBy(F.desc(turn)))).where(F.col("back") <= n)


def sub_queries(questions: DataFrame, key: str, question: str, parts: str) -> DataFrame:
    """A question's parts (an array), one row each: (key, sub, text). With several parts the question itself comes first, as number 0."""
    several = F.size(parts) > 1
    every = F.when(several & ~F.array_contains(F.col(parts), F.col(question)), F.concat(F.array(question), F.col(parts))).otherwise(F.when(F.size(parts) > 0, F.col(parts)).otherwise(F.array(question)))
    return questions.select(key, F.posexplode(every).alias("sub", "text"))


def dense_lines(docs: DataFrame, limit: int = 6000) -> DataFrame:
    """The densest lines of each text (doc_id, text) in a budget of characters, joined: (doc_id, context). Where they are blank, the text's beginning.

    A document's lines are looked at together; separators don't count.
    """
    scored = F.transform(F.split("text", "\n"), lambda x, i: F.struct((-T.line_density(x)).alias("less"), i.alias("i"), x.alias("line")))
    step = lambda acc, x: F.struct((acc["size"] + F.length(x["line"])).alias("size"), F.when(acc["size"] + F.length(x["line"]) <= limit, F.concat(acc["lines"], F.array(x["line"]))).otherwise(acc["lines"]).alias("lines"))
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("lines"))
    kept = F.array_join(F.aggregate(F.array_sort(scored), start, step, lambda a: a["lines"]), "\n")
    return docs.select("doc_id", F.when(F.trim(F.regexp_replace(kept, r"\s+", "")) != "", kept).otherwise(F.substring("text", 1, limit)).alias("context"))


def assembled_context(docs: DataFrame, per: str, order: str, base: Column, limit: int = 60_000, reserve: int = 2000) -> DataFrame:
    """Context of each question: its graph text, then the documents that fit the budget; "No relevant context." where none does, even with a graph text.

    ``base`` is the size of what else the model reads. Returns (per, n_docs, context).
    """
    plain = within_budget(docs.where(~T.is_graph_context(F.col("text"))).withColumn("__base", base), [per], [F.col(order)], F.length("text").cast("long"), limit)
    kept = plain.where(F.col("running") + F.col("__base") < limit - reserve)
    joined = kept.groupBy(per).agg(F.count("*").alias("n_docs"), F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("parts"))
    graph = docs.where(T.is_graph_context(F.col("text"))).groupBy(per).agg(F.min_by("text", order).alias("graph"))
    every = docs.select(per).distinct().join(joined, per, "left").join(graph, per, "left")
    return every.select(per, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.when(F.col("n_docs") > 0, F.concat(F.coalesce("graph", F.lit("")), F.lit("\n\n"), F.array_join("parts", "\n"))).otherwise("No relevant context.").alias("context"))
