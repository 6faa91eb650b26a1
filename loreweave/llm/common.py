"""Helpers shared by the operators: tables, shared staging, batches, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir, stage

__all__ = ["batch_count", "batch_of", "components", "dealt_by", "partitions", "shared_dir", "stage", "table", "text_bytes"]

#: Bytes of text that one Python call handles at a time.
BATCH_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of the whole column, one aggregate row."""
    return docs.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_count(spark: SparkSession, n_bytes: int, batch_bytes: int = BATCH_BYTES) -> int:
    """Batches of whole rows; grows with the input, so that a batch stays bounded."""
    return max(partitions(spark), -(-n_bytes // batch_bytes))


def batch_of(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def dealt_by(text: str = "text") -> Column:
    """What a row is dealt into batches by: its id, or where it has none its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable vertex for each vertex of ``edges(u, v)`` (longs): (vertex, component).

    Alternating large-star and small-star rounds; every round is staged and the
    loop ends when a round changes nothing. A vertex with very many neighbours
    is pre-aggregated for its minimum and only meets them again in a join that
    Spark can split. Empty edges give an empty result.
    """
    cur = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star on edges (u, v) with v < u: every lower neighbour and u itself point to the lowest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur = stage(small)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
