"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import stage, table
from loreweave.llm.jaccard import jaccard_components
from loreweave.llm.packing import pack
from loreweave.llm.pieces import token_count
from loreweave.llm.quality import resample
from loreweave.llm.suffix import dedup_substrings
from loreweave.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.5 or more go. The labelled rows are taken from what the stage gets."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("toxicity < 0.5").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resampling doesn't draw go. Without labelled good rows all weigh the same and all stay."""
    return resample(docs, table(spark, sf_dir, "labels")).where("selected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard of 0.8 or more stays: the one with the smallest id. Rows with a null id stay."""
    first = jaccard_components(docs, k=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document go; a text of which nothing is left goes with its document."""
    left = dedup_substrings(docs).where("n_removed = 0 OR n_removed < n_bytes")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its text, its number of tokens, and its place in a batch of its length bucket. An empty table gives an empty one."""
    return pack(docs, token_count(), carry=True)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: Trained models and byte-exact passages can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: every stage on all rows of the one before, written and reread in between. Rows with null ids or texts are handled as each operator says."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
