"""Replaceable boundaries to external models, and offline stubs.

The stubs are deterministic stand-ins for tests; their output says nothing
about the quality of a model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T


def map_model(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any model that maps a batch of rows to rows: embedding, reranking, extraction or generation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def stub_rerank(question: Column, passage: Column) -> Column:
    """Stub: distinct shared tokens less 5, like a logit."""
    return (F.size(F.array_intersect(T.tokens(question), T.tokens(passage))) - 5).cast("double")


def stub_answer(question: Column, context: Column) -> Column:
    """Stub: echoes the question and the first 60 characters of the context."""
    return F.concat(F.lit("Q: "), question, F.lit(" A: "), F.substring(F.coalesce(context, F.lit("")), 1, 60))


def once_each(rows: DataFrame, key: list[str], model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with what a model adds to their key columns: equal keys are asked once."""
    return rows.join(model(rows.select(*key).distinct()), key, "left")


class Generator:
    """A boundary to text models by role: primary, extraction and audit fall through to the next that is set.

    ``models`` maps a role to a function from prompts to answers. A call that
    fails is made again, ``attempts`` in all, after ``wait`` seconds and twice
    as many each time; what can't be answered is null.
    """

    ORDER = {"audit": ("audit", "extraction", "primary"), "extraction": ("extraction", "primary"), "primary": ("primary",)}

    def __init__(self, models: dict[str, Callable[[Sequence[str]], Sequence[str]]], attempts: int = 3, wait: float = 2.0, retryable: Callable[[Exception], bool] = lambda e: True):
        if "primary" not in models:
            raise ValueError("a model for the role primary is needed")
        self.models, self.attempts, self.wait, self.retryable = models, attempts, wait, retryable

    def model(self, role: str) -> Callable[[Sequence[str]], Sequence[str]]:
        return next(self.models[r] for r in self.ORDER[role] if r in self.models)

    def ask(self, role: str, prompts: Sequence[str]) -> list[str | None]:
        for n in range(self.attempts):
            try:
                return list(self.model(role)(prompts))
            except Exception as e:  # noqa: BLE001  any model's error
                if n + 1 == self.attempts or not self.retryable(e):
                    break
                time.sleep(self.wait * 2**n)
        return [None] * len(prompts)

    def column(self, role: str, prompt: Column) -> Column:
        ask = self.ask

        @F.arrow_udf("string")
        def run(prompts: pa.Array) -> pa.Array:
            return pa.array(ask(role, prompts.to_pylist()), pa.string())

        return run(prompt)


def stub_embedding(text: Column, dims: int = 64) -> Column:
    """Stub: unit vector of hashed word counts, array<float>."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            v = np.bincount([sum(w.encode()) % dims for w in (t or "").lower().split()] or [0], minlength=dims).astype(np.float32)
            out.append(v / np.linalg.norm(v))
        return pa.array(out, pa.list_(pa.float32()))

    return run(text)


def stub_extraction(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stub: capitalised words of a chunk (document_id, chunk_id, text) as Concept nodes, neighbours joined by RELATED_TO edges."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0)))
    found = chunks.select("document_id", "chunk_id", names.alias("n"))
    nodes = found.select("document_id", "chunk_id", F.posexplode("n").alias("pos", "name")).select("document_id", "chunk_id", "pos", T.slug(F.col("name")).alias("id"), F.lit("Concept").alias("type"), "name")
    pairs = F.transform(F.slice("n", F.lit(1), F.greatest(F.size("n") - 1, F.lit(0))), lambda x, i: F.struct(T.slug(x).alias("source_id"), T.slug(F.col("n")[i + 1]).alias("target_id")))
    edges = found.select("document_id", "chunk_id", F.explode(pairs).alias("e")).select("document_id", "chunk_id", "e.source_id", F.lit("RELATED_TO").alias("type"), "e.target_id")
    return nodes, edges


def stub_decomposition(question: Column) -> Column:
    """Stub: parts of a question between commas, semicolons and the word and."""
    parts = F.filter(F.transform(F.split(question, r"(?i)\s*(?:[,;]|\band\b)\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(question))


def stub_opinion(answer: Column, context: Column) -> Column:
    """Stub: PASS where all numbers of the answer are in the first 6,000 characters of the context."""
    numbers = F.regexp_extract_all(answer, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    unseen = F.filter(numbers, lambda x: ~F.contains(F.substring(context, 1, 6000), x))
    return F.when(F.size(unseen) == 0, "PASS").otherwise(F.concat(F.lit("numbers not in the source: "), F.array_join(unseen, ", ")))
