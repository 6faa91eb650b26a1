"""Answers held against their sources: four gates, one after the other, and a bounded second attempt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Answers that are given at most, with feedback from the second on.
ATTEMPTS = 2


def no_answer(answer: Column) -> Column:
    return answer.contains("I don't know") | F.lower(answer).contains("not found")


def fabricated_causes(answer: Column, context: Column, question: Column) -> Column:
    """Causal phrases of the answer that neither the context nor the question has."""
    a, c, q = F.lower(answer), F.lower(context), F.lower(question)
    return F.filter(F.array(*[F.lit(x) for x in T.CAUSAL]), lambda p: F.contains(a, p) & ~F.contains(c, p) & ~F.contains(q, p))


def invented_sums(answer: Column, context: Column) -> Column:
    """Calculations of the answer that the context doesn't show with a minus between the captured operands.

    Operands keep the spaces they were found with, so that spaced forms never match.
    """
    parts = F.arrays_zip(*[F.regexp_extract_all(answer, F.lit(T.CALCULATION), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)])
    shown = lambda x, sign, equals: F.contains(context, F.concat(x["g1"], F.lit(sign), x["g2"], F.lit(equals), x["g3"]))
    missing = F.filter(parts, lambda x: ~shown(x, "-", "=") & ~shown(x, " - ", " = "))
    return F.transform(missing, lambda x: F.concat(x["g1"], F.lit("|"), x["g2"], F.lit("|"), x["g3"]))


def inconsistent(predicates: Column) -> Column:
    """Some predicate says zero, some says at least one, and some speaks of all."""
    some = lambda pattern, form=lambda x: x: F.exists(predicates, lambda p: form(p).rlike(pattern))
    return some(r"==\s*0|zero", F.lower) & some(r">=\s*[1-9]|>\s*0") & some("forall|all|every", F.lower)


def gates(rows: DataFrame, opinion: Column) -> DataFrame:
    """Adds ``gate`` (the one that decided), ``feedback`` (null: accepted) and ``has_contradiction``.

    ``rows`` has question, question_type, answer, context and predicates (an
    array). Only questions of the kind predicate reach the third gate;
    ``opinion`` is what the auditing model says, PASS in any case and place to accept.
    """
    a, c, q = F.col("answer"), F.col("context"), F.col("question")
    causes, sums = fabricated_causes(a, c, q), F.when(a.contains("TRUSTED CODE EXECUTION RESULT"), F.array().cast("array<string>")).otherwise(invented_sums(a, c))
    told = F.concat(F.transform(causes, lambda p: F.concat(F.lit("cause not in the source: "), p)), F.transform(sums, lambda x: F.concat(F.lit("calculation not in the source: "), x)))
    staged = rows.withColumn("__told", F.slice(told, 1, 2)).withColumn("__bad", (F.col("question_type") == "predicate") & inconsistent(F.col("predicates"))).withColumn("__kind", T.contradiction(c)).withColumn("__opinion", opinion)
    gate = F.when(no_answer(a), "no_answer").when(F.size("__told") > 0, "fabrication").when(F.col("__bad"), "constraint").otherwise("model")
    feedback = (
        F.when(F.col("gate") == "fabrication", F.concat(F.lit("FABRICATION: "), F.array_join("__told", "; ")))
        .when((F.col("gate") == "constraint") & (F.col("__kind") == "revision"), "CONTRADICTION: use the corrected value of the source")
        .when((F.col("gate") == "constraint") & (F.col("__kind") == "none"), "UNRESOLVED CONTRADICTION: the source does not explain it")
        .when((F.col("gate") == "model") & ~F.upper("__opinion").contains("PASS"), F.col("__opinion"))
    )
    out = staged.withColumn("gate", gate).withColumn("feedback", feedback).withColumn("has_contradiction", (F.col("gate") == "constraint") & (F.col("__kind") == "documented_conflict"))
    return out.drop("__told", "__bad", "__kind", "__opinion")


def answered(rows: DataFrame, generate: Callable[[Column, Column, Column], Column], opinion: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """Answers, audited; those with feedback are given once more, ``attempts`` in all. Adds answer, attempts and what ``gates`` adds.

    ``generate`` makes an answer from question, context and feedback (null the
    first time); only rows with feedback get another.
    """
    rest = rows.columns
    done = gates(rows.withColumn("answer", generate(F.col("question"), F.col("context"), F.lit(None).cast("string"))), opinion).withColumn("attempts", F.lit(1))
    for n in range(2, attempts + 1):
        again = F.col("feedback").isNotNull()
        next_ = done.withColumn("answer", F.when(again, generate(F.col("question"), F.col("context"), F.col("feedback"))).otherwise(F.col("answer")))
        next_ = next_.withColumn("attempts", F.when(again, n).otherwise(F.col("attempts"))).select(*rest, "answer", "attempts")
        done = gates(next_, opinion)
    return done


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens and calls of each provider (provider, prompt_tokens, completion_tokens)."""
    return calls.groupBy("provider").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("calls"))
