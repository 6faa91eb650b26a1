"""Job state: events to last states, listings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage

# What an event says about a job.
STATUS = {"signup": "processing", "purchase": "completed", "error": "failed", "click": "cancelled"}


def with_status(events: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return events.withColumn("status", F.try_element_at(table, F.col("event_type"))).where("status IS NOT NULL")


def latest(events: DataFrame) -> DataFrame:
    """Last state of each key (user_id) by time, then event_id: partial aggregation, no sort."""
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return with_status(events).groupBy("user_id").agg(last.alias("s")).select("user_id", F.col("s.status").alias("status"), F.col("s.ts").alias("ts"), T.ttl_seconds(F.col("s.status")).cast("long").alias("ttl_seconds"))


def expired(states: DataFrame, as_of: Column) -> DataFrame:
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return states.withColumn("expired", age > F.col("ttl_seconds"))


def fields(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The hash of each key after partial updates: task_id, status, uploaded_at, completed_at, error (500 characters at most), each its last value that was given.

    An empty text that was given is a value, and is read as null.
    """
    at = F.struct(*order)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    out = updates.groupBy(key).agg(*[last(c).alias(c) for c in ("task_id", "status", "uploaded_at", "completed_at", "error")])
    return out.withColumn("error", T.empty_to_null(F.substring("error", 1, 500))).withColumn("completed_at", T.empty_to_null(F.col("completed_at"))).withColumn("ttl_seconds", T.ttl_seconds(F.col("status")).cast("long"))


def without(states: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """States but those of the exact keys in ``gone``."""
    return states.join(gone.select(key).distinct(), key, "left_anti")


def cancelled_removed(rows: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """What is left of a running ingest: nothing of keys whose state says cancelled."""
    return without(rows, states.where("status = 'cancelled'"), key)


def settled(tasks: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Uploads that are over: their task ended and their document's state says so too; others stay on the list."""
    ended = tasks.where(F.col("task_status").isin("SUCCESS", "FAILURE", "REVOKED"))
    return ended.join(states.where(F.col("status").isin("completed", "failed", "cancelled")).select(key, "status"), key).select(key, "task_status", "status")


def select_completed(files: DataFrame) -> DataFrame:
    return files.where("status = 'completed'").select("filename")


def shown_in_summary(files: DataFrame, selected: list[str]) -> DataFrame:
    """The selected files; none where nothing is selected, unlike a search's filter."""
    return files.where(F.col("filename").isin(selected) if selected else F.lit(False))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: each row's place (from 1) in the order of all rows.

    Rows are sorted by ranges and counted in each; only the ranges' counts meet in one task.
    """
    ranged = stage(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__row") - F.col("__first") + F.col("__before") + 1).drop("__part", "__row", "__first", "__before")  # a row for each range


def recent(files: DataFrame, n: int = 8) -> DataFrame:
    return files.orderBy(F.coalesce("uploaded_at", F.lit("0000")).desc(), "filename").limit(n)


def health(checks: DataFrame) -> DataFrame:
    """healthy where every service says ok, else degraded, with the services by name."""
    return checks.agg(F.when(F.bool_and(F.col("result") == "ok"), "healthy").otherwise("degraded").alias("status"), F.array_sort(F.collect_list(F.concat_ws("=", "service", "result"))).alias("checks"))


def listing(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files with their state; completed where there is none; newest first, then by name."""
    out = files.join(states, "filename", "left").withColumn("status", F.coalesce("status", F.lit("completed")))
    return out.orderBy(F.coalesce("uploaded_at", F.lit("0000")).desc(), "filename")


def sort_documents(df: DataFrame, by: str, ascending: bool) -> DataFrame:
    key = {"name": F.lower("filename"), "date": F.coalesce("uploaded_at", "completed_at", F.lit("0")), "size": F.coalesce("size", F.lit(0))}[by]
    return df.orderBy(key.asc() if ascending else key.desc(), "filename")
