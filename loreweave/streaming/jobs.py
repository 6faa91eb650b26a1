"""Job states as a stream: one keyed value with a time to live, last event by time wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators.state import with_status

OUTPUT = "user_id long, status string, ts timestamp, event_id long"


class LastState(StatefulProcessor):
    """Keeps status, time and event of the latest event of a key; emits the state after each batch.

    A state lives as long as its status says (``ttl_ms``), from its last event
    on by the processing clock: a timer drops it, and an update moves the timer.
    """

    def __init__(self, ttl_ms: dict[str, int] | None = None):
        self.ttl_ms = ttl_ms or {k: v * 86_400_000 for k, v in T.TTL_DAYS.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, ts timestamp, event_id long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.state.get() if self.state.exists() else None
        # a batch's rows come before its timers
        best = held = held if held is not None and held[3] > now else None
        for pdf in rows:
            r = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if best is None or (r["ts"], int(r["event_id"])) > (pd.Timestamp(best[1]), int(best[2])):
                best = (r["status"], r["ts"].to_pydatetime(), int(r["event_id"]), now + self.ttl_ms.get(r["status"], 30 * 86_400_000))
        if best is not held:
            self.state.update(best)
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(best[3]))
        yield pd.DataFrame({"user_id": [key[0]], "status": [best[0]], "ts": [best[1]], "event_id": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "status": pd.Series([], dtype="object"), "ts": pd.Series([], dtype="datetime64[us]"), "event_id": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ttl_ms: dict[str, int] | None = None) -> DataFrame:
    """Stream of states from a stream of events (event_id, ts, user_id, event_type); ``ttl_ms`` is how long each status lives."""
    keyed = with_status(events).select("user_id", "status", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return keyed.groupBy("user_id").transformWithStateInPandas(LastState(ttl_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")


def run_available(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Processes all events files there are and returns each key's last state.

    Micro-batches are appended with their number, so that a batch that is run
    again after a failure is overwritten, and the last emission counts.
    """
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(_as_pattern(path))

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # timers by the clock would otherwise go on making batches without data
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = job_states(events).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("s"))
    return last.select("user_id", F.col("s.status").alias("status"), F.col("s.ts").cast("timestamp_ntz").alias("ts"), T.ttl_seconds(F.col("s.status")).cast("long").alias("ttl_seconds"))


def _as_pattern(path: str) -> str:
    """The path as a pattern, which a stream reads alike whether it is a file or a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"
