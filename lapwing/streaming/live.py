"""The window and session operators on Structured Streaming.

The same functions work on batch frames, and on batches they return what the stream ends with.
Frames have user_id, ts (a timestamp), event_type, value, event_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Longest session, in milliseconds.
CAP_MS = 3 * 3_600_000
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of events as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withWatermark("ts", "1 hour")


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Hourly features of each participant."""
    w = F.window("ts", length)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select("user_id", F.col("w.start").alias("start"), "n", "total", "most")


def sliding(events: DataFrame, length: str = "4 hours", slide: str = "1 hour") -> DataFrame:
    w = F.window("ts", length, slide)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Bouts of activity that a gap ends."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Of accumulating snapshots of one key in a window, the one with the greatest value."""
    w = F.window("ts", window)
    return events.groupBy("user_id", "event_type", w.alias("w")).agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.max("value").alias("value")).select("user_id", "event_type", F.col("w.start").alias("start"), "event_id", "value")


def prompts_with_signals(events: DataFrame, hours: int = 4) -> DataFrame:
    """Prompts joined with the signals of the hours before: a stream-stream join bounded by both watermarks."""
    prompts = events.where("event_type = 'purchase'").select(F.col("event_id").alias("prompt_id"), F.col("user_id").alias("pu"), F.col("ts").alias("pt"))
    signals = events.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    on = (F.col("pu") == F.col("user_id")) & (F.col("ts") >= F.col("pt") - F.expr(f"interval {hours} hours")) & (F.col("ts") < F.col("pt"))
    return prompts.join(signals, on, "leftOuter").select("prompt_id", F.col("pu").alias("user_id"), "event_id")


class Pairing(StatefulProcessor):
    """Keeps a user's last unlock and pairs it with the next lock; sessions over three hours do not count, and a
    timer at their end frees an unlock that was given up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ms long", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        frame = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        last = self.open.get()[0] if self.open.exists() else None
        for ms, state in zip(frame["ms"], frame["state"]):
            if state == "unlocked":
                last = int(ms)
            elif last is not None:
                if 0 < ms - last <= CAP_MS:
                    out.append((key[0], last, int(ms)))
                last = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is None:
            self.open.clear()
        else:
            self.open.update((last,))
            self.handle.registerTimer(last + CAP_MS + 1)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start_ms", "end_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def paired_sessions(states: DataFrame) -> DataFrame:
    """Unlock to lock sessions with state across batches; states: user_id, ms, state, event_id, and ts with its
    watermark, which moves the timers.  Needs the RocksDB state store (``with_state_store``)."""
    return states.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Pairing(), outputStructType="user_id long, start_ms long, end_ms long", outputMode="append", timeMode="EventTime")


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet under ``path``."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream in complete mode over all that is there; for small results (tests)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
