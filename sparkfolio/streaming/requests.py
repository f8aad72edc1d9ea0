"""Structured Streaming twins of the stateful operators, over a stream of requests (event_id, ts, session_id, failed, ...)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkfolio.operators import state

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_stream(spark: SparkSession, path: str, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{glob}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), (F.col("event_type") == "error").alias("failed"))


def daily_usage(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests per UTC day as tumbling windows; rows later than ``late`` are not counted."""
    windows = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("used"))
    return windows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "used")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions: a session ends after ``gap`` without requests."""
    return (
        requests.withWatermark("ts", late)
        .groupBy("session_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("n"))
        .select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def first_seen(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class SessionCap(StatefulProcessor):
    """Counts a session's requests and says whether each is still allowed, and whether it falls into a cooldown."""

    def __init__(self, cap: int, cooldown: float):
        self.cap, self.cooldown = cap, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")
        self.mark = handle.getValueState("mark", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        mark = self.mark.get()[0] if self.mark.exists() else None
        for batch in rows:
            batch = batch.sort_values(["ts", "event_id"])
            out = []
            for event, ts, failed in zip(batch["event_id"], batch["ts"], batch["failed"], strict=True):
                at = ts.timestamp()
                out.append((event, key[0], used, used < self.cap, mark is not None and mark + self.cooldown > at))
                used += 1
                if failed:
                    mark = at if mark is None else max(mark, at)
            yield pd.DataFrame(out, columns=["event_id", "session_id", "used", "allowed", "cooling"])
        self.used.update((used,))
        if mark is not None:
            self.mark.update((mark,))

    def close(self) -> None:
        pass


def capped(requests: DataFrame) -> DataFrame:
    """Stateful session cap and cooldown (needs the RocksDB state store).

    The processor travels by value: the driver's own state worker sees no shipped files.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return requests.groupBy("session_id").transformWithStateInPandas(
        SessionCap(state.SESSION_CAP, state.COOLDOWN_S), outputStructType="event_id long, session_id long, used long, allowed boolean, cooling boolean", outputMode="Append", timeMode="None"
    )


def append_log(rows: DataFrame, path: str, checkpoint: str):
    """Append-only query log: JSON lines, exactly once per batch."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
