"""Budgets, session caps, cooldowns and the answer cache over request tables (the batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAILY_LIMIT, KEPT_DAYS, SESSION_CAP, COOLDOWN_S, TTL_S, CACHE_ENTRIES = 1000, 14, 40, 3600, 86_400, 256


def daily_budget(requests: DataFrame, limit: int = DAILY_LIMIT, days: int = KEPT_DAYS) -> DataFrame:
    """Requests per UTC day, the newest ``days``; what is left, and whether that is little or nothing."""
    per = requests.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(limit) - F.col("used"), F.lit(0))
    newest = per.select("*", F.row_number().over(Window.orderBy(F.col("day").desc())).alias("_n")).where(F.col("_n") <= days)
    return newest.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "used", left.cast("long").alias("remaining"), (left == 0).alias("exhausted"), (left <= max(1, limit // 10)).alias("low")
    )


def session_cap(requests: DataFrame, cap: int = SESSION_CAP) -> DataFrame:
    """Each request with the number used before it in its session, and whether it is still allowed."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1
    return requests.select("event_id", "session_id", n.cast("long").alias("used"), (n < cap).alias("allowed"))


def cooldown(requests: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """Whether a request falls within ``seconds`` after an earlier failure of its session."""
    earlier = Window.partitionBy("session_id").orderBy(F.col("ts").cast("double"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max(F.when(F.col("failed"), F.col("ts"))).over(earlier)
    return requests.select("event_id", F.coalesce(mark.cast("double") + seconds > F.col("ts").cast("double"), F.lit(False)).alias("cooling"))


def cache_state(writes: DataFrame, now, ttl: int = TTL_S, entries: int = CACHE_ENTRIES) -> DataFrame:
    """The entries of a cache: the latest write of each key that has not expired, the newest ``entries`` of them.

    ``writes``: key, stored_at (seconds), value.  ``now`` is a number of seconds, or a frame of one row and column that has it.
    """
    latest = writes.groupBy("key").agg(F.max(F.struct("stored_at", "value")).alias("w")).select("key", "w.stored_at", "w.value")
    if isinstance(now, DataFrame):
        at = F.col(now.columns[0])
        live = latest.crossJoin(F.broadcast(now)).where(at - F.col("stored_at") <= ttl).drop(now.columns[0])
    else:
        live = latest.where(F.lit(now) - F.col("stored_at") <= ttl)
    return live.orderBy(F.col("stored_at").desc(), "key").limit(entries)
