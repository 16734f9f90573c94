"""Request limits on streams: windows with watermarks, dedup with bounded state, an adaptive interval per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BASE, MOST, BACKOFF, RECOVERY = 1.0, 60.0, 2.0, 0.9


def next_interval(now: float, failed: bool) -> float:
    """Longer after a limit or server error, shorter after a success, within bounds."""
    return min(MOST, now * BACKOFF) if failed else max(BASE, now * RECOVERY)


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by type; rows later than the watermark are left out."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: state is dropped when the watermark passes."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def adaptive(events: DataFrame) -> DataFrame:
    """The interval after each batch's events of a user, kept as state; events of a batch are taken in time order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (BASE, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            now, n = next_interval(now, kind == "error"), n + 1
        state.update((now, n))
        yield pd.DataFrame({"user_id": [key[0]], "interval": [now], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, interval double, n long", "interval double, n long", "update", GroupStateTimeout.NoTimeout)


def adaptive_batch(events: DataFrame) -> DataFrame:
    """The same over a table, by a fold over each user's events in order: no Python."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    fold = F.aggregate(
        ordered,
        F.lit(BASE),
        lambda acc, e: F.when(e["event_type"] == "error", F.least(F.lit(MOST), acc * BACKOFF)).otherwise(F.greatest(F.lit(BASE), acc * RECOVERY)),
    )
    return events.groupBy("user_id").agg(fold.alias("interval"), F.count("*").alias("n"))
