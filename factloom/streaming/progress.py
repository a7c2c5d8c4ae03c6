"""The state of tasks from a stream of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_states(events: DataFrame) -> DataFrame:
    """A streaming frame of events(module, at, status): each module's last status, verified once it ever was, and attempts.

    State is a row for each module, whatever the number of events; write it in update or complete mode."""
    last = F.max(F.struct("at", "status"))["status"]
    return events.groupBy("module").agg(
        F.when(F.max((F.col("status") == "verified").cast("int")) == 1, "verified").otherwise(last).alias("status"),
        F.sum((F.col("status") == "in_progress").cast("int")).cast("long").alias("attempts"),
    )


def activity(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events(ts, status) by window and status; what comes later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")
