"""The action-log folds over a stream: last action of each reviewed item, and status counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_actions_stream(log: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, action, value) after all actions so far, for output mode complete or update. State: a row for each key."""
    return log.groupBy(key).agg(F.max_by(F.struct("action", "value"), "seq").alias("x")).select(key, "x.*")


def action_counts(log: DataFrame, time_col: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, action, n) in tumbling windows; actions later than the watermark are dropped by definition of it."""
    counts = log.withWatermark(time_col, late).groupBy(F.window(time_col, every), "action").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "action", "n")
