"""Structured Streaming: request metrics and checks of micro-batches; an addition to what the batch queries do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(events: DataFrame, at: str, path: str, value: str, error: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, path, requests, errors, mean) per tumbling window; rows later than ``late`` are dropped."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    found = timed.groupBy(F.window("_at", window).alias("w"), path).agg(F.count("*").alias("requests"), F.count_if(F.col(value) >= error).alias("errors"), F.avg(value).alias("mean"))
    return found.select(F.col("w.start").alias("start"), path, "requests", "errors", "mean")


def for_each_batch(check: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that runs a batch check (drift, quality) on each micro-batch."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(check(batch).withColumn("batch", F.lit(number)), number)

    return run
