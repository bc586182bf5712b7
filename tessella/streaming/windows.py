"""Streaming counterparts: windows of events, identity dedupe, scoring of a source stream against a static target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time_col: str, by: str, value_col: str, *, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, by, events, value by tumbling window; late: the watermark of a stream."""
    rows = events.withWatermark(time_col, late) if late else events
    out = rows.groupBy(F.window(time_col, width).alias("w"), by).agg(F.count("*").alias("events"), F.sum(value_col).alias("value"))
    return out.select(F.col("w.start").alias("start"), by, "events", "value")


def dedupe_stream(rows: DataFrame, key: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def score_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writes score(batch), the edges of each micro-batch against a static target, under path; one folder a batch, so that a batch that runs again replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
