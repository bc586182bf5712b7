"""Size of the Arrow batches in which texts go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bytes a batch to 16 MB, so that workers and their buffers stay small beside the heap."""
    if int(str(spark.conf.get(SETTING)).rstrip("bB") or 0) not in range(1, BYTES + 1):
        spark.conf.set(SETTING, str(BYTES))
