"""Session building for local runs; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tessella", *, cpus: int | None = None, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with AQE on and shuffle partitions sized to the cores."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
