"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Applications whose folder is marked for deletion.
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session that names none gets a temporary one if it runs in one process; on a cluster that is an error, as executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _folder(spark: SparkSession):
    """The application's folder and its file system, in the JVM."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, among those of this application, which are deleted when its driver ends."""
    if spark.sparkContext.applicationId not in _marked:
        path, system = _folder(spark)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(spark.sparkContext.applicationId)
    return f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder now; DataFrames that still read them fail from then on."""
    path, system = _folder(spark)
    system.delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages start from files, so that a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)  # snappy's direct buffers stay until a heap collection
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df (already materialized, fixed-width rows) marked for broadcast if a count proves it small; otherwise unmarked, so that joins shuffle it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= max_rows else df
