"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is set, local mode gets a temporary one; on a cluster that would be the driver's own disk, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="landgrain-"))
    return sc.getCheckpointDir()


#: Whether Spark removes the shuffles of an execution at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage ends there.

    A lost executor costs nothing that was written, and every later read sees the same rows. The shuffles that led to the
    table are removed at once, and not when the driver happens to collect its garbage.
    """
    return staged_parts([df], label, compression)


def staged_parts(parts: Iterable[DataFrame], label: str, compression: str = "zstd") -> DataFrame:
    """One table of several frames with the same columns, written one after the other; see staged()."""
    path, schema = None, None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", schema or df.schema
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", compression).parquet(path)
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)
