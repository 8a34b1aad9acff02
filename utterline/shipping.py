"""Gives this package to the executors, so that worker functions find it wherever the driver was started."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Once for each application; called where a worker function is built. Without a session there is nobody to give it to."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if getattr(sc, "_utterline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # this runs from the shipped archive itself
        return
    path = Path(tempfile.mkdtemp(prefix="utterline-zip-")) / "utterline_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._utterline_shipped = True


def spread(df: DataFrame, *key: str) -> DataFrame:
    """At least a partition for each core, dealt by a hash of ``key``, where Python does the work: a small file is one partition else."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *key)


def give_back() -> None:
    """On a worker: memory that is free goes back to the system, as workers stay for the next task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
