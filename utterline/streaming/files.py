"""Files that arrive in a folder, in place of polling it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import unprocessed

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without it."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="utterline-stream-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = f"file://{path}"
    return _OWN[app]


def arriving(spark: SparkSession, folder: str, schema, names: str = "*", files_at_once: int = 1000, archive: str | None = None) -> DataFrame:
    """Parquet files of ``folder`` as a stream; with ``archive`` they are moved there once they are done with.

    With ``names`` only files named so; where that is the name of a folder, as many writers make of one table, the files in it.
    """
    own = spark._jvm.org.apache.hadoop.fs.Path(folder, names) if not re.search(r"[*?\[{\\]", names) else None
    fs = own and own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if own and fs.exists(own) and fs.getFileStatus(own).isDirectory():
        folder, names = f"{folder}/{names}", "*"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_at_once)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(folder)


def appended(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take in all that has arrived, as files under ``out``; a run that fails goes on where it was, and no row is written twice."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_usage(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts and last use by window and ``keys``. Rows later than ``late`` behind the newest are dropped by the watermark, which bounds the state."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("usage_count"), F.max(at).alias("last_used")).select(F.col("window.start").alias("window_start"), *keys, "usage_count", "last_used")


def detect_new(rows: DataFrame, done: Callable[[], DataFrame | None], key: str, text: str, detectors: dict[str, Column], out: str, checkpoint: str) -> None:
    """Run detectors on rows that have no result yet, batch by batch, and append their results to ``out``.

    ``done`` reads the results so far. Results are checked against it in each batch, so a batch that runs again adds nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        known = done()
        fresh = df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "") if known is None else unprocessed(df, known, key, text)
        fresh.dropDuplicates([key]).select(key, *(c.alias(n) for n, c in detectors.items())).write.mode("append").parquet(out)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
