"""Queries over streams that take in all that has arrived, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..streaming import files
from .queries import _HAS
from .registry import query, table


@query(f"SELECT conv_id, turn, role FROM conversations WHERE {_HAS('the')}")
def stream_detect(spark, sf_dir):
    """Turns with a lexicon word, by a stream from the table's folder into files."""
    folder = f"{files.shared_folder(spark)}/detect-{uuid.uuid4().hex}"
    rows = files.arriving(spark, sf_dir, table(spark, sf_dir, "conversations").schema, "conversations.parquet")
    files.appended(rows.where(text.has_word(F.lower("text"), "the")).select("conv_id", "turn", "role"), f"{folder}/rows", f"{folder}/state")
    return spark.read.schema("conv_id long, turn long, role string").parquet(f"{folder}/rows")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS usage_count, max(ts) AS last_used FROM events GROUP BY 1, 2)
 SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, event_type, usage_count, CAST(floor(epoch(last_used)) AS BIGINT) AS last_used FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_usage(spark, sf_dir):
    """Usage by day and type; a day is given once the watermark has passed it."""
    folder = f"{files.shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = files.arriving(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    files.appended(files.windowed_usage(events, "ts", ["event_type"], "1 day", "1 day"), f"{folder}/rows", f"{folder}/state")
    out = spark.read.schema("window_start timestamp, event_type string, usage_count long, last_used timestamp").parquet(f"{folder}/rows")
    return out.withColumn("window_start", F.unix_seconds("window_start")).withColumn("last_used", F.unix_seconds("last_used"))
