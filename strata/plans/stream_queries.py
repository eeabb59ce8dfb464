"""Streaming queries, each run over what its source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.streaming import revisions


def s2_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = revisions.read_stream(spark, f"{sf_dir}/events.parquet")
    out = revisions.run_once(revisions.windowed_counts(events, "ts", ["event_type"], "value"), "complete")
    return out.select("start", "event_type", "n", F.round("total", 2).alias("total"))


S2 = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def s3_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as revisions whose generations jump about: those above all before them apply, the others are late."""
    events = revisions.read_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("event_id") * 7919 % 1000).alias("generation"))
    return revisions.run_once(revisions.generations(events, "user_id", "event_id", "generation"))


S3 = """
WITH e AS (SELECT user_id, event_id, event_id * 7919 % 1000 AS generation FROM events)
SELECT user_id, event_id, generation, CASE WHEN coalesce(generation > max(generation) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 'applied' ELSE 'late' END AS status FROM e
"""

QUERIES = {f.__name__: f for f in (s2_stream_windows, s3_generations)}
ORACLES = {"s2_stream_windows": S2, "s3_generations": S3}
