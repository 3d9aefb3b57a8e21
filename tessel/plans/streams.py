"""Streams run over the event log: the same rows as their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans.base import query
from tessel.streaming import stream


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet")
    return stream.drained(stream.tumbling(e, "ts", ["event_type"], "1 day", "2 days"), "complete")


@query("SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet")
    return stream.drained(stream.latest(e, "user_id", "ts", ["event_type"]), "complete")


@query("SELECT DISTINCT user_id || '-' || event_type AS nonce FROM events")
def stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet").select(F.concat_ws("-", "user_id", "event_type").alias("nonce"), "ts")
    return stream.drained(stream.inbox(e, "nonce", "ts", "37 days")).select("nonce")


@query("WITH l AS (SELECT event_id, user_id, event_type, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, ts FROM events) SELECT event_id, user_id, event_type FROM l WHERE before IS NULL OR NOT before > ts - INTERVAL 24 HOUR")
def stream_gap_dup_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.event_stream(spark, sf_dir, "events.parquet")
    return stream.drained(stream.suppressed(e, ["user_id", "event_type"], "ts", "event_id", 24)).select("event_id", "user_id", "event_type")
