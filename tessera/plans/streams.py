"""Queries that run the event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import sequences
from tessera.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.events(spark, f"{sf_dir}/events.parquet")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour sessions per user from the stream."""
    found = streams.to_table(streams.sessions(_events(spark, sf_dir), "6 hours"), "complete")
    return found.select("user_id", F.unix_seconds("s.start").alias("started"), "frames", F.round("total", 4).alias("total"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums per event type from the stream."""
    found = streams.to_table(streams.windows(_events(spark, sf_dir), "1 day"), "complete")
    return found.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of small values per user, by keyed state."""
    return streams.to_table(streams.streaks(_events(spark, sf_dir), 23.0, 2), "append")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event per user, merged batch by batch."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("place"))
    return streams.upsert_table(rows, ["user_id"], "place").drop("place")


QUERIES = {f.__name__: f for f in (stream_sessions, stream_windows, stream_streaks, stream_latest)}
ORACLES = {
    "stream_sessions": sequences.ORACLES["session_bursts"],
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_streaks": sequences.ORACLES["jnd_runs"],
    "stream_latest": sequences.ORACLES["latest_state"],
}
