"""Windows, sessions and clusters of the event and document tables (batch runs of the streaming operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import read_table
from quarry.streaming import events as streams


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.windowed_counts(read_table(spark, sf_dir, "events"), ["event_type"])
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sessions(read_table(spark, sf_dir, "events"), "user_id", "6 hours")
    return rows.select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n")


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a purchase of more than 150."""
    e = read_table(spark, sf_dir, "events")
    return streams.remaining(e.select("user_id").distinct(), e.where("event_type = 'purchase' AND value > 150"), ["user_id"])


NAMES = "event_windows event_sessions resume_remaining".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLE_SQL = {
    "event_windows": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "resume_remaining": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)",
}
