"""Batch forms of the streaming windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.registry import query, table
from veristrata.streaming import windows


@query("events_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.unix_timestamp("start").alias("start"), "n")
